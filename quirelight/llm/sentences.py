"""Problem 2: sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.session import materialise

#: Longer texts are cut into chunks of this many characters, processed apart.
CHUNK = 65_536
#: Letters and digits that a chunk sees on either side of itself, to classify its first and last
#: events. The rules look at most 40 characters of words back and ahead, beyond any run of white
#: space and marks; such a run is never cut, so a chunk classifies as the whole text would.
MARGIN = 96
#: Chunks whose state functions one task composes before the next level of the scan.
FAN = 1024

# Abbreviations after which a full stop does not end a sentence ...
_NEVER = frozenset(
    "dr prof mr mrs ms st fig figs no nos vs cf sec sect app approx vol pp ed eds rev gen col eq eqs ch art "
    "i.e e.g p.ej ej aprox sr sra dra núm pág vgl abb ca z.b d.h bzw nr hr fr bd s.o s.u m mme mm env c.-à-d p.ex ex "
    "doi viz resp cap jr डॉ श्री प्रो सुश्री د أ".split()
)
# ... and those after which it does when a new sentence visibly begins.
_SOMETIMES = frozenset("etc inc ltd co corp al a.m p.m u.k u.s u.s.a usw u.a e.u ph.d b.c a.d".split())
# Words that carry on a sentence after a quotation, in scripts without case.
_ONWARD = ("然后", "并", "便", "就", "随后", "接着", "但", "而", "说", "ثم", "وقال", "और", "कहकर", "फिर")
# Words before a day number in German, month names after one.
_BEFORE_DAY = frozenset("am vom zum den der dem ab bis seit".split())
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

_EVENT = regex.compile(
    r"""(?P<para>\n[^\S\n]*\n\s*)
      | (?P<term>[.!?…]+)
      | (?P<full>[。！？｡؟।॥]+)
      | (?P<quote>["＂])
      | (?P<low>[„‚])
      | (?P<high>“)
      | (?P<open>[(\[{«「『（【《〈‹])
      | (?P<close>[)\]}»”」』）】》〉›])
      | (?<=[ก-๎])(?P<thai>[^\S\n]*\n?[^\S\n]+|[^\S\n]*\n[^\S\n]*)(?=[ก-๎])""",
    regex.X,
)
_WORD_BACK = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’.\-]*[\p{L}\p{M}\p{N}])?$")
_NEXT = regex.compile(r"(\s*)(\S?)")
_CLOSERS = "\"＂)]}»”」』）】》〉›’"
_OPENERS = "\"＂([{«“„「『（【《〈‹¿¡‘"

# Event classes, the alphabet of the transducer.
(END, INNER, OPEN, CLOSE_END, CLOSE, QUOTE_END, QUOTE, LOW, HIGH_END, HIGH, PARA, CUT) = range(12)
DEPTHS = 4  # nesting deeper than this counts as this deep
STATES = DEPTHS * 4  # bracket depth, plain quotation mark open, low quotation mark open


def _step(state: int, event: int) -> tuple[int, bool]:
    """The rules: next state, and whether a sentence ends after the event.

    A state is (bracket depth, plain quotation open, low quotation open). Ends inside a
    bracket or quotation belong to the sentence around it; after the closing mark a sentence
    ends if the quotation did and a new sentence visibly begins.
    """
    depth, plain, low = state >> 2, (state >> 1) & 1, state & 1

    def at(d: int, p: int, g: int) -> int:
        return d << 2 | p << 1 | g

    free = depth == 0 and not plain and not low
    if event == PARA:
        return 0, True
    if event in (END, CUT):
        return state, free
    if event == OPEN:
        return at(min(depth + 1, DEPTHS - 1), plain, low), False
    if event in (CLOSE, CLOSE_END):
        d, g = (depth - 1, low) if depth else (0, 0)
        return at(d, plain, g), event == CLOSE_END and d == 0 and not plain and not g
    if event in (QUOTE, QUOTE_END):
        p = 1 - plain
        return at(depth, p, low), event == QUOTE_END and p == 0 and depth == 0 and not low
    if event == LOW:
        return at(depth, plain, 1), False
    if event in (HIGH, HIGH_END):
        if low:
            return at(depth, plain, 0), event == HIGH_END and depth == 0 and not plain
        return at(min(depth + 1, DEPTHS - 1), plain, low), False
    return state, False


#: The compiled transducer: NEXT[event, state] and ENDS[event, state].
NEXT = np.array([[_step(s, e)[0] for s in range(STATES)] for e in range(12)], np.int8)
ENDS = np.array([[_step(s, e)[1] for s in range(STATES)] for e in range(12)], bool)
_NEXT_ROWS = NEXT.tolist()
_ENDS_ROWS = ENDS.tolist()


def _begins(text: str, at: int, spaced: bool) -> bool:
    """Does what stands at ``at`` look like the begin of a sentence?"""
    while at < len(text) and text[at] in _OPENERS:
        at += 1
        while at < len(text) and text[at].isspace():
            at += 1
    if at >= len(text):
        return True
    c = text[at]
    if c.islower():
        # a name such as eSketch may begin a sentence
        return spaced and at + 1 < len(text) and text[at + 1].isupper()
    if c.isdigit():
        return spaced
    return c.isalpha() or c in "#*•–—-"


def _ends_here(text: str, start: int, end: int) -> int:
    """Class of the full stop (or !, ?) at [start, end)."""
    m = _NEXT.match(text, end)
    gap, c = m.group(1), m.group(2)
    if not c or "\n\n" in gap:
        return END
    if c in _CLOSERS and not (gap and c in "\"＂"):
        return INNER  # the closing mark decides
    mark = text[start:end]
    begins = _begins(text, m.end(1), bool(gap))
    if not begins:
        return INNER
    back = _WORD_BACK.search(text, max(0, start - 40), start)
    word = back.group() if back else ""
    if "." in word and len(head := word.rsplit(".", 1)[0]) > 3 and head.replace("-", "").isalpha():
        word = word.rsplit(".", 1)[1]  # a missing space: cards.Dr
    if mark in ("...", "…") or len(mark) > 1:
        return END if gap else INNER
    if mark in "!?":
        return END if gap or (word and c.isupper()) else INNER
    low = word.lower()
    if not gap:
        # no space: a new sentence only between a word and a capitalised word
        after = text[m.end(1) : m.end(1) + 2]
        fits = len(word) > 1 and (word[-1].islower() or word[-1].isdigit()) and "." not in word and low not in _NEVER
        return END if fits and c.isupper() and (after[1:].islower() or not after[1:].isalpha()) else INNER
    if low in _NEVER:
        return INNER
    if len(word) == 1 and word.isalpha():
        return INNER  # an initial
    if low in _SOMETIMES:
        return END if c.isalpha() or c in _OPENERS and c not in "([" else INNER
    if "." in word and all(len(p) <= 2 for p in word.split(".")) and not word.replace(".", "").isdigit():
        return INNER  # c.-à-d, n.d
    if word.replace(".", "").isdigit():
        before = text[max(0, start - 40) : start - len(word)]
        if "\n\n" in before[-4:].replace(" ", "").replace("\t", "") or start == len(word):
            return INNER  # the number of a heading or list entry
        nxt = regex.match(r"\p{L}+", text[m.end(1) : m.end(1) + 16])
        last = regex.split(r"[\s.]+", before.rstrip())[-1].lower()
        if len(word) <= 2 and (last in _BEFORE_DAY or nxt and nxt.group().lower() in _MONTHS):
            return INNER  # a German date
    return END


def _after_close(text: str, start: int, end: int) -> bool:
    """Did the quotation or bracket closed at [start, end) end a sentence with it?"""
    i = start
    while i and (text[i - 1].isspace() or text[i - 1] in _CLOSERS):
        i -= 1
    if not i or text[i - 1] not in ".!?…。！？｡؟।॥":
        return False
    m = _NEXT.match(text, end)
    gap, c = m.group(1), m.group(2)
    if not c:
        return True
    if c in _CLOSERS and not (gap and c in "\"＂"):
        return False
    if text.startswith(_ONWARD, m.end(1)):
        return False
    if not gap:
        # no space: 」と述べた or », go on; another ideograph begins
        return "一" <= c <= "鿿" or "ァ" <= c <= "ヿ"
    return _begins(text, m.end(1), True) and c not in ",;:"


def events(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(position after the event, class) of the events that start in [lo, hi).

    No event holds a letter or digit, so the search starts right after the last one before
    ``lo`` and meets the same events as a search from the text's begin."""
    at = lo
    while at and not text[at - 1].isalnum():
        at -= 1
    for m in _EVENT.finditer(text, at):
        a, b = m.span()
        if a < lo:
            continue  # belongs to the chunk before, even where it reaches into this one
        if a >= hi:
            break
        kind = m.lastgroup
        if kind == "para":
            yield b, PARA
        elif kind == "term":
            yield b, _ends_here(text, a, b)
        elif kind == "full":
            nxt = _NEXT.match(text, b)
            yield b, INNER if nxt.group(2) and nxt.group(2) in _CLOSERS and not nxt.group(1) else END
        elif kind == "thai":
            yield b, CUT
        elif kind == "quote":
            yield b, QUOTE_END if _after_close(text, a, b) else QUOTE
        elif kind == "low":
            yield b, LOW
        elif kind == "high":
            yield b, HIGH_END if _after_close(text, a, b) else HIGH
        elif kind == "open":
            yield b, OPEN
        else:
            yield b, CLOSE_END if _after_close(text, a, b) else CLOSE


def _beyond(text: str, at: int, step: int) -> int:
    """Where ``MARGIN`` letters and digits lie between ``at`` and there (or the text ends)."""
    seen = 0
    while 0 < at < len(text) if step < 0 else at < len(text):
        seen += (text[at - 1] if step < 0 else text[at]).isalnum()
        at += step
        if seen == MARGIN:
            break
    return at


def pieces_of(text: str, chunk: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(chunk number, its begin and end, where its piece starts, the piece): every chunk with
    its margins, by one pass over the text. A chunk begins at a letter or digit, so no event
    lies across two; a text without any is one chunk."""
    lo = c = 0
    while lo < len(text):
        hi = min(lo + chunk, len(text))
        while hi < len(text) and not text[hi].isalnum():
            hi += 1
        a = _beyond(text, lo, -1)
        yield c, lo, hi, a, text[a : _beyond(text, hi, 1)]
        lo, c = hi, c + 1


def chunk_function(text: str, lo: int, hi: int) -> list[int]:
    """The chunk as a function: end state for every start state."""
    f = np.arange(STATES, dtype=np.int8)
    for _, e in events(text, lo, hi):
        f = NEXT[e][f]
    return f.tolist()


def chunk_cuts(text: str, lo: int, hi: int, state: int) -> list[int]:
    """Positions in the chunk after which a sentence ends, from a known start state."""
    cuts = []
    for at, e in events(text, lo, hi):
        if _ENDS_ROWS[e][state]:
            cuts.append(at)
        state = _NEXT_ROWS[e][state]
    return cuts


def spans(text: str, cuts: list[int], start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Sentences between cuts, without outer white space; pieces without any letter or
    digit join the sentence before them, or the next one at the begin of a paragraph."""
    out: list[tuple[int, int]] = []
    a = start
    for b in [*cuts, len(text) if end is None else end]:
        i, j = a, b
        while i < j and text[i].isspace():
            i += 1
        while j > i and text[j - 1].isspace():
            j -= 1
        if j > i:
            out.append((i, j))
        a = b
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return spans(text, chunk_cuts(text, 0, len(text), 0))


def split_sentences(texts: DataFrame, keys: list[str], text: str, *, chunk: int = CHUNK) -> DataFrame:
    """(keys, ``start_pos``, ``end_pos``) of every sentence of every text.

    Offsets are code points from 0, end exclusive. Null and blank texts have no sentence.

    Texts up to ``chunk`` characters are read once from the start state. Longer ones are cut
    into chunks; each chunk becomes a function on the states, the functions are composed by a
    two-level prefix scan (blocks of ``FAN`` chunks, then the blocks), and every chunk is read
    with its true start state. A chunk's work does not depend on the chunks before it, so one
    enormous text spreads over all tasks. A sentence across chunks is closed by the cut that
    follows it, found from the cuts alone.
    """
    src = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t"))
    ktypes = [f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys]
    size = F.length("_t")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [sentence_spans(t) for t in pdf["_t"]]
            n = [len(g) for g in got]
            out = pdf[keys].loc[pdf.index.repeat(n)].reset_index(drop=True)
            flat = [s for g in got for s in g]
            out["start_pos"] = np.array([a for a, _ in flat], np.int32)
            out["end_pos"] = np.array([b for _, b in flat], np.int32)
            yield out

    result = ", ".join([*ktypes, "start_pos int", "end_pos int"])
    short = src.where(size <= chunk).mapInPandas(whole, result)
    # Texts beyond a chunk take the scan; asking costs a pass over lengths only.
    if src.where(size > chunk).limit(1).count() == 0:
        return short
    long_ = src.where(size > chunk).withColumn("_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys], F.col("_t")), 256))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t in zip(pdf["_id"], pdf["_t"]):
                rows = []
                for c, lo, hi, a, p in pieces_of(t, chunk):
                    rows.append((i, len(t), c, lo - a, hi - a, a, p))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=["_id", "_n", "_c", "_lo", "_hi", "_s", "_p"])
                        rows = []
                yield pd.DataFrame(rows, columns=["_id", "_n", "_c", "_lo", "_hi", "_s", "_p"])

    # each chunk carries its margins only, not the whole text
    pieces = long_.select("_id", "_t").mapInPandas(cut, "_id string, _n int, _c int, _lo int, _hi int, _s int, _p string")
    pieces = materialise(pieces.repartition("_id", "_c"), "chunks")

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [chunk_function(p, lo, hi) for lo, hi, p in zip(pdf["_lo"], pdf["_hi"], pdf["_p"])]
            yield pd.DataFrame({"_id": pdf["_id"], "_c": pdf["_c"], "_f": f})

    fs = materialise(pieces.select("_id", "_c", "_lo", "_hi", "_p").mapInPandas(functions, "_id string, _c int, _f array<int>"), "functions").withColumn("_b", F.expr(f"cast(_c / {FAN} as int)"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        f = list(range(STATES))
        for g in pdf.sort_values("_c")["_f"]:
            f = [g[x] for x in f]
        return pd.DataFrame({"_id": pdf["_id"].iloc[:1], "_b": pdf["_b"].iloc[:1], "_f": [f]})

    def scan(at: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(at)
            state, states = int(pdf["_q"].iloc[0]) if "_q" in pdf else 0, []
            for g in pdf["_f"]:
                states.append(state)
                state = int(g[state])
            return pd.DataFrame({"_id": pdf["_id"], at: pdf[at], "_q": states})

        return run

    blocks = fs.groupBy("_id", "_b").applyInPandas(compose, "_id string, _b int, _f array<int>")
    block_start = blocks.groupBy("_id").applyInPandas(scan("_b"), "_id string, _b int, _q int")
    starts = fs.join(block_start, ["_id", "_b"]).groupBy("_id", "_b").applyInPandas(scan("_c"), "_id string, _c int, _q int")

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, c, lo, hi, s, n, q, p in zip(*(pdf[k] for k in ("_id", "_c", "_lo", "_hi", "_s", "_n", "_q", "_p"))):
                found = chunk_cuts(p, lo, hi, q)
                # trimmed pieces between cuts, marked where they touch the chunk's ends
                edges = [lo, *found]
                for k, a in enumerate(edges):
                    b = edges[k + 1] if k + 1 < len(edges) else hi
                    got = spans(p, [], a, b)
                    x, y = got[0] if got else (a, a)
                    rows.append((i, c, k, x + s, y + s, k == 0 and c > 0, k + 1 == len(edges) and hi + s < n))
            yield pd.DataFrame(rows, columns=["_id", "_c", "_k", "_a", "_z", "_from", "_on"])

    parts = pieces.join(starts, ["_id", "_c"]).select("_id", "_c", "_lo", "_hi", "_s", "_n", "_q", "_p").mapInPandas(cuts, "_id string, _c int, _k int, _a int, _z int, _from boolean, _on boolean")
    parts = materialise(parts, "parts")
    inner = parts.where("not _from and not _on and _z > _a").select("_id", F.col("_a").alias("start_pos"), F.col("_z").alias("end_pos"))

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, a, z = [], None, None
        for x, y, onward in zip(*(pdf.sort_values(["_c", "_k"])[c] for c in ("_a", "_z", "_on"))):
            if y > x:
                a, z = (x if a is None else a), y
            if not onward:
                if a is not None:
                    rows.append((pdf["_id"].iloc[0], a, z))
                a = z = None
        if a is not None:
            rows.append((pdf["_id"].iloc[0], a, z))
        return pd.DataFrame(rows, columns=["_id", "start_pos", "end_pos"])

    # two rows per chunk at most: only the pieces at the chunks' ends are gathered by text
    edge = parts.where("_from or _on").groupBy("_id").applyInPandas(stitch, "_id string, start_pos int, end_pos int")
    ids = long_.select("_id", *keys)
    return short.unionByName(inner.unionByName(edge).join(ids, "_id").select(*keys, "start_pos", "end_pos"))


def passages(contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(``record_kind``, ``record_key``, ``passage``): each distinct passage once.

    Contexts of scanned papers are left out; rows written twice count once.
    """
    c = contexts.where(F.coalesce(F.col("pdf_extract_method"), F.lit("")) != "ocr").select(F.lit("context").alias("record_kind"), F.col("paper_id").alias("record_key"), F.col("extracted_context").alias("passage"))
    e = evidence.select(F.lit("evidence").alias("record_kind"), F.col("id").alias("record_key"), F.col("sentences").alias("passage"))
    return c.unionByName(e).where("record_key is not null and passage is not null").distinct()


def passage_sentences(contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every sentence of every passage with its place in the text."""
    return split_sentences(passages(contexts, evidence), ["record_kind", "record_key"], "passage").distinct()
