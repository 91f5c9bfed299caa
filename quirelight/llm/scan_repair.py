"""Problem 7: repairing text from scanned pages.

Averaged perceptrons, trained in the query: one tells page furniture from text by line and
page-position features, one edits characters (keep, replace, delete, insert), one decides
how two lines join at a split word. None has a table: the character editor learns from the
collection's own misread words, the line join from the collection's words cut in two, and
the line model from what recurs on the collection's pages in the middle of running text.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.papers import one_row_per_paper
from quirelight.session import is_blank, materialise

#: Bounds of the training samples: scanned fields, misread words aligned, words cut in two.
TRAIN_FIELDS, TRAIN_WORDS, TRAIN_JOINS = 900, 8000, 6000
#: A line's shape recurs where at least so many fields, and this share of all, have it; it
#: is furniture where it stands inside running text at least this often.
RECURS, RECUR_SHARE, INSIDE = 3, 0.004, 0.5
#: Longest shape that is counted, in tokens.
SHAPE_TOKENS = 14
#: So many words, the commonest, are sent to every task; the rest of the dictionary, the names and
#: the venue words is looked up for every field by joins.
DICTIONARY_LIMIT = 400_000
EPOCHS = 5
BEAM = 60

_LEX, _OWN = "array<struct<asked:string,w:string,name:boolean,venue:boolean>>", "array<struct<w:string,count:bigint>>"

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_HYPHEN = re.compile(r"[^\W\d_][\w’']*[-­‐]$")
_LETTER = re.compile(r"[^\W\d_]")


@functools.lru_cache(maxsize=500_000)
def bare(token: str) -> str:
    """A token in lower case without surrounding punctuation."""
    return _EDGE.sub("", token).lower()


class Perceptron:
    """Multi-class averaged perceptron over string features."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._n = 0
        self.classes: list[str] = []

    def scores(self, feats: list[str]) -> dict[str, float]:
        s: dict[str, float] = {}
        for f in feats:
            for c, v in self.w.get(f, {}).items():
                s[c] = s.get(c, 0.0) + v
        return s

    def best(self, feats: list[str]) -> str:
        if not self.classes:
            return ""  # nothing to learn from
        s = self.scores(feats)
        return max(self.classes, key=lambda c: (s.get(c, 0.0), c))

    def _add(self, f: str, c: str, v: float) -> None:
        row = self.w.setdefault(f, {})
        k = (f, c)
        self._sum[k] += (self._n - self._at[k]) * row.get(c, 0.0)
        self._at[k] = self._n
        row[c] = row.get(c, 0.0) + v

    def train(self, rows: list[tuple[list[str], str]], epochs: int = EPOCHS, seed: int = 7) -> Perceptron:
        rows, rng = list(rows), random.Random(seed)
        self.classes = sorted({y for _, y in rows})
        for _ in range(epochs):
            rng.shuffle(rows)
            for feats, y in rows:
                self._n += 1
                got = self.best(feats)
                if got != y:
                    for f in feats:
                        self._add(f, y, 1.0)
                        self._add(f, got, -1.0)
        for f, row in self.w.items():
            for c in row:
                k = (f, c)
                row[c] = (self._sum[k] + (self._n - self._at[k]) * row[c]) / max(self._n, 1)
        self.w = {f: kept for f, row in self.w.items() if (kept := {c: v for c, v in row.items() if abs(v) > 1e-6})}
        self._sum.clear()
        self._at.clear()
        return self


# --- page furniture ---------------------------------------------------------------------


@functools.lru_cache(maxsize=500_000)
def _shape(token: str) -> str:
    return re.sub(r"\d+", "9", token.lower())


def line_features(lines: list[str], i: int, title: set[str], names: set[str], usual: float, seen: Counter) -> list[str]:
    """What is known of line ``i`` by itself, its page position and its neighbours."""
    s = lines[i].strip()
    toks = s.split()
    letters = [c for c in s if c.isalpha()]
    caps = sum(c.isupper() for c in letters) / max(1, len(letters))
    digits = sum(c.isdigit() for c in s) / max(1, len(s))
    before = next((lines[j].strip() for j in range(i - 1, -1, -1) if lines[j].strip()), "")
    after = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip()), "")
    words = [bare(t) for t in toks]
    in_title = sum(w in title for w in words if w) / max(1, len(words))
    in_names = sum(w in names for w in words if w) / max(1, len(words))
    f = [
        "bias", f"len{min(6, int(5 * len(s) / max(usual, 1)))}", f"n{min(len(toks), 6)}", f"caps{int(caps * 4)}", f"dig{int(digits * 5)}",
        f"title{int(in_title * 4)}", f"names{int(in_names * 4)}", f"end{s[-1:] if not s[-1:].isalnum() else 'w'}",
        f"start{'U' if s[:1].isupper() else 'l' if s[:1].islower() else 'd' if s[:1].isdigit() else s[:1]}",
        f"broken{int(before[-1:] not in '.!?:\"' or before == '')}{int(after[:1].islower())}", f"rep{min(seen[_shape(s)], 2)}",
        f"alone{int(i == 0 or not lines[i - 1].strip())}{int(i + 1 == len(lines) or not lines[i + 1].strip())}",
        f"edge{int(i == 0)}{int(i + 1 == len(lines))}", f"capitals{int(sum(t[:1].isupper() for t in toks) * 4 / max(1, len(toks)))}",
        f"prevlong{int(len(before) > 0.7 * usual)}", f"dots{int(s.endswith('...') or s.endswith('…'))}",
    ]
    f += [f"w={_shape(t)}" for t in toks[:10]]
    f += [f"first={_shape(toks[0])}", f"last={_shape(toks[-1])}"] if toks else []
    f += [f"sym{c}" for c in set(s) & set("©|&[]()—–•§:")]
    f.append("shape=" + re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "9", s)))[:14])
    return f


class Lexicon:
    """What a line's tokens may be: words of the paper's title, names and venue words of the
    collection. A digit inside a word matches any letter."""

    def __init__(self, names: set[str] = frozenset(), venues: set[str] = frozenset()):
        self.names, self.venues, self.literals = names, venues, []
        self.own: dict[str, tuple[str, bool, bool]] = {}  # of the field in hand: what the rest holds
        self._by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(names | venues):
            self._by_length[len(w)].append(w)

    def _like(self, word: str, title: set[str]) -> str:
        """The known word that ``word``, some of its letters misread as digits, may be."""
        if not (re.search(r"\d", word) and _LETTER.search(word)):
            return word
        rule = re.compile(re.sub(r"\d", ".", re.escape(word)))
        first = lambda words: next((w for w in words if rule.fullmatch(w)), None)
        if (w := first(sorted(title))) is not None:
            return w
        here = [w for w in (first(self._by_length.get(len(word), ())), self.own.get(word, (None,))[0]) if w is not None]
        return min(here) if here else first(self.literals) or word

    def answer(self, rows: list) -> None:
        """Take what the rest holds of a field's words: rows ``(asked, w, name, venue)``."""
        self.own = {r[0]: (r[1], r[2], r[3]) for r in rows} | {r[1]: (r[1], r[2], r[3]) for r in rows}

    def _is(self, word: str, kind: int) -> bool:
        return word in (self.names, self.venues)[kind] or (word in self.own and self.own[word][0] == word and self.own[word][1 + kind])

    @staticmethod
    def asks(lines: list[str], title: str) -> set[tuple[str, str | None, str]]:
        """(word, the word with points for digits or None, the digits' places) of all that ``shape`` looks up."""
        out: set[tuple[str, str | None, str]] = {(w, None, "") for w in map(bare, title.split()) if w}
        for tok in " ".join(lines).split():
            w = bare(tok.rstrip("…").rstrip("."))
            if re.search(r"\d", w) and _LETTER.search(w):
                out.add((w, re.sub(r"\d", ".", w), ",".join(str(m.start()) for m in re.finditer(r"\d", w))))
            elif w:
                out.add((w, None, ""))
        return out

    def shape(self, line: str, title: set[str]) -> str:
        """The line with T for words of the title (or the cut beginning of one at its end), N for
        names, V for venue words, 9 for numbers; runs of T and V are one."""
        toks = line.strip().split()
        out: list[str] = []
        for j, tok in enumerate(toks):
            w = bare(tok.rstrip("…").rstrip("."))
            if w and any(c.isdigit() for c in w):
                w = self._like(w, title)
            run = out[-1].rstrip(".,:;…") if out else ""
            cut = bool(w) and j + 1 == len(toks) and (len(w) > 1 or run == "T") and any(t.startswith(w) for t in title)
            kinds = [c for c, ok in (("N", self._is(w, 0)), ("T", w in title or cut), ("V", self._is(w, 1))) if ok] if w else []
            k = run if run in kinds else kinds[0] if kinds else ""  # a run of words of one kind goes on
            end = re.search(r"[.,:;…]*$", tok).group()
            end = "..." if end.endswith(("...", "…")) else end[-1:]
            if k in ("T", "V") and out and out[-1].rstrip(".,:;…") == k:
                out[-1] = k + end
            else:
                out.append(k + end if k else w + end if w in self.literals and w != bare(tok) else _shape(tok))
        return " ".join(out)

    def shapes(self, lines: list[str], title: str) -> dict[int, str]:
        t = {bare(w) for w in title.split()} - {""}
        return {i: self.shape(s, t) for i, s in enumerate(lines) if s.strip()}


def inside_text(lines: list[str], i: int) -> bool:
    """Does running text go on before and after line ``i``?"""
    return 0 < i < len(lines) - 1 and bool(lines[i + 1].strip())


class LineModel:
    """Two passes: the second also sees what the first said of the lines around."""

    def __init__(self, lexicon: Lexicon | None = None) -> None:
        self.one, self.two, self.lexicon = Perceptron(), Perceptron(), lexicon or Lexicon()

    def features(self, lines: list[str], title: str, names: str) -> dict[int, list[str]]:
        full = [i for i, s in enumerate(lines) if s.strip()]
        sizes = sorted(len(lines[i]) for i in full)
        usual = sizes[int(0.8 * (len(sizes) - 1))] if sizes else 1
        seen = Counter(_shape(lines[i].strip()) for i in full)
        t = {bare(w) for w in title.split()} - {""}
        n = {bare(w) for w in names.split()} - {""}
        shapes = {i: self.lexicon.shape(lines[i], t) for i in full}
        out = {}
        for i in full:
            toks = shapes[i].split()
            out[i] = [*line_features(lines, i, t, n, usual, seen), f"shape={shapes[i][:60]}", f"begin={' '.join(toks[:3])}", *(f"a={x}" for x in set(toks[:12]))]
        return out

    @staticmethod
    def _stack(feats: dict[int, list[str]], said: dict[int, str]) -> dict[int, list[str]]:
        order = list(feats)
        out = {}
        for k, i in enumerate(order):
            p = said.get(order[k - 1], "-") if k else "-"
            q = said.get(order[k + 1], "-") if k + 1 < len(order) else "-"
            out[i] = [*feats[i], f"own{said[i]}", f"around{p}{q}", f"own{said[i]}around{p}{q}"]
        return out

    def train(self, pages: list[tuple[list[str], dict[int, str], str, str]]) -> LineModel:
        """``pages``: lines, F or T of the lines that are known, title, names."""
        known = [(self.features(lines, t, n), y) for lines, y, t, n in pages]
        self.one.train([(feats[i], y) for feats, ys in known for i, y in ys.items()])
        rows = []
        for feats, ys in known:
            stacked = self._stack(feats, {i: self.one.best(f) for i, f in feats.items()})
            rows += [(stacked[i], y) for i, y in ys.items()]
        self.two.train(rows)
        return self

    def furniture(self, lines: list[str], title: str, names: str) -> set[int]:
        feats = self.features(lines, title, names)
        said = {i: self.one.best(f) for i, f in feats.items()}
        return {i for i, f in self._stack(feats, said).items() if self.two.best(f) == "F"}


def known_lines(lines: list[str], shapes: dict[int, str], recurring: dict[str, float]) -> dict[int, str]:
    """F or T of the lines whose kind the collection shows: a shape that recurs is furniture
    where it mostly stands inside running text, and text (a heading, a short last line) else;
    a line of its own shape is text where it is as long as most or begins or ends as
    running text does. Other lines are left out."""
    sizes = sorted(len(lines[i]) for i in shapes)
    usual = sizes[int(0.8 * (len(sizes) - 1))] if sizes else 1
    out = {}
    for i, shape in shapes.items():
        s = lines[i].strip()
        if shape in recurring:
            out[i] = "F" if recurring[shape] >= INSIDE else "T"
        elif len(s) >= 0.75 * usual or s[:1].islower() or s[-1:] in ".!?":
            out[i] = "T"
    return out


# --- characters ---------------------------------------------------------------------------


class Counts(dict):
    """Counts of the commonest words, and of those others that the field in hand has (``own``).
    What neither holds is noted in ``asked`` where that is a set."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.own: dict[str, int] = {}
        self.asked: set[str] | None = None

    def __contains__(self, word: object) -> bool:
        if dict.__contains__(self, word) or word in self.own:
            return True
        if self.asked is not None:
            self.asked.add(word)
        return False

    def get(self, word: str, default=None):
        return self[word] if word in self else default

    def __missing__(self, word: str) -> int:
        return self.own[word]


class Dictionary:
    """Known words with their counts, and a search for words that differ at one place."""

    def __init__(self, counts: dict[str, int]):
        self.n = Counts(counts)
        self.forward = sorted(counts)
        self.backward = sorted(w[::-1] for w in counts)

    def __contains__(self, word: str) -> bool:
        return word in self.n

    def known(self, word: str) -> bool:
        if word in self.n:
            return True
        parts = [p for p in re.split(r"[-’']", word) if p]
        return len(parts) > 1 and all(p in self.n for p in parts)

    @staticmethod
    def _starting(words: list[str], head: str) -> list[str]:
        i = bisect.bisect_left(words, head)
        out = []
        while i < len(words) and words[i].startswith(head):
            out.append(words[i])
            i += 1
        return out

    def one_place(self, word: str) -> list[tuple[int, str, str, str]]:
        """(place, misread, right, word) of words that differ in one run of up to two characters."""
        half = max(2, len(word) // 2 - 1)
        near = set(self._starting(self.forward, word[:half])) | {w[::-1] for w in self._starting(self.backward, word[::-1][:half])}
        out = []
        for w in near:
            if abs(len(w) - len(word)) > 1 or w == word:
                continue
            p = 0
            while p < min(len(w), len(word)) and w[p] == word[p]:
                p += 1
            q = 0
            while q < min(len(w), len(word)) - p and w[-1 - q] == word[-1 - q]:
                q += 1
            x, y = word[p : len(word) - q], w[p : len(w) - q]
            if len(x) <= 2 and len(y) <= 2:
                out.append((p, x, y, w))
        return out


def edit_script(word: str, place: int, misread: str, right: str) -> list[str]:
    """One operation per character of the misread word: K keep, R<c> replace, D delete,
    I<c> replace nothing but insert <c> after, X<ab> replace by two characters."""
    ops = ["K"] * len(word)
    if not misread:  # something was lost after the character before
        if place:
            ops[place - 1] = "I" + right
        return ops
    if len(misread) == len(right):
        for i, c in enumerate(right):
            if word[place + i] != c:
                ops[place + i] = "R" + c
    elif len(misread) > len(right):
        for i in range(len(misread)):
            ops[place + i] = "D"
        if right:
            ops[place] = "R" + right if word[place] != right else "K"
    else:
        ops[place] = "X" + right
        for i in range(1, len(misread)):
            ops[place + i] = "D"
    return ops


def char_features(word: str, i: int) -> list[str]:
    w = f"^{word}$"
    k = i + 1
    a, c, b = w[k - 1], w[k], w[k + 1]
    a2, b2 = w[k - 2] if k > 1 else "^", w[k + 2] if k + 2 < len(w) else "$"
    odd = "odd" if c.isdigit() or not c.isascii() else "plain"
    return ["bias", f"c{c}", f"cb{c}{b}", f"ac{a}{c}", f"acb{a}{c}{b}", f"cbb{c}{b}{b2}", f"aac{a2}{a}{c}", odd]


class CharacterEditor:
    """Applies the trained operations to a word by beam search, ending at known words."""

    def __init__(self, model: Perceptron, dictionary: Dictionary, used: Counter):
        self.model, self.words = model, dictionary
        # operations that training saw for a character, so that search stays narrow
        self.ops: dict[str, list[str]] = defaultdict(list)
        for (c, op), n in used.items():
            if n >= 2:
                self.ops[c].append(op)

    def candidates(self, word: str) -> list[tuple[float, str]]:
        beam: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for i, c in enumerate(word):
            s = self.model.scores(char_features(word, i))
            keep = s.get("K", 0.0)
            options = [(0.0, 0, c)]
            for op in self.ops.get(c, ()):
                new = {"R": op[1:], "D": "", "I": c + op[1:], "X": op[1:]}[op[0]]
                options.append((s.get(op, 0.0) - keep, 1, new))
            grown = [(v + dv, n + dn, t + x) for v, n, t in beam for dv, dn, x in options if n + dn <= 4]
            grown.sort(key=lambda g: -g[0])
            # unedited and lightly edited hypotheses survive beside the best
            few = [g for g in grown if g[1] <= 2][:BEAM]
            beam = list(dict.fromkeys([*few, *grown[:BEAM]]))
        return [(v, t) for v, n, t in beam if n and t in self.words.n]

    def repair(self, word: str, floor: float) -> str | None:
        """The known word that ``word`` most likely stands for, or None."""
        got = self.candidates(word)
        if not got:
            return None
        v, w = max(got, key=lambda g: (g[0] + 0.3 * math.log(self.words.n[g[1]]), g[1]))
        return w if v > floor else None


def train_editor(unknown: list[tuple[str, int]], dictionary: Dictionary) -> CharacterEditor:
    """Learn from misread words that differ from exactly one known word at one place.

    The misreadings that recur over many different words are kept; chance neighbours of
    rare words do not recur.
    """
    found = []
    for word, n in unknown:
        if len(word) < 4:
            continue
        hits = dictionary.one_place(word)
        if hits:
            found.append((word, n, hits))
    recur: Counter = Counter()
    for word, _, hits in found:
        if len({(x, y) for _, x, y, _ in hits}) <= 3:
            for x, y in {(x, y) for _, x, y, _ in hits}:
                recur[x, y] += 1
    total = max(1, len(found))
    real = {k for k, n in recur.items() if n >= max(3, 0.0008 * total) and k[0]}
    rows: list[tuple[list[str], str]] = []
    used: Counter = Counter()
    for word, n, hits in found:
        good = [h for h in hits if (h[1], h[2]) in real]
        if not good:
            continue
        p, x, y, _ = max(good, key=lambda h: (recur[h[1], h[2]], dictionary.n[h[3]], h[3]))
        ops = edit_script(word, p, x, y)
        for i, op in enumerate(ops):
            rows.append((char_features(word, i), op))
            used[word[i], op] += op != "K"
    for word in sorted(dictionary.n, key=lambda w: (-dictionary.n[w], w))[:2000]:
        rows += [(char_features(word, i), "K") for i in range(len(word))]
    return CharacterEditor(Perceptron().train(rows, epochs=3), dictionary, +used)


# --- line joins ---


def _times(n: int) -> str:
    return "0" if n <= 0 else "1" if n < 3 else "few" if n < 12 else "many"


def join_features(a: str, b: str, mark: str, count: Callable[[str], int]) -> list[str]:
    """What is known of a word split into ``a`` and ``b`` at a line's end."""
    n, m, x, y = count(a + b), count(f"{a}-{b}"), count(a), count(b)
    more = "more" if n > m else "less" if n < m else "same"
    parts = "".join("w" if v else "-" for v in (x, y))
    return ["bias", f"plain{_times(n)}", f"kept{_times(m)}", f"{_times(n)}{_times(m)}{more}", f"parts{parts}{_times(n)}{_times(m)}", f"parts{parts}{int(len(a) > 3)}{int(len(b) > 3)}",
            f"soft{int(mark == '­')}", f"inner{int('-' in a + b)}{_times(n)}", f"first{_times(x)}", f"second{_times(y)}", f"short{int(len(b) < 4)}{int(len(a) < 3)}"]


def train_joins(counts: dict[str, int]) -> Perceptron:
    """How split words join (J plain, H with the hyphen kept), learned from known words cut
    where a line may cut them: a hyphenated one at its hyphen, any other inside. Each is cut
    as often seen as unseen, for a split word may be one the collection has nowhere else."""
    rng = random.Random(13)
    hyphened = sorted(w for w in counts if 0 < w.find("-") < len(w) - 2)
    plain = sorted(w for w in counts if "-" not in w and len(w) > 5)
    rows: list[tuple[list[str], str]] = []
    for words, y in ((rng.sample(hyphened, min(len(hyphened), TRAIN_JOINS // 2)), "H"), (rng.sample(plain, min(len(plain), TRAIN_JOINS // 2)), "J")):
        for w in words:
            at = w.index("-") if y == "H" else rng.randint(2, len(w) - 2)
            a, b = w[:at], w[at + 1 :] if y == "H" else w[at:]
            for hidden in (False, True):
                held = (lambda x, w=w: 0 if x == w else counts.get(x, 0)) if hidden else (lambda x: counts.get(x, 0))
                rows.append((join_features(a, b, "-", held), y))
    return Perceptron().train(rows)


# --- repair -------------------------------------------------------------------------------


class Repairer:
    """The trained models; finds the damage of a field and rebuilds its paragraphs."""

    def __init__(self, lines: LineModel, editor: CharacterEditor, joins: Perceptron, floor: float = -9.0):
        self.lines, self.editor, self.joins, self.words, self.floor = lines, editor, joins, editor.words, floor

    def answer(self, lex, own) -> None:
        """Take what the rest of names and dictionary holds of the next field's words."""
        self.lines.lexicon.answer(_rows(lex))
        self.words.n.own = dict(_rows(own))

    def _word(self, token: str) -> str | None:
        """The right word for a token, None if it is right already or not repairable."""
        w = bare(token)
        if not w or not _LETTER.search(w) or self.words.known(w) or re.fullmatch(r"p\d+|[a-z]\d{2,}", w):
            return None
        plain = unicodedata.normalize("NFKC", w)
        if plain != w and self.words.known(plain):
            return plain  # joined letters
        if right := self.editor.repair(plain, self.floor):
            return right if right != w else None
        if "-" in w:
            parts = [p if p in self.words or not p else self.editor.repair(p, self.floor) for p in w.split("-")]
            if all(p is not None for p in parts) and "-".join(parts) != w:
                return "-".join(parts)
        return None

    def _join(self, left: str, right: str) -> str:
        """A word split at a line's end: with its own hyphen or without, as the perceptron
        decides, repaired if misread."""
        hyphen = left[-1]
        a, b = _EDGE.sub("", left[:-1]).lower(), _EDGE.sub("", right).lower()
        plain, kept = a + b, f"{a}-{b}"
        op = self.joins.best(join_features(a, b, hyphen, lambda w: self.words.n.get(w, 0)))
        whole = kept if op == "H" else plain
        if whole in self.words or self.words.known(whole):
            return whole
        for word in (whole, plain, kept):
            if got := self._word(word):
                return got
        return whole

    def damage(self, text: str, title: str, names: str) -> tuple[list[tuple[int, str, str]], str]:
        """((line, kind, word) of every damaged place, the repaired text)."""
        lines = text.split("\n")
        out = self.lines.furniture(lines, title, names)
        rows = [(i + 1, "furniture", "") for i in sorted(out)]
        kept = [i for i in range(len(lines)) if i not in out]
        paragraphs: list[list[str]] = [[]]
        carry: str | None = None
        for k, i in enumerate(kept):
            toks = lines[i].split()
            if not toks:
                if paragraphs[-1]:
                    paragraphs.append([])
                carry = None
                continue
            if carry is not None:
                toks[0], carry = carry, None
                first = 1  # repaired with the line before
            else:
                first = 0
            nxt = lines[kept[k + 1]].split() if k + 1 < len(kept) else []
            for j, t in enumerate(toks):
                if j < first:
                    paragraphs[-1].append(t)
                    continue
                if j + 1 == len(toks) and nxt and _HYPHEN.search(t) and _LETTER.match(nxt[0]):
                    word = self._join(t, nxt[0])
                    rows.append((i + 1, "broken", word))
                    head = t[: len(t) - len(t.lstrip("\"'(“«[")) ]
                    tail = nxt[0][len(nxt[0].rstrip(".,;:!?\"')”»]")) :]
                    carry = head + (word.capitalize() if t.lstrip("\"'(“«[")[:1].isupper() else word) + tail
                    continue
                right = self._word(t)
                if right:
                    rows.append((i + 1, "garbled", right))
                    core = _EDGE.sub("", t)
                    shown = right.capitalize() if core[:1].isupper() else right
                    t = t.replace(core, shown, 1)
                paragraphs[-1].append(t)
        return rows, "\n\n".join(" ".join(p) for p in paragraphs if p)


def _tokens(c):
    return F.explode(F.split(F.lower(c), r"\s+"))


def build(contexts: DataFrame, papers: DataFrame) -> tuple[Repairer, DataFrame]:
    """Train the models on the collection; also the distinct scanned fields to repair.

    The dictionary counts every word of all clean texts (a partial aggregate); words seen
    once are left out. Of more than ``DICTIONARY_LIMIT`` words the rarest are not sent to every
    task but joined to the fields that ask for them; so are names and venue words. The editor and
    the joins are trained on the commonest. Misread words are counted over all scanned texts; the commonest ``TRAIN_WORDS`` train the editor. Shapes of
    lines are counted over all scanned fields; the first ``TRAIN_FIELDS`` of them by hash train
    the line model.
    """
    spark = contexts.sparkSession
    one = materialise(one_row_per_paper(papers, "title", "abstract", "authors", "venue"), "works")
    scanned = contexts.where("pdf_extract_method = 'ocr' and paper_id is not null")
    fields = None
    for name in ("extracted_context", "discussion_full"):
        part = scanned.select("paper_id", F.lit(name).alias("field_name"), F.col(name).alias("text")).where(~is_blank(F.col(name)))
        fields = part if fields is None else fields.unionByName(part)
    fields = materialise(fields.distinct(), "fields")
    clean = contexts.where("coalesce(pdf_extract_method, '') not in ('ocr', 'failed')")
    texts = clean.select(F.col("extracted_context").alias("t")).unionByName(clean.select(F.col("discussion_full").alias("t"))).unionByName(one.select(F.col("abstract").alias("t"))).unionByName(one.select(F.col("title").alias("t"))).unionByName(one.select(F.regexp_replace("authors", "[,;.]", " ").alias("t")))
    stripped = F.regexp_replace(F.col("w"), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    known = texts.where("t is not null").select(_tokens(F.col("t")).alias("w")).select(stripped.alias("w")).where(F.col("w").rlike(r"\p{L}")).groupBy("w").count().where("count > 1")
    known = materialise(known, "dictionary")
    words, rest = _commonest(known)
    dictionary = Dictionary(words)
    lines = fields.select(F.explode(F.split("text", "\n")).alias("l"))
    seen = lines.where(~F.col("l").rlike(r"[-­]\s*$")).select(_tokens(F.col("l")).alias("w")).select(stripped.alias("w")).where(F.col("w").rlike(r"\p{L}") & (F.length("w") > 3)).groupBy("w").count()
    # the anti-join may broadcast the dictionary only under Spark's size limit
    strange = seen.join(known.select("w"), "w", "left_anti").orderBy(F.desc("count"), "w").limit(TRAIN_WORDS).collect()
    editor = train_editor([(r["w"], r["count"]) for r in strange], dictionary)
    fields = fields.join(one.select("paper_id", "title", "authors", "venue"), "paper_id", "left")
    (names, more_names), (venues, more_venues) = (_commonest(_words_of(one, c, least)) for c, least in (("authors", 3), ("venue", 1)))
    lexicon = Lexicon(set(names), set(venues))
    fields = fields.withColumn("lex", F.lit(None).cast(_LEX)).withColumn("own", F.lit(None).cast(_OWN))
    if more_names is not None or more_venues is not None:
        fields = _with_lexicon(fields, more_names, more_venues)
    shared = spark.sparkContext.broadcast(lexicon)

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, list[int]] = {}
        for pdf in batches:
            for text, title, lex in zip(pdf["text"], pdf["title"], pdf["lex"]):
                ls = text.split("\n")
                shared.value.answer(_rows(lex))
                mine = shared.value.shapes(ls, title or "")
                for i, shape in mine.items():
                    if shape.count(" ") < SHAPE_TOKENS:
                        row = got.setdefault(shape, [0, 0, 0])
                        row[1] += 1
                        row[2] += inside_text(ls, i)
                for shape in set(mine.values()):
                    if shape in got:
                        got[shape][0] += 1
        yield pd.DataFrame([(k, *v) for k, v in got.items()], columns=["shape", "fields", "lines", "inside"])

    stats = fields.select("text", "title", "lex").mapInPandas(shapes, "shape string, fields long, lines long, inside long").groupBy("shape").agg(*[F.sum(c).alias(c) for c in ("fields", "lines", "inside")])
    least = max(RECURS, math.ceil(RECUR_SHARE * fields.count()))
    # every field has its own lines only, so at most (lines of a field) / RECUR_SHARE shapes recur
    recurring = {r["shape"]: r["inside"] / r["lines"] for r in stats.where(F.col("fields") >= least).toLocalIterator()}
    lexicon.literals = sorted({w for k, v in recurring.items() if v >= INSIDE for w in re.findall(r"[^\W\d_]+", k) if w not in ("T", "N", "V")})
    sample = fields.orderBy(F.xxhash64("paper_id", "field_name"), "paper_id", "field_name").limit(TRAIN_FIELDS).collect()
    pages = []
    lexicon.answer([x for r in sample for x in _rows(r["lex"])])
    for r in sample:
        ls, title = r["text"].split("\n"), r["title"] or ""
        pages.append((ls, known_lines(ls, lexicon.shapes(ls, title), recurring), title, f"{r['authors'] or ''} {r['venue'] or ''}"))
    repairer = Repairer(LineModel(lexicon).train(pages), editor, train_joins(words))
    lexicon.answer([])
    return repairer, fields if rest is None else _with_own(fields, repairer, rest)


def _rows(cells) -> list[tuple]:
    return [] if cells is None else [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in cells]


def _with_lexicon(fields: DataFrame, names: DataFrame | None, venues: DataFrame | None) -> DataFrame:
    """``fields`` with ``lex``: what names and venue words beyond the commonest say of their words.
    A word with misread digits gets the least word that it may be; words and digits' places are
    equal in a join, so no word of the rest is held against all fields."""
    parts = [d.select("w", F.lit(d is names).alias("name"), F.lit(d is venues).alias("venue")) for d in (names, venues) if d is not None]
    rest = functools.reduce(DataFrame.unionByName, parts).groupBy("w").agg(F.max("name").alias("name"), F.max("venue").alias("venue"))
    rest = materialise(rest, "rare-names")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, *x) for p, f, text, title in zip(pdf["paper_id"], pdf["field_name"], pdf["text"], pdf["title"]) for x in Lexicon.asks(text.split("\n"), title or "")]
            yield pd.DataFrame(rows, columns=["paper_id", "field_name", "asked", "like", "places"], dtype=object)

    asked = materialise(fields.select("paper_id", "field_name", "text", "title").mapInPandas(ask, "paper_id string, field_name string, asked string, like string, places string").distinct(), "asked-names")
    plain = asked.where("like is null").select("asked").distinct().join(rest, F.col("asked") == F.col("w")).select("asked", "w", "name", "venue")
    odd = asked.where("like is not null").select("asked", "like", "places", F.length("like").alias("long")).distinct()
    hidden = F.expr("array_join(transform(split(w, ''), (c, i) -> if(array_contains(split(places, ','), cast(i as string)), '.', c)), '')")
    pointed = odd.select("places", "long").distinct().join(rest, F.col("long") == F.length("w")).withColumn("like", hidden).select("places", "like", "w", "name", "venue")
    alike = odd.join(pointed, ["places", "like"]).groupBy("asked").agg(F.min(F.struct("w", "name", "venue")).alias("m")).select("asked", "m.w", "m.name", "m.venue")
    told = asked.select("paper_id", "field_name", "asked").join(plain.unionByName(alike), "asked")
    told = told.groupBy("paper_id", "field_name").agg(F.collect_list(F.struct("asked", "w", "name", "venue")).alias("lex"))
    return materialise(fields.drop("lex").join(told, ["paper_id", "field_name"], "left"), "fields-names")


def _with_own(fields: DataFrame, repairer: Repairer, rest: DataFrame) -> DataFrame:
    """``fields`` with ``own``: the words beyond the commonest that their repair looks up.

    What a repair asks depends on what it is told, so it is asked again until the dictionary
    has nothing more to tell; then every answer is that of the whole dictionary.
    """
    shared = fields.sparkSession.sparkContext.broadcast(repairer)
    told, n = None, 0
    keys = ["paper_id", "field_name"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            rows = []
            for p, f, text, lex, own, (title, names) in zip(pdf["paper_id"], pdf["field_name"], pdf["text"], pdf["lex"], pdf["own"], _names(pdf)):
                r.answer(lex, own)
                r.words.n.asked = set()
                r.damage(text, title, names)
                rows += [(p, f, w) for w in r.words.n.asked]
                r.words.n.asked = None
            yield pd.DataFrame(rows, columns=["paper_id", "field_name", "w"], dtype=object)

    while True:
        new = fields.mapInPandas(ask, "paper_id string, field_name string, w string").distinct().join(rest, "w").select(*keys, "w", "count")
        told = materialise(new if told is None else told.unionByName(new).distinct(), "rare-words")
        if (now := told.count()) == n:
            return fields
        n = now
        own = told.groupBy(*keys).agg(F.collect_list(F.struct("w", "count")).alias("own"))
        fields = materialise(fields.drop("own").join(own, keys, "left"), "fields-words")


def _commonest(words: DataFrame) -> tuple[dict[str, int], DataFrame | None]:
    """The commonest ``DICTIONARY_LIMIT`` of ``w, count``; the others, None if there are none."""
    held = {r["w"]: r["count"] for r in words.orderBy(F.desc("count"), "w").limit(DICTIONARY_LIMIT + 1).toLocalIterator()}
    if len(held) <= DICTIONARY_LIMIT:
        return held, None
    w, n = held.popitem()
    return held, materialise(words.where((F.col("count") < n) | ((F.col("count") == n) & (F.col("w") >= w))), "rare")


def _words_of(papers: DataFrame, column: str, least: int) -> DataFrame:
    """``w, count`` of the words of a column."""
    w = papers.where(F.col(column).isNotNull()).select(F.explode(F.split(F.lower(column), r"[\s,;]+")).alias("w"))
    w = w.select(F.regexp_replace("w", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "").alias("w")).where(F.length("w") >= least)
    return w.groupBy("w").count()


def _names(pdf: pd.DataFrame) -> Iterator[tuple[str, str]]:
    for t, a, v in zip(pdf["title"], pdf["authors"], pdf["venue"]):
        yield (t or ""), f"{a or ''} {v or ''}"


def damaged_places(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """Every damaged place of the scanned papers: ``paper_id, field_name, line_no, kind, word``.

    Kinds: ``furniture`` (a page number, running head or notice; no word), ``broken`` (a word
    split over a line end) and ``garbled`` (a misread word). Equal rows count once; blank
    fields have none. The models are a few MB and bounded by their parameters, so they are
    sent to every task; fields are repaired where they lie, without a further shuffle.
    """
    repairer, fields = build(contexts, papers)
    shared = contexts.sparkSession.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            rows = []
            for p, f, text, lex, own, (title, names) in zip(pdf["paper_id"], pdf["field_name"], pdf["text"], pdf["lex"], pdf["own"], _names(pdf)):
                r.answer(lex, own)
                rows += [(p, f, *x) for x in dict.fromkeys(r.damage(text, title, names)[0])]
            yield pd.DataFrame(rows, columns=["paper_id", "field_name", "line_no", "kind", "word"])

    return fields.mapInPandas(run, "paper_id string, field_name string, line_no int, kind string, word string").distinct()


def repaired_texts(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """``paper_id, field_name, text``: readable paragraphs, a blank line between them."""
    repairer, fields = build(contexts, papers)
    shared = contexts.sparkSession.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            texts = []
            for t, lex, own, (a, b) in zip(pdf["text"], pdf["lex"], pdf["own"], _names(pdf)):
                r.answer(lex, own)
                texts.append(r.damage(t, a, b)[1])
            yield pd.DataFrame({"paper_id": pdf["paper_id"], "field_name": pdf["field_name"], "text": texts})

    return fields.mapInPandas(run, "paper_id string, field_name string, text string")
