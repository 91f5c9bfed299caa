"""Problem 10: keyword-stuffed pages, link lists and tag lists among ordinary texts."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.session import materialise

#: Characters a block holds at most; every block of a text is measured.
BLOCK = 4096
#: A text is extremely redundant below this share of the ratio usual at its length and language.
REDUNDANT = 0.905
#: Below this length class (some 90 bytes) compression says nothing of redundancy.
SHORTEST = 13
#: Share of a text's words that may stand in sentences before it counts as prose.
PROSE = 0.5
#: The same for a text with hardly a sentence.
BARE, BARE_PROSE = 0.96, 0.4
#: Repetition so extreme that short exclamations around a keyword do not count as prose.
EXTREME, EXTREME_PROSE = 0.6, 0.8
#: Length classes are powers of this many bytes.
STEP = math.sqrt(2.0)

_SCRIPTS = [("th", re.compile("[฀-๿]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")),
            ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]"))]
# Commonest function words by which the Latin-script languages are told apart.
_FUNCTION_WORDS = {
    "en": "the of and to in that is with for were before a",
    "de": "der die das und ist ein eine mit den von für nicht als wie auch bei sich",
    "fr": "le les des du et est dans pour nous sur au cette cet vaut mais la que",
    "es": "el los las y es en para con del una como cómo más sobre sin la que",
}
_LATIN = {w: [k for k, ws in _FUNCTION_WORDS.items() if w in ws.split()] for ws in _FUNCTION_WORDS.values() for w in ws.split()}
_WORD = re.compile(r"[^\W\d_]+")
# words with the vowel signs and marks of Arabic and Indic scripts
_UNIT = re.compile(r"https?://\S+|<[^>]*>|(?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0dff])+")
_STOPPED = re.compile(r"[.!?।؟][\"'”»)\]]*$")
_ENDS = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+|(?<=[。！？।؟])[」』”]?\s*|\n+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


def language_of(text: str) -> str:
    """A coarse language from script and function words; the dirty column is not used."""
    if not text.isascii():
        for name, seen in _SCRIPTS:
            if seen.search(text):
                return name
    votes: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        for k in _LATIN.get(w, ()):
            votes[k] = votes.get(k, 0) + 1
    return max(votes, key=lambda k: (votes[k], k)) if votes else "none"


def block_ratio(text: str) -> tuple[float, int]:
    """Compressed bytes per byte, by blocks, and the usual block length in bytes."""
    n = z = blocks = 0
    for i in range(0, len(text), BLOCK):
        raw = text[i : i + BLOCK].encode()
        n += len(raw)
        z += max(1, len(zlib.compress(raw, 6)) - 8)
        blocks += 1
    return (z / n, n // blocks) if n else (1.0, 0)


def prose_share(text: str, language: str) -> float:
    """Share of the words (characters in scripts without spaces) that stand in sentences.

    A sentence ends in sentence punctuation and has at least four words of which most
    differ; one that was there before does not count again. In Thai, which has none, it is a run of twenty letters without a space.
    """
    if language == "th":
        runs = [len(x) for x in re.split(r"[\s,|#\-–;/*]+", text) if x]
        return sum(r for r in runs if r >= 20) / max(1, sum(runs))
    inside = total = 0
    seen: set[str] = set()
    for part in _ENDS.split(text):
        part = part.strip()
        if not part:
            continue
        if language in ("zh", "ja"):
            n = len(part)
            good = part[-1] in "。！？」』”" and n >= 8 and part not in seen and len(re.split(r"[、，,|#\s\-]+", part)) <= 1 + n / 6
        else:
            units = [u.lower() for u in _UNIT.findall(part)]
            n = len(units)
            good = _STOPPED.search(part) is not None and n >= 4 and part not in seen and len(set(units)) >= 0.6 * n and not any(u.startswith(("http", "<")) for u in units[: n // 2 + 1])
        seen.add(part)
        total += n
        inside += n * good
    return inside / total if total else 0.0


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for k, text in zip(pdf["_k"], pdf["_t"]):
            lang = language_of(text)
            ratio, size = block_ratio(text)
            rows.append((k, lang, int(math.log(max(size, 1), STEP)), ratio, prose_share(text, lang)))
        yield pd.DataFrame(rows, columns=["_k", "language", "length_class", "ratio", "prose"])


def redundancy(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text: language, length class, compression ratio, share of prose and
    ``relative``, the ratio over the usual one (the 0.6 quantile) of its language and length class.

    The usual ratios come from all texts. A class of fewer than 20 texts, and texts without
    any function word, take the usual ratio of the
    length class over all languages of the same kind of script (spaced or not). Null and
    empty texts get no row. Only a few numbers per text leave the first stage.
    """
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null and length(trim(_t)) > 0 and _k is not null")
    schema = f"_k {src.schema['_k'].dataType.simpleString()}, language string, length_class int, ratio double, prose double"
    m = materialise(src.mapInPandas(_measure, schema), "redundancy")
    m = m.withColumn("_s", F.when(F.col("language").isin("en", "de", "fr", "es", "none"), F.lit("latin")).otherwise(F.col("language")))
    usual = F.percentile_approx("ratio", 0.6, 2000)
    fine = m.groupBy("language", "length_class").agg(usual.alias("_f"), F.count(F.lit(1)).alias("_n"))
    coarse = m.groupBy("_s", "length_class").agg(usual.alias("_c"))
    # one row per language and length class: fewer than 20 languages times 100 classes
    out = m.join(F.broadcast(fine), ["language", "length_class"]).join(F.broadcast(coarse), ["_s", "length_class"])
    base = F.when((F.col("_n") >= 20) & (F.col("language") != "none"), F.col("_f")).otherwise(F.col("_c"))
    return out.select(F.col("_k").alias(key), "language", "length_class", "ratio", (F.col("ratio") / base).alias("relative"), "prose")


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", *, redundant: float = REDUNDANT, prose: float = PROSE) -> DataFrame:
    """Rows of :func:`redundancy` that are redundant and mostly not sentences, or repeat
    one phrase so often that only short exclamations surround it. Texts too short to
    compress are never flagged."""
    r, p = F.col("relative"), F.col("prose")
    return redundancy(docs, key, text).where((F.col("length_class") >= SHORTEST) & (((r < redundant) & (p < prose)) | ((r < BARE) & (p < BARE_PROSE)) | ((r < EXTREME) & (p < EXTREME_PROSE))))
