"""Problem 8: held-out test items that leaked into a training corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.session import materialise

#: Fixed masks over consecutive words: 1 must agree, 0 may be any word.
MASKS = ("11111", "110111", "111011", "1101101", "1011011")
#: A passage must have this many words and this share of its item.
MIN_WORDS, MIN_SHARE = 15, 1 / 3
#: What a differing word costs against an agreeing one when passages are extended.
MISMATCH = 4
#: Up to this many (mask, window) entries the items' index is copied to every task.
INDEX_LIMIT = 2_000_000

# scripts without spaces: every character is a word
_UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff"
_CJK = re.compile(f"([{_UNSPACED}])")


class _DropMarks(dict):
    """Translation table: letters and digits stay, white space splits, all else vanishes."""

    def __missing__(self, c: int):
        ch = chr(c)
        out = ch if ch.isalnum() else (" " if ch.isspace() else None)
        self[c] = out
        return out


_TABLE = _DropMarks()


def plain_words(text: str) -> list[str]:
    """Words without case, accents, punctuation and line marks; an unspaced script's
    characters are words of their own."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        t = _CJK.sub(r" \1 ", t)
    return t.translate(_TABLE).split()


def _window_codes(ids: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, code) of every window whose masked words are all known (id > 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.full(n, salt, np.int64)
    known = np.ones(n, bool)
    for i, bit in enumerate(mask):
        if bit == "1":
            w = ids[i : i + n]
            known &= w > 0
            code = code * np.int64(0x100000001B3) + w * np.int64(0x9E3779B1)
    at = np.flatnonzero(known)
    return at, code[at]


class ItemIndex:
    """Spaced-seed index of the items: sorted codes with (item, position), and their words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        codes, owners, places = [], [], []
        for item, text in items:
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)), np.int64)
            k = len(self.items)
            self.items.append((item, ids))
            if len(ids) < MIN_WORDS:
                continue
            for m, mask in enumerate(MASKS):
                at, code = _window_codes(ids, mask, m + 1)
                codes.append(code)
                owners.append(np.full(len(at), k))
                places.append(at)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.codes = code[order]
        self.owner = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> dict[int, set[int]]:
        """item number -> diagonals (document position minus item position) with a seed hit."""
        found: dict[int, set[int]] = {}
        if len(self.codes) == 0 or np.count_nonzero(ids) < 5:
            return found
        for m, mask in enumerate(MASKS):
            at, code = _window_codes(ids, mask, m + 1)
            if len(at) == 0:
                continue
            lo = np.searchsorted(self.codes, code, "left")
            hi = np.searchsorted(self.codes, code, "right")
            for j in np.flatnonzero(hi > lo):
                for x in range(lo[j], hi[j]):
                    found.setdefault(int(self.owner[x]), set()).add(int(at[j]) - int(self.place[x]))
        return found


def best_passage(doc: np.ndarray, item: np.ndarray, diagonals: set[int]) -> tuple[int, int, int]:
    """(words, agreeing words, item start) of the best substitution-tolerant overlap.

    Neighbouring seeded diagonals (a word split or joined) are followed together. Unknown
    words (id 0) never agree.
    """
    best = (0, 0, 0)
    groups: list[list[int]] = []
    for d in sorted(diagonals):
        if groups and d - groups[-1][-1] <= 2:
            groups[-1].append(d)
        else:
            groups.append([d])
    n = len(item)
    for g in groups:
        same = np.zeros(n, bool)
        for d in g:
            a, b = max(0, -d), min(n, len(doc) - d)
            if b > a:
                same[a:b] |= doc[a + d : b + d] == item[a:b]
        if 2 * np.count_nonzero(same) <= min(MIN_WORDS, n) or np.count_nonzero(same) <= best[1]:
            continue
        run = start = top = 0
        span = (0, 0)
        for i in range(n):
            run += 1 if same[i] else -MISMATCH
            if run <= 0:
                run, start = 0, i + 1
            elif run > top:
                top, span = run, (start, i + 1)
        words, agree = span[1] - span[0], int(same[span[0] : span[1]].sum())
        if agree > best[1]:
            best = (words, agree, span[0])
    return best


def is_leak(words: int, item_words: int, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> bool:
    """Long enough; an end word lost to a substitution is allowed for."""
    return words + 1 > max(min_words, min_share * item_words)


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 index_limit: int = INDEX_LIMIT) -> DataFrame:
    """Each document with each item of which it holds a passage.

    Columns: ``item_id, doc_id, words`` (length of the passage in item words), ``agree``
    (words that are the same), ``item_words``. Null texts hold nothing; items under 15 words
    cannot leak by the definition; a repeated item id is read once per distinct text.

    Test and training windows meet on their spaced-seed codes. While the items' index has at
    most ``index_limit`` entries it goes to every task and the corpus is only scanned: no
    shuffle. A larger index is joined by a shuffle on the codes, and the documents that hit
    are read again for the verification. Whole texts are scanned either way.
    """
    spark = docs.sparkSession
    d = docs.where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_t"))
    i = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("_i"), F.col(item_text).alias("_x")).distinct()
    kd, ki = d.schema["_d"].dataType.simpleString(), i.schema["_i"].dataType.simpleString()
    schema = f"_i {ki}, _d {kd}, words int, agree int, item_words int"
    # at most one window a word and mask; in scripts without spaces a character is a word
    size = F.when(F.col("_x").rlike(f"[{_UNSPACED}]"), F.length("_x")).otherwise(F.size(F.split("_x", r"\s+")))
    entries = (i.select(F.sum(size)).first()[0] or 0) * len(MASKS)
    if entries <= index_limit:
        index = ItemIndex([(r["_i"], r["_x"]) for r in i.orderBy("_i", "_x").collect()])
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = shared.value
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["_d"], pdf["_t"]):
                    ids = ix.ids(plain_words(text))
                    for k, diagonals in ix.hits(ids).items():
                        item, own = ix.items[k]
                        words, agree, _ = best_passage(ids, own, diagonals)
                        if is_leak(words, len(own)):
                            rows.append((item, doc, words, agree, len(own)))
                yield pd.DataFrame(rows, columns=["_i", "_d", "words", "agree", "item_words"])

        found = d.mapInPandas(scan, schema)
    else:
        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keys, codes = [], []
                for key, text in zip(pdf["_k"], pdf["_t"]):
                    ids = np.fromiter((hash_word(w) for w in plain_words(text)), np.int64)
                    got = np.unique(np.concatenate([_window_codes(ids, m, s + 1)[1] for s, m in enumerate(MASKS)]))
                    keys += [key] * len(got)
                    codes.append(got)
                yield pd.DataFrame({"_k": keys, "code": np.concatenate(codes) if codes else np.zeros(0, np.int64)})

        dw = d.select(F.col("_d").alias("_k"), "_t").mapInPandas(windows, f"_k {kd}, code long").withColumnRenamed("_k", "_d")
        iw = i.select(F.col("_i").alias("_k"), F.col("_x").alias("_t")).mapInPandas(windows, f"_k {ki}, code long").withColumnRenamed("_k", "_i")
        pairs = materialise(dw.join(iw, "code").select("_d", "_i").distinct(), "leak-candidates")

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for item, doc, text, x in zip(pdf["_i"], pdf["_d"], pdf["_t"], pdf["_x"]):
                    ix = ItemIndex([(item, x)])
                    ids, own = ix.ids(plain_words(text)), ix.items[0][1]
                    for _, diagonals in ix.hits(ids).items():
                        words, agree, _s = best_passage(ids, own, diagonals)
                        if is_leak(words, len(own)):
                            rows.append((item, doc, words, agree, len(own)))
                yield pd.DataFrame(rows, columns=["_i", "_d", "words", "agree", "item_words"])

        found = pairs.join(d, "_d").join(i, "_i").mapInPandas(verify, schema)
    best = F.max(F.struct("agree", "words", "item_words"))
    out = found.groupBy("_i", "_d").agg(best.alias("_b"))
    return out.select(F.col("_i").alias("item_id"), F.col("_d").alias("doc_id"), F.col("_b.words").alias("words"), F.col("_b.agree").alias("agree"), F.col("_b.item_words").alias("item_words"))


def hash_word(word: str) -> int:
    """A positive 62-bit code of a word, the same on every machine."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") >> 2 | 1
