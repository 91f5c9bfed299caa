"""Problem 3: near-duplicate records with small edits, insertions or reordering."""

from __future__ import annotations

import bisect
import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.papers import one_row_per_paper
from quirelight.session import forget, is_blank
from quirelight.session import materialise as _materialise

#: Words of a k-mer, k-mers of a sketch that keep their text order, sketches of a record.
K, KEEP, SKETCHES = 3, 2, 64
#: A k-mer is frequent from this many records on, or as the record count demands (below).
FREQUENT = 30
#: The list of frequent k-mers never holds more entries than this.
FREQUENT_LIMIT = 1_000_000
#: Classes that may share a sketch; a sketch of more is left to the exact prefixes.
CROWD = 64
#: Bits of the largest table of how common k-mers are (32 MB), and of one block of it.
TABLE_BITS, BLOCK_BITS = 25, 16
#: Pairs a class that are verified at once: their texts are on the disk together.
AT_ONCE = 2

materialise = functools.partial(_materialise, lean=True)
_RUN = re.compile(r"[^\W_]+")
_U64 = np.uint64


def _words(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); wraps."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _word_codes(words: list[str], held: dict[str, int]) -> np.ndarray:
    for w in words:
        if w not in held:
            if len(held) > 100_000:
                held.clear()
            b = w.encode()
            held[w] = (zlib.crc32(b) << 32) | zlib.crc32(b[::-1], 0x9E3779B9)
    return np.fromiter((held[w] for w in words), _U64, len(words))


def kmer_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit code per run of ``k`` words; a shorter text is one run of all it has."""
    if len(codes) == 0:
        return codes
    k = min(k, len(codes))
    out = np.zeros(len(codes) - k + 1, _U64)
    for i in range(k):
        out = _mix(out * _U64(0x9E3779B97F4A7C15) + codes[i : len(codes) - k + 1 + i])
    return out


def _occurrence(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer stood before, so that repeats are told apart."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    start = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(len(s))
    n = np.empty(len(s), np.int64)
    n[order] = at - np.maximum.accumulate(np.where(start, at, 0))
    return n


def order_min_hash(kmers: np.ndarray, frequent: np.ndarray, keep: int, sketches: int) -> np.ndarray:
    """Order MinHash: per sketch one code of the ``keep`` least occurrence-labelled k-mers
    in the order in which they stand in the text.

    Frequent k-mers come last in every order: they enter a sketch only when the record has
    too few others, so a phrase of the whole collection does not make records candidates.
    """
    if len(kmers) == 0:
        return np.zeros(0, _U64)
    label = _mix(kmers + _U64(0xD1B54A32D192ED03) * _occurrence(kmers).astype(_U64))
    late = _U64(1 << 63) * frequent.astype(_U64)
    seeds = _mix(np.arange(1, sketches + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
    keep = min(keep, len(kmers))
    out = np.empty(sketches, _U64)
    step = max(1, 2_000_000 // len(kmers))  # a very long text is sketched in slices of the orders
    for i in range(0, sketches, step):
        s = seeds[i : i + step]
        h = (_mix(label[None, :] ^ s[:, None]) >> _U64(1)) | late[None, :]
        at = np.sort(np.argpartition(h, keep - 1, axis=1)[:, :keep], axis=1)
        code = s.copy()
        for j in range(keep):
            code = _mix(code * _U64(0x9E3779B97F4A7C15) + label[at[:, j]])
        out[i : i + step] = code
    return out


def aligned_bands(a: list[str], b: list[str], k: int = K, width: int = 8) -> tuple[int, int, int, int]:
    """(distinct k-mers aligned, distinct k-mers in either, bands, k-mers in the main band).

    The k-mers of ``a`` are aligned with their places in ``b`` along the diagonal last used, in
    bands of ``width`` neighbouring diagonals: an insertion shifts the rest into the next
    band, a moved passage gives a band of its own. What the bands cover together decides a
    pair; it is the whole overlap, since a k-mer of both texts lies in some band.
    """
    ka = [tuple(a[i : i + k]) for i in range(len(a) - k + 1)]
    kb = [tuple(b[i : i + k]) for i in range(len(b) - k + 1)]
    where: dict[tuple, list[int]] = {}
    for j, x in enumerate(kb):
        where.setdefault(x, []).append(j)
    bands: dict[int, set[tuple]] = {}
    last = 0
    for i, x in enumerate(ka):
        places = where.get(x)
        if places:
            at = bisect.bisect_left(places, i + last)
            near = places[max(0, at - 1) : at + 1]
            last = min((j - i for j in near), key=lambda v: (abs(v - last), v))
            bands.setdefault(last // width, set()).add(x)
    covered: set[tuple] = set().union(*bands.values())
    return len(covered), len(set(ka)) + len(where) - len(covered), len(bands), max((len(v) for v in bands.values()), default=0)


def commonness(counted: DataFrame) -> np.ndarray:
    """How common k-mers are: a byte for each bucket of codes, 0 where none is in two classes.

    ``counted``: ``code, n`` of codes in two classes or more. A bucket has four times the
    binary logarithm of its commonest code's count. At most 32 MB, whatever the collection:
    with very many codes some rare ones share a bucket with a commoner one and count as that.
    """
    bits = int(min(TABLE_BITS, max(BLOCK_BITS, int(8 * counted.count()).bit_length())))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << BLOCK_BITS, np.uint8)
        np.maximum.at(out, pdf["code"].to_numpy() & ((1 << BLOCK_BITS) - 1), np.round(4 * np.log2(pdf["n"].to_numpy())).astype(np.uint8))
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "v": [out.tobytes()]})

    table = np.zeros(1 << bits, np.uint8)
    which = F.shiftright(F.col("code").bitwiseAND(F.lit((1 << bits) - 1)), BLOCK_BITS).cast("int")
    for r in counted.withColumn("i", which).groupBy("i").applyInPandas(block, "i int, v binary").toLocalIterator():
        table[r["i"] << BLOCK_BITS : (r["i"] + 1) << BLOCK_BITS] = np.frombuffer(bytes(r["v"]), np.uint8)
    return table


def prefix(codes: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a class's prefix that other classes may have, and their places in its order.

    All codes are ordered by ``table`` (the rarest first), equally common ones by a mixed
    code: one order for all classes, which is all that ``prefix_pairs`` needs. Codes of no
    other class come first and hold their places.
    """
    how = table[codes.view(np.int64) & (len(table) - 1)]
    order = np.lexsort((_mix(codes), how))
    places = np.arange(np.count_nonzero(how == 0), len(codes) - int(np.ceil(len(codes) * threshold - 1e-9)) + 1)
    return codes[order[places]], places


def prefix_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """(``a``, ``b``): a superset of the pairs at least ``threshold`` alike.

    ``placed``: ``no, size, code, pos``, the codes of each class's ``prefix``. Of two classes
    so alike, one of the first ``size - ceil(threshold * size) + 1`` codes of each is common to
    both, and at their first common code enough codes follow in both to reach the overlap
    needed. So no k-mer is left out for being frequent, and a phrase of the collection pairs
    only classes that are made of such phrases for the greater part.
    """
    rest = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    enough = rest >= (F.col("a.size") + F.col("b.size")) * (threshold / (1 + threshold)) - 1e-9
    return (placed.alias("a").join(placed.alias("b"), "code").where((F.col("a.no") < F.col("b.no")) & enough)
            .select(F.col("a.no").alias("a"), F.col("b.no").alias("b")).distinct())


def sketch_pairs(marks: DataFrame, threshold: float) -> DataFrame:
    """(``a``, ``b``): classes with a common sketch and sizes that allow for the threshold.

    ``marks``: ``sketch, no, size``. One shuffle; each task walks along its sorted sketches.
    A sketch of more than ``CROWD`` classes would give all their pairs; it gives none, and
    ``prefix_pairs`` has those alike.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None  # the last sketch, which the next batch may go on with
        for pdf in batches:
            if left is not None:
                pdf = pd.concat([left, pdf], ignore_index=True)
            s, no, size = (pdf[c].to_numpy() for c in ("sketch", "no", "size"))
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            if len(start) == 0:
                continue
            left = pdf.iloc[start[-1] :][: CROWD + 1]  # of a crowded one no more is needed
            yield _within(no, size, start, np.diff(start), threshold)
        if left is not None:
            yield _within(left["no"].to_numpy(), left["size"].to_numpy(), np.zeros(1, np.int64), np.array([len(left)]), threshold)

    placed = marks.repartition("sketch").sortWithinPartitions("sketch", "no")
    return placed.mapInPandas(walk, "a long, b long").distinct()


def _within(no: np.ndarray, size: np.ndarray, start: np.ndarray, length: np.ndarray, threshold: float) -> pd.DataFrame:
    """All pairs of the runs of two to ``CROWD`` rows whose sizes allow for the threshold."""
    a, b = [], []
    for n in np.unique(length[(length > 1) & (length <= CROWD)]):
        i, j = np.triu_indices(n, 1)
        at = start[: len(length)][length == n][:, None]
        x, y = (at + i).ravel(), (at + j).ravel()
        ok = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
        a.append(np.minimum(no[x], no[y])[ok])
        b.append(np.maximum(no[x], no[y])[ok])
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.concatenate(a or [none]), "b": np.concatenate(b or [none])}).drop_duplicates()


def near_duplicates(records: DataFrame, key: str, text: str, *, threshold: float = 0.5, k: int = K, keep: int = KEEP, sketches: int = SKETCHES, spent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of text classes at least ``threshold`` alike, and who is in them.

    ``members``: ``key``, ``class_id``, ``copies``. Records with the same words form one class
    whose id is its least key. ``links``: ``class_a < class_b``, ``similarity`` (shared distinct
    runs of ``k`` words over those of either), ``bands`` and ``main_band`` of the alignment.
    Records whose text is null, or has fewer than ``k`` words and no exact copy, have no link.
    ``spent``: a materialised table that is removed as soon as its texts are read.

    Candidates come from Order MinHash sketches, and from ``prefix_pairs`` those that sketches
    of rare k-mers cannot see: where a work has so many edited versions that its own k-mers
    are frequent. A candidate pair is verified by banded alignment over the full texts and
    kept on its exact similarity. Exact copies are folded
    first, so a text that a third of the records share is one row from there on. A sketch
    shared by more than ``CROWD`` classes pairs none: the prefixes, which are exact, find its
    pairs. Duplicates of a pair are removed before any text is fetched.

    The disk holds one copy of the texts, the pairs and what one step shuffles: classes go by
    number, sketches and prefixes are made where the texts lie and shuffled once, and pairs
    fetch their texts in parts where there are many.
    """
    src = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def sequence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "words": [" ".join(_words(t)) for t in pdf["text"]]})

    seqs = src.mapInPandas(sequence, "key string, words string").where("words != ''").withColumn("_h", F.unhex(F.sha2("words", 256)))
    # the class is found on hashes alone, with a partial aggregate: a text with a third of
    # all rows is one row per task before the shuffle
    seqs = materialise(seqs, "sequences")
    if spent is not None:
        forget(spent)
    reps = materialise(seqs.groupBy("_h").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("copies")).withColumn("no", F.monotonically_increasing_id()), "classes")
    members = materialise(seqs.select("key", "_h").join(reps, "_h").select(F.col("key").alias(key), "class_id", "copies"), "members")
    texts = materialise(seqs.join(reps.select("_h", F.col("class_id").alias("key"), "no"), ["_h", "key"]).select("no", "words"), "class-texts")
    forget(seqs)
    named = materialise(reps.select("no", "class_id"), "class-names")
    forget(reps)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for pdf in batches:
            got = [np.unique(kmer_codes(_word_codes(w.split(" "), held), k)) for w in pdf["words"]]
            yield pd.DataFrame({"code": np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)})

    n_classes = texts.count()
    per = texts.select("words").mapInPandas(codes, "code long")
    counted = materialise(per.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-codes")
    limit = max(FREQUENT, n_classes // 2000)
    often = materialise(counted.where(F.col("n") > limit), "frequent")
    # proven bound: a record has finitely many k-mers, so at most (k-mers in all) / limit are
    # frequent; where that still exceeds the limit, the threshold rises
    n_often = often.count()
    if n_often > FREQUENT_LIMIT:
        limit = int(often.select(F.percentile_approx("n", 1 - FREQUENT_LIMIT / n_often, 10000)).first()[0])
        often = often.where(F.col("n") > limit)
    listed = np.sort(np.fromiter((r[0] for r in often.select("code").toLocalIterator()), np.int64)) if n_often else np.zeros(0, np.int64)
    held_often = texts.sparkSession.sparkContext.broadcast(listed)
    held_table = texts.sparkSession.sparkContext.broadcast(commonness(counted))
    forget(often)
    forget(counted)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for no, w in zip(pdf["no"], pdf["words"]):
                own = np.unique(kmer_codes(_word_codes(w.split(" "), held), k))
                got, places = prefix(own, held_table.value, threshold)
                m = len(got)
                rows.append((np.full(m, no, np.int64), np.full(m, len(own), np.int32), got.view(np.int64), places.astype(np.int32)))
            yield pd.DataFrame({c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(("no", "size", "code", "pos"))} if rows else {"no": [], "size": [], "code": [], "pos": []})

    placed = materialise(texts.mapInPandas(prefixes, "no long, size int, code long, pos int"), "prefixes")
    exact = materialise(prefix_pairs(placed, threshold), "prefix-pairs")
    forget(placed)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        common = held_often.value
        for pdf in batches:
            ids, sizes, out = [], [], []
            for no, w in zip(pdf["no"], pdf["words"]):
                km = kmer_codes(_word_codes(w.split(" "), held), k)
                if len(common):
                    at = np.searchsorted(common, km.view(np.int64))
                    f = common[np.minimum(at, len(common) - 1)] == km.view(np.int64)
                else:
                    f = np.zeros(len(km), bool)
                s = order_min_hash(km, f, keep, sketches)
                ids.append(np.full(len(s), no, np.int64))
                sizes.append(np.full(len(s), len(np.unique(km)), np.int32))
                out.append(s.view(np.int64))
            yield pd.DataFrame({"sketch": np.concatenate(out), "no": np.concatenate(ids), "size": np.concatenate(sizes)} if out else {"sketch": [], "no": [], "size": []})

    marks = texts.mapInPandas(sketch, "sketch long, no long, size int")
    # a crowded sketch would give all pairs of its classes; ``prefix_pairs`` has those alike
    alike = materialise(sketch_pairs(marks, threshold), "sketch-pairs")
    pairs = materialise(alike.unionByName(exact).distinct(), "candidates")
    for done in (alike, exact):
        forget(done)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, wa, wb in zip(pdf["a"], pdf["b"], pdf["wa"], pdf["wb"]):
                s, u, bands, main = aligned_bands(wa.split(" "), wb.split(" "), k)
                if u and s >= threshold * u:
                    rows.append((a, b, s / u, bands, main))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity", "bands", "main_band"])

    n_parts = max(1, math.ceil(pairs.count() / max(1.0, AT_ONCE * n_classes)))
    links = None
    for i in range(n_parts):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(n_parts)) == i)
        both = some.join(texts.select(F.col("no").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("no").alias("b"), F.col("words").alias("wb")), "b")
        got = materialise(both.mapInPandas(verify, "a long, b long, similarity double, bands int, main_band int"), "links")
        links = got if links is None else links.unionByName(got)
    for done in (texts, pairs):
        forget(done)
    links = links.join(named.select(F.col("no").alias("a"), F.col("class_id").alias("x")), "a").join(named.select(F.col("no").alias("b"), F.col("class_id").alias("y")), "b")
    return links.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity", "bands", "main_band"), members


def doi_key(doi: Column) -> Column:
    """A DOI without case, outer space, leading resolver address or ``doi`` label."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://[^/]*/|doi\s*:?\s*)+", "")
    return F.when(is_blank(doi) | (bare == ""), None).otherwise(bare)


def versions_of_works(papers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of papers (``paper_id_a < paper_id_b``) that are versions of one work.

    Both abstracts filled: near-duplicate abstracts. One blank: same title words and same
    DOI; titles without words and blank DOIs match nothing. Copies of one abstract are
    expanded into pairs here, because the case list names pairs.
    """
    one = materialise(one_row_per_paper(papers, "title", "abstract", "doi").withColumn("blank", is_blank(F.col("abstract"))), "works")
    title = F.array_join(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    named = materialise(one.select("paper_id", "blank", title.alias("t"), doi_key(F.col("doi")).alias("d")).where("t != '' and d is not null"), "named")
    links, members = near_duplicates(one.where("not blank"), "paper_id", "abstract", threshold=threshold, spent=one)
    m = members.where("copies > 1").select("class_id", "paper_id")
    copies = m.alias("a").join(m.alias("b"), "class_id").where("a.paper_id < b.paper_id").select(F.col("a.paper_id").alias("x"), F.col("b.paper_id").alias("y"))
    ids = members.select("class_id", "paper_id")
    linked = (links.join(ids.select(F.col("class_id").alias("class_a"), F.col("paper_id").alias("x")), "class_a")
              .join(ids.select(F.col("class_id").alias("class_b"), F.col("paper_id").alias("y")), "class_b").select("x", "y"))
    a, b = named.where("blank").alias("a"), named.alias("b")
    by_name = a.join(b, ["t", "d"]).where("a.paper_id != b.paper_id").select(F.col("a.paper_id").alias("x"), F.col("b.paper_id").alias("y"))
    every = copies.unionByName(linked).unionByName(by_name)
    return every.select(F.least("x", "y").alias("paper_id_a"), F.greatest("x", "y").alias("paper_id_b")).distinct()
