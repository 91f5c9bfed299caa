"""The ten problems' operators against brute force, exact round trips or planted cases."""

import contextlib
import itertools
import math
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelight import session
from quirelight.llm import distinctive, leakage, mixing, near_dup, scan_repair, sentences, spam, subjects, themes, topn

DIR = "/root/testdata/sf0.001"


# --- 1: distinctive terms ---


def test_scores_match_a_table_computed_by_hand(spark):
    rows = [("a", "x", 3), ("a", "y", 1), ("b", "x", 1), ("b", "z", 5), ("c", "y", 2), ("d", None, 4), ("e", "x", 0)]
    df = spark.createDataFrame(rows, "rec string, term string, n long")
    got = {(r["rec"], r["term"]): (r["n_records"], r["g2"]) for r in distinctive.score_terms(df, ["rec"]).collect()}
    live = [r for r in rows if r[1] and r[2]]
    total = sum(n for *_, n in live)
    for rec, t, n in live:
        a, rt, tt = n, sum(x for r, _, x in live if r == rec), sum(x for _, u, x in live if u == t)
        cells = [(a, rt, tt), (rt - a, rt, total - tt), (tt - a, total - rt, tt), (total - rt - tt + a, total - rt, total - tt)]
        g2 = 2 * sum(o * math.log(o * total / (r * c)) for o, r, c in cells if o)
        assert got[rec, t][0] == sum(u == t for _, u, _ in live)
        assert abs(got[rec, t][1]) == pytest.approx(g2, abs=1e-9) and (got[rec, t][1] >= 0) == (a * (total - rt) >= (tt - a) * rt)
    assert len(got) == len(live)


def test_hot_terms_and_limits_lose_nothing(spark):
    rows = [(f"r{i}", "hot", 2) for i in range(3000)] + [(f"r{i}", f"t{i // 3}", 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "rec string, term string, n long")
    assert distinctive.score_terms(df, ["rec"]).count() == 6000
    few = distinctive.score_terms(df, ["rec"], min_count=2, min_records=2, max_records=8)
    assert few.count() == 3000 and few.where("term = 'hot'").count() == 0


def test_paper_and_cluster_terms(spark):
    p = spark.createDataFrame([(2, "p", "wrong wrong"), (1, "p", "Übung übung ab übung9x"), (3, "q", "übung"), (4, "r", " NaN "), (5, None, "übung")], "input_row long, paper_id string, abstract string")
    c = spark.createDataFrame([("r", "v", "m", 0, "A  b, a B,n/a,, loom"), ("r", "v", "m", 0, "loom"), ("r", "v", "m", 1, "LOOM"), ("r", "v", "m", -1, "loom"), ("r", "v", "m", None, "loom"), (None, "v", "m", 2, None)], "run_id string, text_view string, cluster_method string, cluster int, distinguishing_evidence_terms string")
    got = {tuple(r) for r in distinctive.distinctive_terms(p, c).select("record_kind", "record_key", "term").collect()}
    assert got == {("paper", "p", "übung"), ("cluster", "r|v|m|0", "loom"), ("cluster", "r|v|m|1", "loom")}


# --- 2: sentences ---

CASES = [
    'Dr. Foo met Prof. Bar at 9 a.m. and left. "Is it so?" asked one. They said "It broke. Nobody knew." and went.', "J. R. Foo won at Acme Inc. in 4 rounds. See Fig. 3 and Sect. 2.1 (cf. App. B). Fine!", "A thing (it was odd. No one objected.) ended. eSketch maps won.It reached 0.5 vs. 0.4, i.e. more.",
    "2.1. Background\n\nText here\nover lines. More … or less. Etc. was said; maps, lists, etc. Then more.", "Laut Dr. Foo ist z. B. die Übung offen, vgl. Abb. 3. Am 14. Tag kam es. „Wer weiß es? Niemand.“, sagte sie am 3. Mai.",
    "« Où est-ce ? Personne ne sait. » dit l'un. Ils parlent d'une « carte locale. » Quelle carte !", "«¿Dónde está? Nadie lo sabe.», dijo uno. ¿Es útil? ¡Qué bien!", "一位学生说：“图坏了。没有人知道。”然后走了。他称为“好的图。”我们看到结果。", "ある人は「壊れた。分からない。」と述べた。なんと！", "डॉ. किलोव ने कहा, \"टूट गया। पता नहीं।\" और चला गया। क्या यह है? हाँ।", "قال د. علي: «تعطلت. لا أحد يعرف.» ثم غادر. هل هذا؟ نعم.", "งานวิจัยนี้ดี ระบบ eSketch 2.1 ช่วยครู ผลดี",
]
WANT = [3, 3, 3, 5, 3, 3, 3, 3, 2, 3, 3, 3]


@pytest.mark.parametrize("text,n", list(zip(CASES, WANT)))
def test_sentence_cases(text, n):
    spans = sentences.sentence_spans(text)
    assert len(spans) == n, [text[a:b] for a, b in spans]
    assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


RUNS = st.sampled_from([" " * 250, "." * 200, ' "' * 90, ") " * 80, "\n" * 150, " \n\n " * 60, "\u2026 " * 70, "a" * 150, "\u0e01 " * 100, "."])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(CASES), RUNS), min_size=1, max_size=6), st.integers(1, 300))
def test_chunks_with_their_margins_give_the_cuts_of_the_whole(parts, size):
    text = "".join(parts)
    state, found, at = 0, [], 0
    for _, lo, hi, start, piece in sentences.pieces_of(text, size):
        assert lo == at and text[start : start + len(piece)] == piece
        found += [c + start for c in sentences.chunk_cuts(piece, lo - start, hi - start, state)]
        state, at = sentences.chunk_function(piece, lo - start, hi - start)[state], hi
    assert at == len(text) and found == sentences.chunk_cuts(text, 0, len(text), 0)


def test_long_texts_take_the_scan(spark):
    long = "\n\n".join(CASES * 3) + ' She said "' + "one two. " * 60 + '" and left. End.'
    gaps = "One ends." + " " * 250 + "Two goes on" + "." * 200 + " Three" + "\n" * 150 + "four." + ' "' * 90
    df = spark.createDataFrame([("a", long), ("b", "Short. Text."), ("c", ""), ("d", None), ("e", " \n "), ("f", gaps)], "k string, t string")
    whole = {tuple(r) for r in sentences.split_sentences(df, ["k"], "t").collect()}
    cut = {tuple(r) for r in sentences.split_sentences(df, ["k"], "t", chunk=64).collect()}
    assert cut == whole and {k for k, *_ in whole} == {"a", "b", "f"}


# --- 3: near duplicates ---


def jaccard(a, b):
    sa, sb = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (re.findall(r"[^\W_]+", x.lower()) for x in (a, b)))
    return len(sa & sb) / len(sa | sb) if sa | sb else 0.0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))] + "we argue that it remains open".split()
        rows.append((f"a{i:03}", " ".join(base)))
        for j in range(rng.randint(0, 3)):
            w = base[:]
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(9)], [w[k], w[k]]])
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
            rows.append((f"b{i:03}{j}", ("  ".join(w)).upper()))
    rows += [("c1", "same text here again"), ("c2", "Same text, here again!"), ("c3", ""), ("c4", None), ("c5", "too short")]
    links, members = near_dup.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    of = {r["id"]: r["class_id"] for r in members.collect()}
    pairs = {(r["class_a"], r["class_b"]) for r in links.collect()}
    text = dict(rows)
    assert of["c1"] == of["c2"] == "c1" and "c3" not in of and "c4" not in of
    for a, b in itertools.combinations(sorted({c for c in of.values()}), 2):
        assert ((a, b) in pairs) == (jaccard(text[a], text[b]) >= 0.5), (a, b)


def test_hundreds_of_edited_versions_lose_no_link(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(f"v{i:03}", " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(100)) for i in range(200))]
    phrase = [f"p{i}" for i in range(30)]
    rows += [(f"x{i:03}", " ".join([f"o{rng.randrange(10**6)}" for _ in range(60)] + phrase)) for i in range(60)]  # a common phrase is no version
    links, _ = near_dup.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    got = {(r["class_a"], r["class_b"]) for r in links.collect()}
    true = {(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if jaccard(s, t) >= 0.5}
    assert len(true) == 200 * 199 // 2 and got == true


def test_disk_stays_within_four_times_the_texts(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    phrase = [f"common{i}" for i in range(25)]
    rows = []
    for i in range(3000):
        w = [f"w{rng.randrange(60000)}" for _ in range(60)] + phrase
        rows += [(f"a{i:05}", " ".join(w)), *([(f"b{i:05}", " ".join(w[:50] + w[51:]))] if i % 10 == 0 else [])]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "id string, t string").write.parquet(path)
    size = lambda top, begin="": sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if f.startswith(begin))
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: sum(size(d, "shuffle") for d in local)
    monkeypatch.setattr(near_dup, "AT_ONCE", 0.02, raising=False)  # pairs are verified in parts
    held, before, number = [], shuffles(), itertools.count()
    monkeypatch.setattr(session, "scratch_path", lambda _, name: f"file://{tmp_path}/scratch/quirelight-{name}-{next(number)}")
    plain = near_dup.materialise

    def watched(df, name, **how):
        got = plain(df, name, **how)
        held.append((size(tmp_path / "scratch") + shuffles() - before, name))
        return got

    monkeypatch.setattr(near_dup, "materialise", watched)
    links, _ = near_dup.near_duplicates(spark.read.parquet(path), "id", "t")
    got = {(r["class_a"], r["class_b"]) for r in links.collect()}
    assert got == {(f"a{i:05}", f"b{i:05}") for i in range(0, 3000, 10)}
    assert max(held)[0] < 4 * size(path), (max(held), size(path))


def test_prefixes_alone_are_a_superset():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 2**63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in rng.integers(1, 60, 60)]
    sets += [np.unique(np.r_[rng.choice(s, max(1, int(0.8 * len(s))), replace=False), rng.choice(pool, 2)]) for s in sets]
    seen = np.unique(np.concatenate(sets), return_counts=True)
    for size in (16, 1 << 16):  # nearly all codes share a bucket, or none does
        table = np.zeros(size, np.uint8)
        for c, n in zip(*seen):
            i = int(c) & (size - 1)
            table[i] = max(table[i], 0 if n < 2 else round(4 * math.log2(n)))
        first = [set(near_dup.prefix(s, table, 0.5)[0].tolist()) for s in sets]
        for i, j in itertools.combinations(range(len(sets)), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.5 * len(a | b):
                assert first[i] & first[j]


def test_sketches_meet_over_batches():
    class Rows:  # as a task gets them: sorted, in batches
        def __init__(self, *batches):
            self.batches = batches

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInPandas(self, f, _):
            self.out = {p for pdf in f(iter(self.batches)) for p in zip(pdf["a"].tolist(), pdf["b"].tolist())}
            return self

        def distinct(self):
            return self.out

    batch = lambda *rows: pd.DataFrame(rows, columns=["sketch", "no", "size"], dtype="int64")
    crowd = [(9, i, 10) for i in range(near_dup.CROWD + 5)]
    got = near_dup.sketch_pairs(Rows(batch((1, 1, 10), (2, 2, 10)), batch(), batch((2, 3, 10)), batch((2, 4, 30), *crowd[:40]), batch(*crowd[40:]), batch((10, 5, 7), (10, 6, 7))), 0.5)
    assert got == {(2, 3), (5, 6)}


def test_versions_by_title_and_doi(spark):
    rows = [(1, "p1", "A Title!", None, "doi: 10.1/X"), (2, "p2", "a title", "nan", "https://dx.doi.org/10.1/x"), (3, "p3", "a title", "some words that differ from all", "10.1/x"), (4, "p4", "a title", "", None), (5, "p5", "", "", "10.1/x"), (6, "p1", "other", "", "10.1/x")]
    df = spark.createDataFrame(rows, "input_row long, paper_id string, title string, abstract string, doi string").withColumn("words", F.lit(1)).withColumn("class_id", F.lit("q"))
    assert {tuple(r) for r in near_dup.versions_of_works(df).collect()} == {("p1", "p2"), ("p1", "p3"), ("p2", "p3")}


# --- 4: themes ---


def unit_rows(rng, centres, each, spread):
    d = themes.DIMS
    x = np.concatenate([c + rng.normal(0, spread, (each, d)) for c in centres])
    return (x * math.sqrt(d) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_expectation_finds_members_and_leaves_the_others_to_the_background():
    rng = np.random.default_rng(0)
    d = themes.DIMS
    centres = rng.normal(0, 1, (2, d)) * 0.6
    x = np.concatenate([unit_rows(rng, centres, 8, 0.75), unit_rows(rng, np.zeros((1, d)), 20, 1.0)])
    p, c = np.repeat(np.arange(len(x)), 2), np.tile([0, 1], len(x))
    r = np.where((p < 16) & (p // 8 == c), 1.0, 0.3)
    for _ in range(6):
        n, total = themes.sums(x, p, c, r, 2)
        r, ratio = themes.expectation(x, p, c, r, n, total)
    table = r.reshape(-1, 2)
    assert (table[:8, 0] > 0.5).all() and (table[8:16, 1] > 0.5).all() and (table[16:] < 0.5).all()
    # no row is explained by itself: alone in a component it stays with the background
    n, total = themes.sums(x[:1], np.array([0]), np.array([0]), np.ones(1), 1)
    assert themes.expectation(x[:1], np.array([0]), np.array([0]), np.ones(1), n, total)[0][0] < 0.01


def test_the_criterion_joins_halves_and_keeps_others_apart():
    rng = np.random.default_rng(1)
    for size in (5, 12, 40):
        one, two = (unit_rows(rng, c, 2 * size, 0.75) for c in rng.normal(0, 1, (2, 1, themes.DIMS)) * 0.6)
        n = np.array([float(size)])
        half = joined = themes.joining_gain(n, one[:size].sum(0)[None], n, one[size:].sum(0)[None])
        apart = themes.joining_gain(2 * n, one.sum(0)[None], 2 * n, two.sum(0)[None])
        assert half[0] > 0 > apart[0], (size, joined, apart)


def test_fixed_phrases_have_few_neighbours():
    got = themes.content_terms("the very same phrase", "odd maps help. odd maps help", None)
    assert got["maps" if "maps" in got else "map"][0] == 2 and bin(got["odd"][2]).count("1") == 1
    assert themes.content_terms(None, "", None) == {}


def planted(n_themes, size, seed=1, others=150):
    """Papers of themes that draw on twelve words of their own choice, and others that draw on all words."""
    rng = random.Random(seed)
    common = [f"noun{c}{d}{e}" for c in "abcdefghijkl" for d in "mnopqrstuv" for e in "wxyz"]
    rows, truth = [], {}

    def paper(words, own):
        body = [rng.choice(words if rng.random() < 0.85 else common) for _ in range(45)] + own
        rng.shuffle(body)
        i = len(rows)
        rows.append((i, f"p{i:04}", " ".join(body[:4]), "the results of " + " ".join(body), "design"))
        return f"p{i:04}"

    for t in range(n_themes):
        words = rng.sample(common, 12)
        for _ in range(size):
            truth[paper(words, [w for w in (f"jargon{chr(97 + t)}x", f"jargon{chr(97 + t)}y") if rng.random() < 0.8] * 2)] = t
    for _ in range(others):
        paper(rng.sample(common, 60), [])
    return rows, truth


PAPER = "input_row long, paper_id string, title string, abstract string, keyword string"


def theme_quality(got, truth):
    pairs = {tuple(r) for r in themes.theme_pairs(got).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    return len(pairs & want) / len(want), len(pairs & want) / max(1, len(pairs))


def test_planted_themes_are_found(spark):
    rows, truth = planted(6, 9)
    df = spark.createDataFrame([*rows, (9000, "blank", "t", "", None), (9001, None, "t", "a b", "k")], PAPER).withColumn("theme", F.lit("clash")).withColumn("term", F.lit(1))
    got = themes.themes(df)
    found, true = theme_quality(got, truth)
    assert found >= 0.9 and true >= 0.9, (found, true)
    out = got.toPandas()
    assert len(out) == len(rows) and out.paper_id.is_unique and (out[out.theme.isna()]["size"] == 1).all()
    for _, g in out[out.theme.notna()].groupby("theme"):
        g = g.sort_values("typical")
        assert list(g.typical) == list(range(1, len(g) + 1)) and (g["size"] == len(g)).all()
        assert g.density.round(6).is_monotonic_decreasing  # the densest members are the typical ones


def test_the_mixture_decides(spark, monkeypatch):
    rows, truth = planted(6, 9)
    df = spark.createDataFrame(rows, PAPER)
    round_ = themes._round
    zero = F.lit(bytes(4 * themes.DIMS))

    def one_component(state, params, needed):
        if params is not None:
            whole = themes._added(params.dropDuplicates(["root"]).select(F.lit(1).cast("long").alias("comp"), "n", F.col("n").alias("held"), "total"))
            params = params.select("comp").crossJoin(whole.select(F.lit(1).cast("long").alias("root"), "n", "total"))
        return round_(state, params, needed)

    def no_means(state, params, needed):
        return round_(state, params if params is None else params.withColumn("total", zero), needed)

    for wrong in (one_component, no_means):
        monkeypatch.setattr(themes, "_round", wrong)
        assert theme_quality(themes.themes(df), truth)[0] < 0.5, wrong.__name__


def test_a_theme_of_a_third_of_all_papers(spark):
    rows, truth = planted(1, 150, others=300)
    got = themes.themes(spark.createDataFrame(rows, PAPER))
    # it comes out as one theme; papers with many foreign words may be left out of it
    assert got.where("theme is not null").select("theme").distinct().count() == 1
    found, true = theme_quality(got, truth)
    assert found >= 0.2 and true >= 0.9, (found, true)


def test_a_theme_over_many_chunks_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(themes, "CHUNK", 40)
    rows, truth = planted(3, 60, others=500)
    found, true = theme_quality(themes.themes(spark.createDataFrame(rows, PAPER)), truth)
    assert found >= 0.9 and true >= 0.9, (found, true)


# --- 5: subjects ---


def test_a_paper_of_many_candidates_takes_no_more_memory():
    rng = np.random.default_rng(2)
    papers, each, comps = 400, 200, 500
    x = rng.standard_normal((papers, themes.DIMS)).astype(np.float32)
    p = np.repeat(np.arange(papers), each)
    c = np.concatenate([rng.choice(comps, each, replace=False) for _ in range(papers)])
    r = rng.random(len(c)).astype(np.float32) / each
    n, total = themes.sums(x, p, c, r, comps)
    assert np.allclose(total[7], (r[c == 7, None] * x[p[c == 7]]).sum(0), atol=1e-4)
    tracemalloc.start()
    themes.sums(x, p, c, r, comps)
    got, ratio = themes.expectation(x, p, c, r, n, total)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6, most  # the features of all candidates are 61 MB
    some = rng.choice(papers, 5, replace=False)
    for i in some:  # each paper alone gives the same
        at = p == i
        alone = themes.expectation(x[[i]], np.zeros(each, np.int64), c[at], r[at], n, total)
        assert np.allclose(alone[0], got[at]) and np.allclose(alone[1], ratio[at])
    pairs, count = themes._counted_pairs(p, c, comps)
    a, b = themes._pairs(p, c)
    assert dict(zip(pairs.tolist(), count.tolist())) == Counter((a * comps + b).tolist())


def test_triples_are_sent_in_parts(monkeypatch):
    monkeypatch.setattr(themes, "SENT", 2000, raising=False)
    pdf = pd.DataFrame({"paper_id": [f"p{i}" for i in range(40)], "terms": [list(range(i, i + 18)) for i in range(40)]})
    parts = list(themes._keys("paper_id")(iter([pdf[:25], pdf[25:]])))
    assert max(map(len, parts)) < 2000 + 816 and sum(map(len, parts)) == 40 * 816
    assert Counter(pd.concat(parts)["paper_id"]) == {f"p{i}": 816 for i in range(40)}


def test_chunks_of_many_candidates_are_split(spark, monkeypatch):
    monkeypatch.setattr(themes, "ENTRIES", 100)
    state = spark.createDataFrame([(f"p{i}", 3 if i < 200 else 4, 5 if i < 200 else 1) for i in range(250)], "paper_id string, chunk long, k int")
    got = themes._thinned(state, F.col("k"), 24).groupBy("chunk").agg(F.sum("k").alias("k"), F.count("k").alias("n")).collect()
    assert sum(r["n"] for r in got) == 250 and max(r["k"] for r in got) < 250 and {r["chunk"] for r in got} == {4, *(3 + (i << 24) for i in range(10))}


def test_subjects_on_held_out_labels():
    d = "/root/testdata/sf0.1"
    f = pd.read_parquet(f"{d}/final_advancing_list.parquet").sort_values("input_row").drop_duplicates("paper_id").set_index("paper_id").abstract.fillna("")
    lab = pd.read_parquet(f"{d}/area_labels.parquet").groupby("paper_id").area.apply(frozenset)
    rows = [(subjects.statements(f[p]), y) for p, y in lab.items() if p in f.index and f[p].strip()]
    random.Random(1).shuffle(rows)
    k = int(0.8 * len(rows))
    m = subjects.SubjectModel().fit(rows[:k])
    tp = fp = fn = 0
    for s, y in rows[k:]:
        got = set(m.areas(s))
        tp, fp, fn = tp + len(got & y), fp + len(got - y), fn + len(y - got)
    # the labels are wrong in about one case of twenty
    assert tp / (tp + fp) > 0.75 and tp / (tp + fn) > 0.75
    # the tree decides: with equal leaf mixtures nothing is left of it
    m.shares, m.near = np.full_like(m.shares, 1 / 12), {}
    assert sum(len(set(m.areas(s)) & y) for s, y in rows[k:]) < 0.4 * tp


def test_a_leaf_beside_another_takes_no_share_in_its_area():
    place = {"law": "court bailiff", "education": "pupils classroom", "finance": "tellers bank", "media": "editors newsroom", "design": "ateliers milliners",
             "defense": "sappers drills", "software": "compilers commits", "environment": "herons reeds", "healthcare": "nurses wards", "everyday": "kitchens chores"}
    rng = random.Random(3)
    docs = []
    for _ in range(400):
        ys = frozenset(rng.sample(sorted(place), rng.choice([1, 2])))
        docs.append(([place[y].split() for y in ys], ys))
    m = subjects.SubjectModel().fit(docs)
    for y, text in place.items():
        mix = m.subjects(m.terms(text.split()))
        assert mix[y] > 0.8 and sum(mix.values()) - mix[y] < 0.2, (y, mix)
    assert {k for k in place if any(set(place[k].split()) & set(t) for t in m.labels)} == set(place)


def test_bisecting_kmeans_splits_directions():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.eye(4)[i] + rng.normal(0, 0.05, (20, 4)) for i in range(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = subjects.bisecting_kmeans(x, np.ones(80), 4)
    assert all(len(set(label[i * 20 : i * 20 + 20])) == 1 for i in range(4)) and len(set(label)) == 4


def test_subjects_without_labels_or_text(spark):
    p = spark.createDataFrame([(1, "a", "Some text. Here."), (2, "b", " "), (3, "c", None)], "input_row long, paper_id string, abstract string")
    none = spark.createDataFrame([], "paper_id string, area string")
    assert [tuple(r) for r in subjects.subject_areas(p, none).collect()] == [("a", "generic", 1.0)]
    assert subjects.subject_areas(p.limit(0), none).count() == 0


# --- 6: top N ---


def test_top_n_matches_brute_force_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP_BYTES", 2048)
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([1, 1, 2, 3, 500]), rng.choice([0, 7, None]), rng.choice(["x", "y"]) + str(rng.randrange(400))) for _ in range(6000)] + [("a", 1, 0, None)]
    df = spark.createDataFrame(rows, "g string, rank int, tie int, item string").withColumn("_g", F.lit(1)).withColumn("position", F.lit("clash"))
    got = sorted((r["g"] or "", r["position"], r["item"]) for r in topn.top_n(df, ["g"], [F.col("rank"), F.coalesce("tie", F.lit(10**9))], "item", 4).collect())
    best = {}
    for g, rank, tie, item in rows:
        if item is not None:
            k = (rank, 10**9 if tie is None else tie, item)
            best[g, item] = min(best.get((g, item), k), k)
    want = []
    for g in {g for g, _ in best}:
        want += [(g or "", i + 1, k[2]) for i, k in enumerate(sorted(k for (h, _), k in best.items() if h == g)[:4])]
    assert got == sorted(want)


def test_row_groups_behind_the_nth_item_are_not_read(spark, tmp_path, monkeypatch):
    df = spark.range(40000).selectExpr("'g' as _g", "cast(id as double) as _o0", "cast(id as string) as _item").repartition(1).sortWithinPartitions("_g", "_o0")
    df.write.option("parquet.block.size", 65536).parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t")).inputFiles()
    units = next(topn._row_groups(["_o0"])(iter([pd.DataFrame({"path": files})])))
    assert len(units) > 3
    read = []
    opened = topn._open

    @contextlib.contextmanager
    def counting(path):
        class One:
            def read_row_group(self, i, columns):
                read.append(i)
                with opened(path) as f:
                    return f.read_row_group(i, columns=columns)

        yield One()

    monkeypatch.setattr(topn, "_open", counting)
    out = topn._read_best_first(3, ["_o0"])(units)
    assert sorted(out["_o0"]) == [0.0, 1.0, 2.0] and len(read) == 1


def test_leading_papers_edges(spark):
    s = "run_id string, text_view string, cluster_method string, cluster int, paper_id string, representative_rank int, medoid_rank int"
    rows = [("r", "v", "m", 0, "a", 2, None), ("r", "v", "m", 0, "b", 2, 5), ("r", "v", "m", 0, "a", 9, 1), ("r", "v", "m", 0, "c", 0, 1), ("r", "v", "m", 0, "d", None, 1), ("r", "v", "m", -1, "e", 1, 1), ("r", "v", "m", 0, "f", 3, 3), ("r", "v", "m", 0, "g", 3, 3)]
    assert [r["paper_id"] for r in topn.leading_papers(spark.createDataFrame(rows, s)).orderBy("position").collect()] == ["b", "a", "f"]
    assert topn.leading_papers(spark.createDataFrame([], s)).count() == 0


# --- 7: scanned pages ---


@pytest.fixture(scope="module")
def repair(spark):
    d = "/root/testdata/sf0.01"
    return scan_repair.build(spark.read.parquet(f"{d}/build_fulltext_context.parquet"), spark.read.parquet(f"{d}/final_advancing_list.parquet"))[0]


def test_page_furniture_is_told_from_headings(repair):
    lines = ["The authors compare the lamp with a map of the room and", "report what the makers did with it over six weeks in a", "A ROOM OF LAMPS", "— 12 —", "studio. The results show that the lamp was of no use to", "them.", "",
             "Discussion", "", "We argue that a map should outline the room rather than", "p. 13", "sketch the lamps of its makers."]
    rows, clean = repair.damage("\n".join(lines), "A room of lamps", "Foosh, A.; Barnd, B.")
    assert {n for n, k, _ in rows if k == "furniture"} == {3, 4, 11}
    assert "in a studio." in clean and "\n\nDiscussion\n\n" in clean and "rather than sketch" in clean


def test_shapes_of_lines():
    x = scan_repair.Lexicon({"foosh", "barnd"}, {"journal", "of", "rooms"})
    t = {"a", "room", "of", "lamps"}
    assert x.shape("12 | Foosh & Barnd", t) == "9 | N & N" and x.shape("F0osh: A room of la...", t) == "N: T..."
    assert x.shape("Journal of Rooms, Vol. 3", t) == "V, vol. 9" and x.shape("A ROOM OF LAMP", t) == "T"
    known = scan_repair.known_lines(["long text line that goes on", "— 9 —", "goes on here", "", "Head"], {0: "x", 1: "— 9 —", 2: "y", 4: "head"}, {"— 9 —": 0.9, "head": 0.0})
    assert known == {0: "T", 1: "F", 2: "T", 4: "T"}


def test_line_joins_are_learned():
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    words = {"".join(rng.choices(letters, k=8)): rng.randint(2, 40) for _ in range(1500)}
    some = sorted(words)
    words |= {f"{rng.choice(some)}-{rng.choice(some)}": rng.randint(2, 9) for _ in range(300)}
    m = scan_repair.train_joins(words)
    ask = lambda a, b: m.best(scan_repair.join_features(a, b, "-", lambda w: words.get(w, 0)))
    plain, kept = [w for w in some[:300]], [w for w in words if "-" in w]
    assert sum(ask(w[:4], w[4:]) == "J" for w in plain) > 0.97 * len(plain)
    assert sum(ask(*w.split("-")) == "H" for w in kept) > 0.97 * len(kept)
    a, b = some[3], some[40]
    assert ask(a, b) == "H" and ask(a[:3], a[3:]) == "J"
    assert scan_repair.train_joins({}).best(["bias"]) == ""


def test_misread_and_split_words(repair):
    rows, text = repair.damage("The des1gn of tbe lamps was rev-\niewed by novi­\nces and feedback-\nloops.\n\nNext para", "", "")
    kinds = {(n, k): w for n, k, w in rows}
    assert kinds[1, "garbled"] in ("design", "the") and "reviewed" in text and "\n\nNext para" in text
    assert repair.damage("", "", "")[0] == [] and repair.damage("\n\n", "", "")[1] == ""


def test_words_beyond_the_limit_are_looked_up(spark, monkeypatch):
    clean = "the makers sketch quindle forms and weigh the zorbatic lamps beside the room " * 30
    rare = "Ombrelict plants grow. Ombrelict plants grow."
    c = spark.createDataFrame([("a", "pypdf", clean, rare), ("b", "ocr", "the makers sketch the ombre-\nlict plants and\nweigh ombrelict lamps", None)], "paper_id string, pdf_extract_method string, extracted_context string, discussion_full string")
    p = spark.createDataFrame([(1, "b", "x", "y", "Foosh, A.; Barnd, B.; Foosh, C.", "Rooms")], "input_row long, paper_id string, title string, abstract string, authors string, venue string")
    monkeypatch.setattr(scan_repair, "DICTIONARY_LIMIT", 3)
    repairer, fields = scan_repair.build(c, p)
    [row] = fields.collect()
    assert len(repairer.words.n) == 3 and {"ombrelict", "makers", "plants"} <= {r["w"] for r in row["own"]}
    repairer.answer(row["lex"], row["own"])
    assert repairer.words.known("ombrelict") and repairer._word("ombrelict") is None and repairer.words.n.get("zorbatic") is None


def test_rare_names_are_looked_up(spark):
    few = lambda *w: spark.createDataFrame([(x, 1) for x in w], "w string, count long")
    f = spark.createDataFrame([("p", "x", "F0osh & B4rnd\nJ0urnal of R00ms", "a lamp", None)], f"paper_id string, field_name string, text string, title string, lex {scan_repair._LEX}")
    [row] = scan_repair._with_lexicon(f, few("foosh", "fzosh", "barnd"), few("rooms", "of")).collect()
    x = scan_repair.Lexicon(set(), {"journal"})
    assert x.shape("F0osh & B4rnd", set()) == "f9osh & b9rnd"
    x.answer(scan_repair._rows(row["lex"]))
    assert x.shape("F0osh & B4rnd", set()) == "N & N" and x.shape("J0urnal of R00ms", set()) == "V"
    whole = scan_repair.Lexicon({"foosh", "fzosh", "barnd"}, {"journal", "rooms", "of"})
    assert all(whole.shape(t, set()) == x.shape(t, set()) for t in ("F0osh & B4rnd", "J0urnal of R00ms", "of barnd"))


def test_scan_repair_without_anything_to_learn_from(spark):
    c = spark.createDataFrame([("p", "ocr", "a line\nof text", None), ("p", "ocr", "a line\nof text", " "), ("q", "pypdf", None, None), (None, "ocr", "x", "y")], "paper_id string, pdf_extract_method string, extracted_context string, discussion_full string")
    p = spark.createDataFrame([], "input_row long, paper_id string, title string, abstract string, authors string, venue string")
    assert scan_repair.damaged_places(c, p).count() == 0
    assert [r["text"] for r in scan_repair.repaired_texts(c, p).collect()] == ["a line of text"]


# --- 8: leakage ---


def test_planted_passages_are_found_on_both_paths(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(45, 90)))) for i in range(25)] + [(90, "only eight words are in this small item"), (91, None)]
    docs, want = [], set()
    for i in range(160):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if i % 2:
            k, text = rng.choice(items[:25])
            w = text.split()
            n = max(18, int(len(w) * rng.choice([0.4, 0.6, 1.0])))
            at = rng.randrange(len(w) - n + 1)
            part = w[at : at + n]
            for j in range(5, n - 5, 13):
                part[j] = "other"
            how = rng.choice([str.upper, str.title, lambda x: f"*{x}*,"])
            body[len(body) // 2 : len(body) // 2] = [how(x) for x in part]
            want.add((k, i))
        elif i % 4 == 0:
            body += items[i % 25][1].split()[:9]
        docs.append((i, "\n> ".join(body)))
    docs += [(900, None), (901, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    e = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    for limit in (leakage.INDEX_LIMIT, 0):
        got = {(r["item_id"], r["doc_id"]) for r in leakage.leaked_items(d, e, index_limit=limit).collect()}
        assert got == want
    assert leakage.leaked_items(d, e.limit(0)).count() == 0


# --- 9: mixing ---


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_capped_poisson_has_the_wanted_mean(cap):
    for mean in (0.05, 0.5 * cap, 0.95 * cap):
        assert mixing._capped_mean(mixing._rate_for(mean, cap), cap) == pytest.approx(mean, rel=1e-6)
    assert mixing._rate_for(cap, cap) == math.inf


def test_mixture_shares_caps_and_determinism(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then ' Big ' when id % 3 = 1 then 'SMALL' else null end as source", "repeat('some words here ', cast(id % 7 + 1 as int)) as text").withColumn("n_tokens", F.lit(-1)).withColumn("_n", F.lit("x"))
    t = spark.createDataFrame([("big", 0.25, 1), ("small", 0.75, 4), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, t)
    rows = m.select("doc_id", "source", "copy", "place").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7), t).select("doc_id", "source", "copy", "place").collect()))
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    share = {r["source"]: r for r in mixing.reached_shares(m, t).collect()}
    assert share["big"]["share"] == pytest.approx(0.25, abs=0.02) and share["small"]["most_repeats"] <= 4 and share["big"]["most_repeats"] == 1 and share["none"]["tokens"] == 0
    assert mixing.mix(docs.limit(0), t).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("<|endoftext|>",), (None,)], "t string")
    got = [r["n"] for r in df.select(mixing.token_counter()(F.col("t")).alias("n")).collect()]
    assert got[0] == 2 and got[1] > 1 and got[2] is None


# --- 10: stuffed pages ---


def test_stuffed_pages(spark):
    rng = random.Random(4)
    nouns = [f"{a}{b}" for a in ("lam", "roo", "map", "loo", "wal", "pen", "cur") for b in ("ps", "ms", "tex", "der", "ves", "tal")]
    verbs = "sorts keeps holds shows bends lifts turns".split()

    def prose(n):
        return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} {rng.randint(2, 99)} of the {rng.choice(nouns)}, and a {rng.choice(nouns)} {rng.choice(verbs)} it near {rng.choice(nouns)} again." for _ in range(n))

    rows = [(i, prose(rng.randint(4, 14))) for i in range(300)]
    bad = {900: " ".join(rng.choice(nouns[:4]) for _ in range(160)), 901: prose(1) + "\n" + "\n".join(f"- [{rng.choice(nouns[:3])}](http://x.example/{i})" for i in range(25)), 902: "#" + " #".join(rng.choice(nouns[:5]) for _ in range(120)), 903: "Get lamps now! Best lamps online. " * 20}
    df = spark.createDataFrame([*rows, *bad.items(), (950, ""), (951, None), (952, "One short line"), (None, "x")], "doc_id long, text string").withColumn("ratio", F.lit("clash"))
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} == set(bad)
    assert spam.stuffed_pages(df.limit(0)).count() == 0


def test_every_block_counts():
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(3 * spam.BLOCK + 11))
    ratio, size = spam.block_ratio(text)
    assert 0 < ratio <= 1.2 and size == len(text) // 4
