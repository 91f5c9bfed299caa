"""Source evidence for cluster summaries, and how faithful a summary is to it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.session import materialise

#: Candidates of a group that one task sees at a time.
SLICE = 2000

# Openings of a paragraph that reports others' work.
RELATED_CUE = r"^(?:\d+(?:\.\d+)*\.?\s*)?(?:related\s+work|background|prior\s+work|literature\s+review)\b"
# Markers of own claims and of design actions; our own short lists, callers may pass others.
OWN_CLAIMS = ("we argue", "we propose", "we present", "we discuss", "we close with", "this paper", "our findings", "the contribution is", "drawing on")
ACTIONS = {"proposes": ("are proposed", "is proposed"), "compares": ("in contrast to", "compare each other"), "tests": ("the effect on", "a follow-up with"), "reports": ("findings from", "the results show"), "reviews": ("prior studies",)}


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _count(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + low.contains(w).cast("int")
    return out


def score_paragraph(paragraph: Column, terms: Column, keywords: Column, representative: Column) -> Column:
    """Struct of a paragraph's evidence score and its parts.

    Terms: 3 per phrase of several words that occurs, 1 per shared root of single words; own
    claims 4 each up to 8; actions 2 each up to 6; keywords 2 for a phrase, else 1; 1.5 for a
    representative paper; minus 1.5 per citation over 1.5 in 100 words, up to 6, and 4 for a
    related-work opening. ``terms`` and ``keywords`` are arrays.
    """
    low = F.lower(paragraph)
    multi = F.filter(terms, lambda t: F.trim(t).contains(" "))
    single = F.filter(terms, lambda t: ~F.trim(t).contains(" ") & (F.trim(t) != ""))
    overlap = 3.0 * F.size(F.filter(multi, lambda t: low.contains(F.lower(F.trim(t))))) + F.size(F.array_intersect(X.roots(paragraph), X.roots(F.array_join(single, " "))))
    own = F.least(F.lit(8.0), 4.0 * _count(low, OWN_CLAIMS))
    action = F.lit(0.0)
    for words in ACTIONS.values():
        action = action + 2.0 * _any(low, words).cast("int")
    action = F.least(F.lit(6.0), action)
    key = F.aggregate(F.transform(keywords, lambda k: F.when((F.trim(k) != "") & low.contains(F.lower(F.trim(k))), F.when(F.trim(k).contains(" "), 2.0).otherwise(1.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    density = X.citation_density(paragraph)
    penalty = F.when(density > 1.5, F.least(F.lit(6.0), 1.5 * (density - 1.5))).otherwise(0.0) + F.when(low.rlike(RELATED_CUE), 4.0).otherwise(0.0)
    bonus = F.when(representative, 1.5).otherwise(0.0)
    total = overlap + own + action + key + bonus - penalty
    reasons = F.array_compact(F.array(F.when(overlap > 0, F.lit("shares terms")), F.when(own > 0, F.lit("own claim")), F.when(action > 0, F.lit("action")), F.when(key > 0, F.lit("keyword")), F.when(bonus > 0, F.lit("representative")), F.when(penalty > 0, F.lit("citations"))))
    return F.struct(total.alias("total"), overlap.alias("term_overlap"), own.alias("first_person"), action.alias("action"), key.alias("keyword"), penalty.alias("citation_penalty"), bonus.alias("representative_bonus"), reasons.alias("reasons"))


def claim_sentences(paragraph: Column, terms: Column, most: int = 2) -> Column:
    """The sentences that claim most: own claims first, then shared roots; the first ``most``
    by that order, put back into text order. Without sentences the first 300 characters."""
    want = X.roots(F.array_join(terms, " "))
    s = F.transform(X.sentences(paragraph), lambda t, i: F.struct((-_any(F.lower(t), OWN_CLAIMS).cast("int")).alias("a"), (-F.size(F.array_intersect(X.roots(t), want))).alias("b"), i.alias("i"), t.alias("t")))
    top = F.slice(F.array_sort(s), 1, most)
    back = F.array_sort(F.transform(top, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    return F.when(F.size(s) > 0, F.array_join(F.transform(back, lambda x: x["t"]), " ")).otherwise(F.substring(paragraph, 1, 300))


def select_evidence(candidates: DataFrame, group: str, *, least_score: float = 3.0, least_chars: int = 80, per_paper: int = 2, most: int = 6, alike: float = 0.8) -> DataFrame:
    """(group, ``place, id, paper_id, paragraph_index, sentences, score``): the best evidence.

    Greedy by score, then paper, then place in the text: at most ``per_paper`` of a paper,
    nothing whose roots are more than ``alike`` (Jaccard) those of a chosen one. ``id`` is 12
    digits of SHA-1 over paper, index and sentences.

    A task sees a group's candidates in slices of ``SLICE`` by rank (the ranks beyond are cut
    before the shuffle); only where a slice does not yield ``most`` is the next one read, with
    what was chosen, so the result is that of the whole list.
    """
    order = [F.desc("score"), "paper_id", "paragraph_index", "sentences"]
    base = candidates.where((F.length("paragraph") >= least_chars) & (F.col("score") >= least_score)).select(group, "paper_id", "paragraph_index", "sentences", "score", X.roots(F.col("paragraph")).alias("roots"))
    ranked = materialise(base.dropDuplicates([group, "paper_id", "paragraph_index", "sentences"]).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))), "ranked-evidence")
    out = f"`{group}` {candidates.schema[group].dataType.simpleString()}, paper_id string, paragraph_index int, sentences string, score double, roots array<string>, rank int, place int, last int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        chosen, n_of = [], {}
        for r in pdf.itertuples(index=False):
            roots = set(r.roots)
            if n_of.get(r.paper_id, 0) >= per_paper or any(len(roots & c) > alike * len(roots | c) for _, c in chosen):
                continue
            n_of[r.paper_id] = n_of.get(r.paper_id, 0) + 1
            chosen.append((r, roots))
            if len(chosen) == most:
                break
        last = int(pdf["rank"].max())
        rows = [(getattr(r, group), r.paper_id, r.paragraph_index, r.sentences, r.score, list(r.roots), r.rank, i + 1, last) for i, (r, _) in enumerate(chosen)]
        return pd.DataFrame(rows, columns=[group, "paper_id", "paragraph_index", "sentences", "score", "roots", "rank", "place", "last"])

    got = materialise(ranked.where(F.col("rank") <= SLICE).groupBy(group).applyInPandas(pick, out), "evidence")
    at = SLICE
    while True:
        full = got.groupBy(group).agg(F.max("place").alias("k"), F.max("last").alias("last")).where((F.col("k") < most) & (F.col("last") == at)).select(group)
        more = ranked.where((F.col("rank") > at) & (F.col("rank") <= at + SLICE)).join(full, group, "left_semi")
        if more.limit(1).count() == 0:
            break
        again = got.join(more.select(group).distinct(), group, "left_semi").select(*ranked.columns).unionByName(more.select(*ranked.columns))
        rest = got.join(more.select(group).distinct(), group, "left_anti")
        got = materialise(rest.unionByName(again.groupBy(group).applyInPandas(pick, out)), "evidence")
        at += SLICE
    ident = F.substring(F.sha1(F.concat_ws("|", "paper_id", F.col("paragraph_index").cast("string"), "sentences")), 1, 12)
    return got.select(group, "place", ident.alias("id"), "paper_id", "paragraph_index", "sentences", "score")


def claim_support(claims: DataFrame, evidence: DataFrame, group: str, claim: str, passage: str, least: float = 0.35) -> DataFrame:
    """(group, claim, ``best``, ``supported``): the largest share of a claim's roots found in
    one passage of its group. A claim without roots is supported.

    Claims meet passages on shared roots, not by pairing all of a group's claims and passages.
    """
    c = claims.select(group, claim).distinct().select(group, claim, X.roots(F.col(claim)).alias("r"))
    e = evidence.select(group, F.col(passage).alias("_p")).distinct().select(group, F.xxhash64("_p").alias("_p"), F.explode(X.roots(F.col("_p"))).alias("root"))
    hit = c.select(group, claim, F.explode("r").alias("root")).join(e, [group, "root"]).groupBy(group, claim, "_p").agg(F.count(F.lit(1)).alias("k")).groupBy(group, claim).agg(F.max("k").alias("k"))
    j = c.join(hit, [group, claim], "left")
    share = F.when(F.size("r") == 0, F.lit(1.0)).otherwise(F.coalesce("k", F.lit(0)) / F.size("r"))
    return j.select(group, claim, share.alias("best"), (share >= least).alias("supported"))


def faithfulness(support: DataFrame, group: str) -> DataFrame:
    """(group, ``faithfulness``): share of supported sentences, two decimals."""
    return support.groupBy(group).agg(F.round(F.avg(F.col("supported").cast("double")), 2).alias("faithfulness"))
