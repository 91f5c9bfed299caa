"""Rule coding of papers and clusters with auditable codebooks.

A codebook is data: keys with weighted regular expressions over lower-cased text. It is
compiled to literal column expressions, one per rule, so every pattern is compiled once and
the rules of a paper are evaluated in one pass over its row, without a join. Callers pass
codebooks of their own; the ones here are short and plain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    key: str
    name: str
    pattern: str
    weight: int = 3


@dataclass(frozen=True)
class Codebook:
    rules: tuple[Rule, ...]
    cap: int = 14
    priority: dict[str, int] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(r.key for r in self.rules))


def _book(cap: int, **rules: list[tuple[str, str, int]]) -> Codebook:
    rows = tuple(Rule(k, *r) for k, rs in rules.items() for r in rs)
    return Codebook(rows, cap, {k: len(rules) - i for i, k in enumerate(rules)})


CONTRIBUTION = _book(
    14,
    theoretical=[("argues a position", r"\bwe argue that\b", 3), ("names a concept", r"\b(?:we call this|concept of|school of thought)\b", 2), ("theory", r"\b(?:theor(?:y|ies|etical)|conceptual framework)\b", 1)],
    methodological=[("paper through a procedure", r"\bthis paper \w+ the [\w -]+ through\b", 3), ("using a procedure", r"\b(?:using|drawing on) (?:a|an|semi)\b", 1), ("steps", r"\b(?:protocol|walkthrough|procedure)\b", 1)],
    artifact=[("contribution is a thing", r"\bthe contribution is an? \b", 3), ("proposes parts", r"\bare proposed:", 2), ("tool", r"\b(?:toolkit|prototype|system)\b", 1)],
    empirical=[("findings from", r"\bfindings from \w+\b", 3), ("results show", r"\bthe results show\b", 2), ("reported", r"\breported \w+\b", 1)],
    survey=[("prior studies", r"\bprior studies\b", 2), ("few accounts", r"\byet few accounts\b", 2)],
    opinion=[("open question", r"\bit remains open whether\b", 2), ("discussion", r"\bwe discuss how\b", 2)],
    dataset=[("records", r"\bdata: \d+ records\b", 3), ("collected", r"\bwe collected the data\b", 3)],
)
MOVES = _book(
    12,
    builds=[("names anew", r"\bwe call this\b", 3), ("models", r"\bwe \w+ an? [\w -]+ that\b", 2)],
    tests=[("compared", r"\b(?:comparison|replication|field trial)\b", 2), ("effect", r"\bthe effect on\b", 3)],
    extends=[("extends", r"\b(?:extend|expand|enrich)\w*\b", 2)],
    questions=[("open", r"\bremains open\b", 3), ("rather than", r"\brather than\b", 1)],
)
DOMAINS = _book(
    8,
    healthcare=[("care", r"\b(?:hospital|clinic|dialysis|surg|nurse|patient|ward|carer)\w*", 3)],
    education=[("school", r"\b(?:school|pupil|lecture hall|seminar|teacher|homework|kindergarten)\w*", 3)],
    law=[("court", r"\b(?:court|statute|hearing|notar|parliament|regulator|tenancy)\w*", 3)],
    finance=[("money", r"\b(?:bank|loan|pension|mortgage|insurance|accounting|payment)\w*", 3)],
    transportation=[("traffic", r"\b(?:ferry|tram|freight|traffic|truck|pilot|shuttle)\w*", 3)],
    manufacturing=[("plant", r"\b(?:factory|foundr|assembly line|lathe|conveyor|warehouse)\w*", 3)],
    software=[("code", r"\b(?:codebase|commit|incident|database|open-source|programmer)\w*", 3)],
    media=[("press", r"\b(?:podcast|editor|broadcast|photographer|music label|streaming)\w*", 3)],
    environment=[("nature", r"\b(?:wind farm|solar|wetland|erosion|recycling|irrigation|carbon)\w*", 3)],
)
SUBTYPES = {"artifact": (("Physical device", r"\b(?:lamp|sensor|robot|pen|door)\w*"), ("Paper tool", r"\b(?:card|worksheet|notebook|template)\w*"), ("Interactive system", r"\b(?:dashboard|interface|platform|chatbot)\w*")),
            "empirical": (("Field study", r"\b(?:field|diary|deployment)\b"), ("Laboratory study", r"\blaboratory\b"), ("Review", r"\breview\b"))}


def hits(c: Column, pattern: str) -> Column:
    """Matches of a pattern in lower-cased text, at most two count."""
    return F.least(F.lit(2), F.regexp_count(c, F.lit(pattern)))


def rule_hits(df: DataFrame, keep: list[str], low: str, book: Codebook) -> DataFrame:
    """(keep columns, ``key, rule, ord, weight, hits``): every rule that matches."""
    structs = F.array(*[F.struct(F.lit(r.key).alias("key"), F.lit(r.name).alias("rule"), F.lit(i).alias("ord"), F.lit(r.weight).alias("weight"), hits(F.col(low), r.pattern).alias("hits")) for i, r in enumerate(book.rules)])
    x = F.explode(F.filter(structs, lambda s: s["hits"] > 0))
    return df.select(*keep, x.alias("_x")).select(*keep, "_x.key", "_x.rule", "_x.ord", "_x.weight", "_x.hits")


def paper_scores(df: DataFrame, keep: list[str], low: str, book: Codebook) -> DataFrame:
    """(keep columns, ``key, score``): summed weight times hits of each matching key."""
    return rule_hits(df, keep, low, book).groupBy(*keep, "key").agg(F.sum(F.col("weight") * F.col("hits")).alias("score"))


def _priority(book: Codebook) -> Column:
    return F.create_map(*[F.lit(x) for kv in book.priority.items() for x in kv])[F.col("key")]


def selected_per_paper(scores: DataFrame, keep: list[str], book: Codebook, least: int = 3, gap: int = 1) -> DataFrame:
    """The best key of each paper and, within ``gap`` of it, the second; both at least ``least``."""
    w = W.partitionBy(*keep).orderBy(F.desc("score"), F.desc(_priority(book)))
    r = scores.withColumns({"place": F.row_number().over(w), "best": F.max("score").over(W.partitionBy(*keep))})
    return r.where((F.col("score") >= least) & ((F.col("place") == 1) | ((F.col("place") == 2) & (F.col("best") - F.col("score") <= gap))))


def least_support(n: Column) -> Column:
    return F.when(n < 8, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.10))).cast("int")


def cluster_support(chosen: DataFrame, group: str, book: Codebook, sizes: DataFrame) -> DataFrame:
    """(group, ``n, key, score, support, place``): keys of a cluster by capped score, support
    and priority. Partial aggregates by group and key."""
    s = chosen.groupBy(group, "key").agg(F.sum(F.least(F.lit(book.cap), F.col("score"))).alias("score"), F.count(F.lit(1)).alias("support"))
    w = W.partitionBy(group).orderBy(F.desc("score"), F.desc("support"), F.desc(_priority(book)))
    return s.join(sizes, group).withColumn("place", F.row_number().over(w))


def contribution(papers: DataFrame, group: str, paper: str, low: str, book: Codebook = CONTRIBUTION) -> DataFrame:
    """(group, ``n, contribution, secondary, score, support``) of every cluster.

    ``mixed`` if the best key lacks score or support but several are signalled by three
    papers in all; ``unclear`` if not. ``secondary`` is a key that is practically as strong
    (Python's half-even rounding of 8 % of the best score), else ''.
    """
    sizes = papers.groupBy(group).agg(F.countDistinct(paper).alias("n"))
    chosen = selected_per_paper(paper_scores(papers, [group, paper], low, book), [group, paper], book)
    r = cluster_support(chosen, group, book, sizes)
    top = r.groupBy(group).agg(F.max_by(F.struct("key", "score", "support"), -F.col("place")).alias("b"), F.max(F.when(F.col("place") == 2, F.struct("key", "score", "support"))).alias("s"),
                               F.count_if(F.col("score") >= 3).alias("signalled"), F.sum(F.when(F.col("score") >= 3, F.col("support"))).alias("spread"))
    j = sizes.join(top, group, "left")
    need = least_support(F.col("n"))
    weak = F.coalesce((F.col("b.score") < 3) | (F.col("b.support") < need), F.lit(True))
    mixed = F.coalesce((F.col("signalled") >= 2) & (F.col("spread") >= 3), F.lit(False))
    label = F.when(weak & mixed, F.lit("mixed")).when(weak, F.lit("unclear")).otherwise(F.col("b.key"))
    near = (~weak & (F.col("s.score") >= 3) & (F.col("s.support") >= need) & (F.col("b.score") - F.col("s.score") <= F.greatest(F.lit(1), F.bround(F.col("b.score") * 0.08))) & (F.abs(F.col("b.support") - F.col("s.support")) <= 1))
    zero = F.lit(0).cast("long")
    return j.select(group, "n", label.alias("contribution"), F.when(F.coalesce(near, F.lit(False)), F.col("s.key")).otherwise(F.lit("")).alias("secondary"), F.coalesce("b.score", zero).alias("score"), F.coalesce("b.support", zero).alias("support"))


def pattern_evidence(papers: DataFrame, group: str, paper: str, low: str, book: Codebook, most: int = 5) -> DataFrame:
    """(group, ``key, patterns``): a key's commonest rule names with counts, ties in codebook order."""
    n = rule_hits(papers, [group, paper], low, book).groupBy(group, "key", "rule", "ord").agg(F.sum("hits").alias("h"))
    parts = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("h")).alias("a"), F.col("ord").alias("o"), F.concat(F.col("rule"), F.lit(" ("), F.col("h").cast("string"), F.lit(")")).alias("t")))), 1, most)
    return n.groupBy(group, "key").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "; ").alias("patterns"))


def domains(papers: DataFrame, group: str, paper: str, low: str, book: Codebook = DOMAINS, most: int = 3) -> DataFrame:
    """(group, ``n, place, domain, support``): up to ``most`` domains with enough support, by
    support, score and codebook order; a cluster without any has ``generic``."""
    sizes = papers.groupBy(group).agg(F.countDistinct(paper).alias("n"))
    s = paper_scores(papers, [group, paper], low, book).groupBy(group, "key").agg(F.sum(F.least(F.lit(book.cap), F.col("score"))).alias("score"), F.count(F.lit(1)).alias("support")).join(sizes, group)
    need = F.when(F.col("n") <= 4, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(F.col("n") * 0.20)))
    w = W.partitionBy(group).orderBy(F.desc("support"), F.desc("score"), F.desc(_priority(book)))
    kept = s.where((F.col("support") >= need) & (F.col("score") >= 3)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    none = sizes.join(kept, group, "left_anti").select(group, "n", F.lit(1).alias("place"), F.lit("generic").alias("domain"), F.col("n").alias("support"))
    return kept.select(group, "n", "place", F.col("key").alias("domain"), "support").unionByName(none)


def theory_move(papers: DataFrame, group: str, paper: str, low: str, book: Codebook = MOVES) -> DataFrame:
    """(group, ``n, move, score, support``): ``unclear`` without score or support, or when two
    moves are equally supported and close in score."""
    sizes = papers.groupBy(group).agg(F.countDistinct(paper).alias("n"))
    r = cluster_support(paper_scores(papers, [group, paper], low, book), group, book, sizes)
    top = r.groupBy(group).agg(F.max(F.when(F.col("place") == 1, F.struct("key", "score", "support"))).alias("b"), F.max(F.when(F.col("place") == 2, F.struct("key", "score", "support"))).alias("s"))
    j = sizes.join(top, group, "left")
    s2, u2 = F.coalesce("s.score", F.lit(0)), F.coalesce("s.support", F.lit(0))
    tied = (s2 > 0) & (F.col("b.score") - s2 < 2) & (F.col("b.support") == u2)
    bad = F.coalesce((F.col("b.score") < 3) | (F.col("b.support") < least_support(F.col("n"))) | tied, F.lit(True))
    zero = F.lit(0).cast("long")
    return j.select(group, "n", F.when(bad, F.lit("unclear")).otherwise(F.col("b.key")).alias("move"), F.coalesce("b.score", zero).alias("score"), F.coalesce("b.support", zero).alias("support"))


def conditional_move(primary: Column, secondary: Column, move: Column) -> Column:
    """The theory move where a theoretical contribution leads, else ``not_applicable``."""
    return F.when((primary == "theoretical") | (secondary == "theoretical"), move).otherwise(F.lit("not_applicable"))


def subtype(papers: DataFrame, group: str, paper: str, low: str, rank: str, key: str) -> DataFrame:
    """(group, ``n, subtype, support``) of a contribution key: representative papers (ranks 1
    to 3) weigh 3, others 1; '' under the least support. Blank ranks weigh 1; noise should
    not be passed."""
    rules = SUBTYPES.get(key, ())
    sizes = papers.groupBy(group).agg(F.countDistinct(paper).alias("n"))
    if not rules:
        return sizes.select(group, "n", F.lit("").alias("subtype"), F.lit(0).cast("long").alias("support"))
    weight = F.when(F.col(rank).between(1, 3), 3).otherwise(1)
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(-i).alias("first"), hits(F.col(low), p).alias("h")) for i, (n, p) in enumerate(rules)]))
    s = papers.select(group, paper, weight.alias("w"), x.alias("x")).where("x.h > 0").groupBy(group, "x.label", "x.first").agg(F.sum("w").alias("weighted"), F.count(F.lit(1)).alias("support"), F.sum("x.h").alias("matches"))
    best = s.groupBy(group).agg(F.max(F.struct("weighted", "support", "matches", "first", "label")).alias("b"))
    enough = F.col("b.support") >= least_support(F.col("n"))
    return sizes.join(best, group, "left").select(group, "n", F.when(enough, F.col("b.label")).otherwise(F.lit("")).alias("subtype"), F.coalesce("b.support", F.lit(0).cast("long")).alias("support"))


def facets(papers: DataFrame, group: str, paper: str, low: str, phrases: tuple[str, ...], most: int = 4) -> DataFrame:
    """(group, ``place, phrase, papers, share``): phrases in enough papers of the cluster, by
    count, share and phrase length, equal ones by name."""
    from quirelight.functions.text import boundary_count

    sizes = papers.groupBy(group).agg(F.countDistinct(paper).alias("n"))
    x = F.explode(F.array_compact(F.array(*[F.when(boundary_count(F.col(low), p) > 0, F.lit(p)) for p in phrases])))
    n = papers.select(group, paper, x.alias("phrase")).groupBy(group, "phrase").agg(F.countDistinct(paper).alias("papers")).join(sizes, group)
    share = F.col("papers") / F.col("n")
    kept = n.where((F.col("papers") >= F.when(F.col("n") <= 4, 1).otherwise(2)) | (share >= 0.25)).withColumn("share", share)
    w = W.partitionBy(group).orderBy(F.desc("papers"), F.desc("share"), F.desc(F.length("phrase")), "phrase")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(group, "place", "phrase", "papers", "share")


def lexical_types(papers: DataFrame, group: str, paper: str, low: str, lexicon: dict[str, tuple[str, ...]], most: int = 3) -> DataFrame:
    """(group, ``place, type, papers, hits``): types by papers that name them, then weighted
    hits (2 for a phrase of several words, else 1), then the lexicon's order."""
    from quirelight.functions.text import boundary_count

    def total(words: tuple[str, ...]) -> Column:
        out = F.lit(0)
        for t in words:
            out = out + boundary_count(F.col(low), t) * (2 if " " in t else 1)
        return out

    x = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(i).alias("o"), total(v).alias("h")) for i, (k, v) in enumerate(lexicon.items())]))
    s = papers.select(group, paper, x.alias("x")).where("x.h > 0").groupBy(group, "x.type", "x.o").agg(F.countDistinct(paper).alias("papers"), F.sum("x.h").alias("hits"))
    w = W.partitionBy(group).orderBy(F.desc("papers"), F.desc("hits"), "o")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(group, "place", "type", "papers", "hits")


def group_scores(df: DataFrame, keep: list[str], low: str, lexicon: dict[str, tuple[str, ...]], most: int = 2) -> DataFrame:
    """(keep, ``place, label, score``): labels by summed hits (3 for a phrase of several words,
    else 1), then label length, then name; labels without hits are left out."""
    from quirelight.functions.text import boundary_count

    def total(words: tuple[str, ...]) -> Column:
        out = F.lit(0)
        for t in words:
            out = out + boundary_count(F.col(low), t) * (3 if " " in t else 1)
        return out

    scored = F.array(*[F.struct((-total(v)).alias("a"), F.lit(-len(k)).alias("b"), F.lit(k).alias("label")) for k, v in lexicon.items()])
    top = F.slice(F.array_sort(F.filter(scored, lambda s: s["a"] < 0)), 1, most)
    return df.select(*keep, F.posexplode(top).alias("p", "x")).select(*keep, (F.col("p") + 1).alias("place"), F.col("x.label").alias("label"), (-F.col("x.a")).alias("score"))


def needle_choice(c: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The rule with most of its needles in the text, the first of equals; none: null."""
    scored = F.array(*[F.struct(sum((c.contains(n).cast("int") for n in ns), F.lit(0)).alias("h"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, ns) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["h"] > 0, best["name"])
