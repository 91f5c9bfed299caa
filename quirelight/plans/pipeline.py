"""The whole analysis as one plan: prepare, gate, vectorise, cluster, rank, label, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import clustering as K
from quirelight.operators import coding as Y
from quirelight.operators import contexts as C
from quirelight.operators import evidence as E
from quirelight.operators import geometry as G
from quirelight.operators import labels as L
from quirelight.operators import relational as R
from quirelight.operators import topics as T
from quirelight.operators import vectors as V
from quirelight.session import materialise
from quirelight.sources import writers


#: Facets that papers of a cluster share, by the part they describe; callers may pass others.
FACETS = {
    "artifact": ("toolkit", "prototype", "checklist", "card deck", "sketchbook", "workbook", "dashboard", "template", "storyboard"),
    "context": ("classroom", "hospital", "studio", "workshop", "factory", "office", "city", "home"),
    "method": ("interviews", "diary study", "field trial", "case study", "log analysis", "observation", "remote survey", "comparative reading"),
}


@dataclass(frozen=True)
class Options:
    """Parameters of a run; the defaults are those of a batch over keyword groups."""

    methods: tuple[str, ...] = ("kmeans", "hdbscan")
    view: str = "overall"
    focus: str | None = None
    min_papers: int = 10
    k: int | None = None
    select_k: bool = True
    k_min: int = 2
    k_max: int = 8
    starts: int = 10
    min_samples: int = 4
    min_cluster_size: int = 5
    eps: float | None = None
    context_paragraphs: int = 6
    features: int = 8000
    dims: int = 50
    topics: int = 6
    embedding: str = "tfidf-svd"


def texts(papers: DataFrame, contexts: DataFrame, o: Options) -> DataFrame:
    """(``paper_id, keyword, title, year, text, low``): each paper's text in the chosen view."""
    vocabulary = C.keyword_terms(X.KEYWORDS[0] if o.focus is None else o.focus)
    c = contexts.select("paper_id", F.coalesce("extracted_context", F.lit("")).alias("extracted_context"), F.coalesce("discussion_summary", F.lit("")).alias("discussion_summary"), F.coalesce("discussion_excerpt", F.lit("")).alias("discussion_excerpt"))
    joined = papers.join(c, "paper_id", "left")
    v = C.top_context(joined, "extracted_context", vocabulary, o.context_paragraphs)
    view = C.overall_view(o.focus) if o.view == "overall" else C.view_text(o.view, o.focus)
    low = F.lower(F.concat_ws(" ", *[X.text(k) for k in ("title", "abstract", "discussion_summary", "discussion_excerpt")]))
    return v.select("paper_id", "keyword", "title", "year", view.alias("text"), low.alias("low"), "matched")


def _features(body: DataFrame, o: Options) -> DataFrame:
    """(``paper_id, vector``): one corpus-wide TF-IDF and reduction that serves all groups."""
    counts = materialise(V.token_counts(body, "paper_id", "text", (1, 2)), "counts")
    n = body.count()
    weights = V.tfidf(counts, "paper_id", V.vocabulary(counts, 2, o.features), n)
    return materialise(V.svd_features(weights, "paper_id", max(2, min(o.dims, n - 1))), "features")


def _labelled(member: DataFrame, gate: DataFrame, method: str, o: Options) -> tuple[DataFrame, DataFrame | None]:
    """(``keyword, cluster_method, paper_id, cluster, peripheral, silhouette``) of all groups,
    and k-means' selection table. A keyword is a key of every step, so that any number of
    groups takes the same passes."""
    sized = gate.where("status = 'clustered'").select("keyword", F.col("n").cast("int").alias("n"))
    if method == "kmeans":
        low, high = R.cluster_bounds(F.col("n"), o.k_min, o.k_max)
        fixed = o.k if o.k else None if o.select_k else 6
        bounds = sized.select("keyword", *((F.lit(fixed).alias("low"), F.lit(fixed).alias("high")) if fixed else (low.alias("low"), high.alias("high"))))
        labels, table = K.kmeans_groups(member, "keyword", "paper_id", "vector", bounds, starts=o.starts)
        done = labels.join(table.where("selected").select("keyword", "clusters"), ["keyword", "clusters"]).withColumn("peripheral", F.lit(False))
        return done.select("keyword", F.lit(method).alias("cluster_method"), "paper_id", "cluster", "peripheral", "silhouette"), table
    scaled = materialise(sized.withColumns(R.density_parameters(F.col("n"), o.min_cluster_size, o.min_samples, o.topics)), "scaled")
    found = None
    # at most min_samples times min_cluster_size settings, whatever the number of groups
    for r in scaled.select("min_samples", "min_cluster_size").distinct().orderBy("min_samples", "min_cluster_size").collect():
        groups = scaled.where((F.col("min_samples") == r[0]) & (F.col("min_cluster_size") == r[1])).select("keyword")
        one = K.density_clusters(member.join(groups, "keyword"), "keyword", "paper_id", "vector", method, eps=o.eps, min_samples=r[0], min_cluster_size=r[1])
        found = one if found is None else found.unionByName(one)
    raw = materialise(found, "density")
    if method == "hdbscan":
        done = K.soft_groups(member.select("keyword", "paper_id", "vector").join(raw, ["keyword", "paper_id"]), "keyword", "paper_id", "cluster", "vector")
    else:
        done = raw.withColumn("peripheral", F.lit(False))
    return done.select("keyword", F.lit(method).alias("cluster_method"), "paper_id", "cluster", "peripheral", F.lit(None).cast("double").alias("silhouette")), None


def _evidence(s: DataFrame, real: DataFrame, contexts: DataFrame, o: Options) -> DataFrame:
    """Source evidence of every cluster: the paragraphs of its papers' full texts that carry
    its terms, chosen per cluster. ``s`` has the clusters' term lists."""
    wanted = F.array_distinct(F.filter(F.flatten(F.array("evidence_list", "phrases", "facet_list", "dominant_list")), lambda t: F.trim(t) != ""))
    asked = s.select("g", wanted.alias("_terms"), F.array(F.lower("keyword")).alias("_keys"))
    parts = contexts.select("paper_id", F.posexplode(X.fulltext_paragraphs(F.coalesce("extracted_context", F.lit("")))).alias("paragraph_index", "paragraph"))
    rows = real.select("g", "paper_id", F.col("is_representative_top3").alias("_rep")).join(asked, "g").join(parts, "paper_id")
    scored = rows.withColumn("breakdown", E.score_paragraph(F.col("paragraph"), F.col("_terms"), F.col("_keys"), F.col("_rep")))
    scored = scored.where("breakdown.total >= 3.0").withColumn("sentences", E.claim_sentences(F.col("paragraph"), F.col("_terms")))
    return E.select_evidence(scored.select("g", "paper_id", "paragraph_index", "paragraph", "sentences", F.col("breakdown.total").alias("score")), "g")


def run(spark: SparkSession, papers: DataFrame, contexts: DataFrame, o: Options = Options()) -> dict[str, DataFrame]:
    """The whole analysis, as frames by name.

    ``papers``: a row per keyword, method and paper, with cluster, ranks, layout, topic and
    status; ``clusters``: label, summary, terms, facets, codes and faithfulness per cluster, noise
    with a record of its own; ``keywords``: size and status; ``evidence``: source passages per
    cluster; ``neighbours``: the five nearest papers of every representative; ``selection``: the
    silhouette table of k-means; ``metadata``: one row; ``report``: Markdown lines; ``payload``: the
    explorer's JSON per keyword. The groups are partition keys, not separate runs; groups
    under ``min_papers`` pass through as ``too_few_papers``.
    """
    p = R.prepare(papers)
    ks = R.paper_keywords(p).select("paper_id", "keyword")
    if o.focus:
        ks = ks.where(X.phrase(F.col("keyword")) == X.phrase(X.canonical_keyword(F.lit(o.focus))))
    gate = materialise(R.size_gate(ks, o.min_papers), "gate")
    full = materialise(R.latest_contexts(contexts), "contexts")
    body = materialise(texts(p, full, o), "texts")
    keywords = gate.withColumns({"methods": F.lit("|".join(o.methods)), "summary": F.when(F.col("status") == "clustered", F.lit("")).otherwise(F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(f" papers; clusters need {o.min_papers}.")))})
    few = ks.join(keywords.where("status != 'clustered'").select("keyword", "status", F.col("summary").alias("label")), "keyword")
    small = few.select("keyword", F.col("status").alias("cluster_status"), "paper_id", "label", F.lit(False).alias("is_representative_top3"))
    metadata = writers.run_metadata(ks, list(o.methods), o.view, o.embedding, o.min_papers)
    if gate.where("status = 'clustered'").limit(1).count() == 0:
        return {"papers": small, "clusters": small.limit(0), "keywords": keywords, "metadata": metadata}
    vec = _features(body, o)
    member = materialise(ks.join(gate.where("status = 'clustered'").select("keyword", "n"), "keyword").join(vec, "paper_id"), "member")
    every = selection = None
    for method in o.methods:
        done, table = _labelled(member, gate, method, o)
        selection = table if table is not None else selection
        every = done if every is None else every.unionByName(done)
    every = materialise(every.withColumn("g", F.concat_ws("|", "keyword", "cluster_method", F.col("cluster").cast("string"))), "clustered")
    geo = G.with_geometry(every.withColumn("c", F.when(F.col("cluster") == -1, F.lit("-1")).otherwise(F.col("g"))).join(vec, "paper_id").select(F.struct("g", "paper_id").alias("k"), "c", "vector"), "k", "c", "vector")
    geo = geo.select("k.*", "distance_to_centroid", "representative_rank", "medoid_rank", "is_representative_top3")
    ranked = every.join(geo, ["g", "paper_id"]).join(body.select("paper_id", "title", "low"), "paper_id")
    plane = K.layout(vec, "paper_id", "vector").select("paper_id", F.col("x").alias("umap_x"), F.col("y").alias("umap_y"))
    topic = T.lda_topics(body, "paper_id", "text", o.topics).select("paper_id", F.col("topic").alias("lda_topic"), F.col("probability").alias("lda_topic_probability"), F.col("words").alias("lda_topic_words"))
    ranked = ranked.join(plane, "paper_id", "left").join(topic, "paper_id", "left")
    noise = F.col("cluster") == -1
    for c in ("representative_rank", "medoid_rank"):
        ranked = ranked.withColumn(c, F.when(noise, -1).otherwise(F.col(c)))
    ranked = materialise(ranked.withColumn("is_representative_top3", F.col("is_representative_top3") & ~noise), "ranked")
    real = ranked.where(~noise)
    clusters = materialise(_coded(ranked, real, ks, full, o), "clusters")
    evidence = materialise(_evidence(clusters, real, full, o), "evidence")
    claims = clusters.select("g", F.explode(X.sentences(F.col("summary"))).alias("claim"))
    trust = E.faithfulness(E.claim_support(claims, evidence, "g", "claim", "sentences"), "g")
    clusters = clusters.join(trust, "g", "left")
    shown = ["label", "summary", "contribution", "secondary", "subtype", "move", "domain", "theme_terms", "distinguishing_evidence_terms", "facets", "qualified_label"]
    out = clusters.select("keyword", "cluster_method", "cluster", "n", *shown, "faithfulness")
    outside = ranked.where(noise).groupBy("keyword", "cluster_method", "cluster").agg(F.count(F.lit(1)).alias("n"))
    out = materialise(out.unionByName(L.noise_record(outside, shown), allowMissingColumns=True), "out")
    rows = ranked.drop("low", "g").withColumn("cluster_status", F.lit("clustered")).join(out.select("keyword", "cluster_method", "cluster", "label", "theme_terms"), ["keyword", "cluster_method", "cluster"], "left")
    asked = ranked.where("is_representative_top3").select("paper_id").distinct().join(vec, "paper_id")
    near = V.nearest(asked, vec, "paper_id", "vector", 5).join(body.select(F.col("paper_id").alias("neighbour"), F.col("title").alias("neighbour_title")), "neighbour", "left")
    near = near.join(every.groupBy(F.col("paper_id").alias("neighbour")).agg(F.array_sort(F.collect_set("g")).alias("neighbour_clusters")), "neighbour", "left")
    lines = writers.cluster_lines(ranked.where(~noise).join(out.select("keyword", "cluster_method", "cluster", F.col("theme_terms").alias("theme")), ["keyword", "cluster_method", "cluster"], "left").withColumnRenamed("representative_rank", "rank"))
    paper = F.struct("paper_id", "title", "cluster", F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))
    shape = ranked.select("keyword", "cluster_method", F.concat_ws("|", "keyword", "cluster_method").alias("part"), paper.alias("p"))
    payload = writers.explorer_payload("Explorer", shape.select("part", "p.*"), out.select(F.concat_ws("|", "keyword", "cluster_method").alias("part"), "cluster", "label", "n"), "part")
    result = {"papers": rows.unionByName(small, allowMissingColumns=True), "clusters": out, "keywords": keywords, "evidence": evidence, "neighbours": near, "metadata": metadata, "report": lines, "payload": payload}
    return result if selection is None else result | {"selection": selection}


def _coded(ranked: DataFrame, real: DataFrame, ks: DataFrame, contexts: DataFrame, o: Options) -> DataFrame:
    """One row per real cluster (``g``): codes, terms, facets, label and summary."""
    noise = F.col("cluster") == -1
    theme = T.ctfidf(ranked.select(F.when(noise, F.lit("-1")).otherwise(F.col("g")).alias("g"), "paper_id", F.col("low").alias("text")).where("g != '-1'"), "g", "paper_id", "text")
    con = Y.contribution(real, "g", "paper_id", "low").join(Y.theory_move(real, "g", "paper_id", "low").select("g", "move"), "g")
    # the subtype belongs to the cluster's own contribution: one pass per key of the codebook
    sub = None
    for key in sorted(Y.SUBTYPES):
        one = Y.subtype(real.join(con.where(F.col("contribution") == key).select("g"), "g"), "g", "paper_id", "low", "representative_rank", key).select("g", "subtype")
        sub = one if sub is None else sub.unionByName(one)
    dom = Y.domains(real, "g", "paper_id", "low").where("place = 1").select("g", "domain")
    lead = real.where("representative_rank between 1 and 3").groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("representative_rank", "title"))), lambda t: t["title"]).alias("titles"), F.min("keyword").alias("keyword"), F.min("cluster_method").alias("cluster_method"), F.min("cluster").alias("cluster"))
    s = con.join(dom, "g").join(lead, "g").join(sub, "g", "left").join(theme, "g", "left")
    for name, phrases in FACETS.items():
        found = Y.facets(real, "g", "paper_id", "low", phrases).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda t: t["phrase"]).alias(f"facet_{name}"))
        s = s.join(found, "g", "left")
    titles = T.title_terms(real, "g", "title", "representative_rank").select("g", F.split("terms", ", ").alias("title_list"))
    named = real.select("g", "paper_id").join(ks.withColumnRenamed("keyword", "_k"), "paper_id")
    main = T.dominant(named, "g", "_k", 2).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("_k").alias("k")))), lambda t: t["k"]).alias("dominant_list"))
    s = s.join(titles, "g", "left").join(main, "g", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("title_list", "dominant_list", *(f"facet_{k}" for k in FACETS))}
    s = s.withColumns({**lists, "subtype": F.coalesce("subtype", F.lit("")), "theme_terms": F.coalesce("terms", F.lit(""))})
    s = s.withColumn("facet_list", F.array_distinct(F.flatten(F.array(*[f"facet_{k}" for k in FACETS]))))
    s = s.withColumn("phrases", T.preferred_phrases(F.filter(F.transform(F.split("theme_terms", ","), lambda t: F.trim(t)), lambda t: t != ""), context=tuple(k.lower() for k in X.KEYWORDS), limit=6))
    words = F.filter(F.split(F.lower(F.array_join("titles", " ")), "[^a-z]+"), lambda w: F.length(w) > 4)
    s = s.withColumn("evidence_list", T.evidence_terms(s, ["title_list", "facet_list", "phrases"], 4, words))
    # a group of one keyword speaks of it: its name is the form
    form = F.when(F.size("dominant_list") == 1, F.lower(F.col("dominant_list")[0])).otherwise(F.lower("keyword"))
    s = s.withColumns({"form": form, "move": Y.conditional_move(F.col("contribution"), F.col("secondary"), F.col("move")), "facets": F.array_join("facet_list", ", "), "distinguishing_evidence_terms": F.array_join("evidence_list", ", ")})
    s = s.withColumn("label", L.hierarchical_label("form", "contribution", "secondary", "subtype", "move", "domain")).withColumn("summary", L.base_summary("n", "contribution", "domain", "titles"))
    first = [F.try_element_at(F.col(f"facet_{k}"), F.lit(1)) for k in FACETS]
    s = s.withColumn("extra", L.facet_suffix(first, F.col("evidence_list"))).withColumn("action", F.try_element_at(F.col("facet_method"), F.lit(1)))
    siblings = ["keyword", "cluster_method"]
    s = s.withColumn("qualified_label", L.numbered(F.col("cluster"), L.qualified(s, siblings, "label", "action")))
    s = L.distinct_labels(s, siblings, "cluster", "label", "extra").drop("label").withColumnRenamed("final_label", "label")
    own = L.unique_phrases(s, siblings, "cluster", "phrases")
    kinds = s.groupBy(*siblings, "contribution").agg(F.count(F.lit(1)).alias("_k"))
    most = kinds.groupBy(*siblings).agg(F.max_by("contribution", F.struct("_k", "contribution")).alias("majority"))
    s = s.join(own, [*siblings, "cluster"], "left").join(most, siblings)
    return s.withColumn("summary", L.contrastive_summary(F.col("summary"), F.coalesce("unique", none), F.col("contribution"), F.col("majority")))


def write(out: dict[str, DataFrame], folder: str) -> None:
    """Every frame of a run: papers partitioned by keyword and method, all other tables as
    Parquet, keywords also as CSV, metadata as JSON, and the Markdown report with the keyword
    status section. The report is one line per cluster."""
    writers.write_table(out["papers"], f"{folder}/papers", ["keyword", "cluster_method"])
    for name in ("clusters", "evidence", "neighbours", "selection", "payload"):
        if name in out:
            writers.write_table(out[name], f"{folder}/{name}")
    writers.write_csv(out["keywords"], f"{folder}/keywords")
    writers.write_json(out["metadata"], f"{folder}/metadata")
    status = out["keywords"].select(F.concat(F.lit("- "), F.col("keyword"), F.lit(": "), F.col("n").cast("string"), F.lit(" papers, "), F.col("status")).alias("value"), F.lit(1).alias("part"), F.col("keyword").alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"))
    head = status.sparkSession.createDataFrame([("# Clusters by keyword and method\n\n## Keywords\n", 0, "", "", 0), ("\n## Clusters\n", 2, "", "", 0)], "value string, part int, a string, b string, c int")
    lines = status.unionByName(head)
    if "report" in out:
        lines = lines.unionByName(out["report"].select(F.col("line").alias("value"), F.lit(3).alias("part"), F.col("keyword").alias("a"), F.col("cluster_method").alias("b"), F.col("cluster").alias("c")))
    lines.orderBy("part", "a", "b", "c").select("value").coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def refresh(papers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Labels of an earlier result recoded without clustering again: every row of ``papers``
    takes its cluster's present label and theme terms, absent columns added as ''."""
    return R.update_where(papers, clusters, ["keyword", "cluster_method", "cluster"], ["label", "theme_terms"])


def refresh_payload(payloads: DataFrame, clusters: DataFrame, part: str = "part") -> DataFrame:
    """Explorer payloads with the present labels: ``payload`` (JSON with ``title, papers,
    clusters``) whose clusters take ``label`` and ``n`` of ``clusters`` (part, ``cluster, label,
    n``), in their own order; a cluster without a present label keeps its own. Papers and
    other parts of the payload stay as they are."""
    shape = "title string, papers array<struct<paper_id string, title string, cluster int, x double, y double>>, clusters array<struct<cluster int, label string, n bigint>>"
    new = clusters.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("label", F.col("n").cast("long").alias("n"))))).alias("_new"))
    v = payloads.withColumn("_v", F.from_json("payload", shape)).join(new, part, "left")

    def fresh(c):
        got = F.try_element_at(F.col("_new"), c["cluster"])
        return F.struct(c["cluster"].alias("cluster"), F.coalesce(got["label"], c["label"]).alias("label"), F.coalesce(got["n"], c["n"]).alias("n"))

    done = F.to_json(F.struct(F.col("_v.title").alias("title"), F.col("_v.papers").alias("papers"), F.transform("_v.clusters", fresh).alias("clusters")))
    return v.withColumn("payload", F.when(F.col("_v").isNull(), F.col("payload")).otherwise(done)).drop("_v", "_new")
