"""Problem 5: the application areas in which each paper's abstract sets its study.

Bisecting k-means over the normalised vectors of statements; leaves are labelled by
discriminative terms; a document gets the subjects of the leaves its statements lie near:
areas come from leaf mixtures alone, never from a word by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.papers import one_row_per_paper, with_text
from quirelight.session import materialise

#: Hand-labelled papers that the subject model is fitted on, at most (taken by hash).
LABEL_LIMIT = 12_000
#: Distinct subject vectors that fit the tree, at most (the commonest); all are assigned.
VECTOR_LIMIT = 20_000
LEAVES = 400
#: How sharply a statement belongs to its nearest leaves (power of the cosine); share of a
#: statement's leaf mixture from which on it treats an area.
SHARPNESS, FLOOR = 8, 0.25
NONE = "generic"

_SENTENCE = re.compile(r"(?<=[.!?])[\"”»)]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def statements(text: str) -> list[list[str]]:
    """The words of each sentence, in lower case, numbers left out."""
    return [w for s in _SENTENCE.split(text) if (w := _WORD.findall(s.lower()))]


def bisecting_kmeans(x: np.ndarray, weight: np.ndarray, leaves: int, seed: int = 5, rounds: int = 25) -> np.ndarray:
    """Leaf number of every row of ``x`` (unit vectors), splitting the leaf of largest spread."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int32)
    spread = {0: _spread(x, weight)}
    while len(spread) < leaves:
        worst = max(spread, key=lambda k: (spread[k], -k))
        if spread[worst] <= 1e-9:
            break
        rows = np.flatnonzero(label == worst)
        part = _halve(x[rows], weight[rows], rng, rounds)
        if part.all() or not part.any():
            spread[worst] = 0.0
            continue
        new = max(spread) + 1
        label[rows[part]] = new
        spread[worst] = _spread(x[rows[~part]], weight[rows[~part]])
        spread[new] = _spread(x[rows[part]], weight[rows[part]])
    return label


def _spread(x: np.ndarray, w: np.ndarray) -> float:
    return float(w.sum() - np.linalg.norm(w @ x)) if len(x) > 1 else 0.0


def _halve(x: np.ndarray, w: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Two-means by cosine; the first centre is drawn, the second is the row least like it."""
    best, best_score = np.zeros(len(x), bool), -1.0
    for _ in range(3):
        a = x[rng.choice(len(x), p=w / w.sum())]
        c = np.stack([a, x[int(np.argmin(x @ a))]])
        part = np.zeros(len(x), bool)
        for _ in range(rounds):
            s = x @ c.T
            new = s[:, 1] > s[:, 0]
            if (new == part).all() and _ > 0:
                break
            part = new
            for k, m in ((0, ~part), (1, part)):
                if m.any():
                    v = w[m] @ x[m]
                    c[k] = v / (np.linalg.norm(v) + 1e-12)
        score = sum(float(np.linalg.norm(w[m] @ x[m])) for m in (part, ~part) if m.any())
        if score > best_score:
            best, best_score = part, score
    return best


class SubjectModel:
    """Fitted on labelled abstracts: subject terms, the tree of leaves, and cue words.

    A statement's subject terms place it in a leaf; the leaf's mixture over areas comes from
    the labels of the papers whose statements fall into it. Its other words are cues for
    whether the study is set there or the place only mentioned.
    """

    def __init__(self) -> None:
        self.lift: dict[str, tuple[str, float]] = {}
        self.leaf: dict[tuple[str, ...], int] = {}
        self.labels: list[list[str]] = []
        self.areas_known: list[str] = []
        self.shares = np.zeros((0, 0))
        self.near: dict[tuple[str, ...], dict[str, float]] = {}
        self.cue: dict[str, float] = {}
        self.bias = 0.0
        self.idf: dict[str, float] = {}
        self.centres = np.zeros((0, 0))
        self.column: dict[str, int] = {}

    # -- fitting --

    def fit(self, docs: list[tuple[list[list[str]], frozenset[str]]]) -> SubjectModel:
        self._terms(docs)
        vectors: Counter = Counter()
        for sents, _ in docs:
            for s in sents:
                if t := self.terms(s):
                    vectors[t] += 1
        self._tree(vectors, docs)
        self._cues(docs)
        return self

    def _terms(self, docs: list[tuple[list[list[str]], frozenset[str]]]) -> None:
        """Words whose papers carry one area far more often than all papers do."""
        n = len(docs)
        area_n = Counter(a for _, y in docs for a in y if a != NONE)
        df: Counter = Counter()
        joint: Counter = Counter()
        for sents, y in docs:
            words = {w for s in sents for w in s}
            df.update(words)
            joint.update((w, a) for w in words for a in y if a != NONE)
        by_word: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for (w, a), k in joint.items():
            by_word[w].append((a, k))
        self.idf = {}
        for w, k in df.items():
            best = None
            for a, j in by_word.get(w, ()):
                p, q = j / k, area_n[a] / n
                if p > q:
                    g = 2 * (j * math.log(p / q) + ((k - j) * math.log((1 - p) / (1 - q)) if j < k else 0.0))
                    if best is None or g > best[0]:
                        best = (g, a, p, q)
            if best and best[0] > 12.0 and best[2] > 0.33 and best[2] > 3 * best[3] and k >= 3:
                self.lift[w] = (best[1], best[2])
                self.idf[w] = math.log((1 + n) / k) * best[2]

    def terms(self, sentence: list[str]) -> tuple[str, ...]:
        return tuple(sorted({w for w in sentence if w in self.lift}))

    def _vector(self, terms: tuple[str, ...]) -> np.ndarray:
        v = np.zeros(len(self.column))
        for w in terms:
            if w in self.column:
                v[self.column[w]] = self.idf[w]
        return v / (np.linalg.norm(v) + 1e-12)

    def _tree(self, vectors: Counter, docs: list[tuple[list[list[str]], frozenset[str]]]) -> None:
        self.column = {w: i for i, w in enumerate(sorted(self.lift))}
        fit = [t for t, _ in sorted(vectors.items(), key=lambda v: (-v[1], v[0]))[:VECTOR_LIMIT]]
        if not fit:
            return
        x = np.stack([self._vector(t) for t in fit])
        w = np.array([vectors[t] for t in fit], float)
        label = bisecting_kmeans(x, w, min(LEAVES, len(fit)))
        n_leaf = int(label.max()) + 1
        self.centres = np.stack([(w[label == k] @ x[label == k]) for k in range(n_leaf)])
        self.centres /= np.linalg.norm(self.centres, axis=1, keepdims=True) + 1e-12
        self.leaf = {t: int(k) for t, k in zip(fit, label)}
        self._mixtures(docs)
        words = [Counter() for _ in range(n_leaf)]
        for sents, _ in docs:
            for terms in (t for s in sents if (t := self.terms(s))):
                words[self.leaf_of(terms)].update(terms)
        everywhere = sum(words, Counter())
        self.labels = [[w for w, _ in sorted(words[k].items(), key=lambda v: (-v[1] * math.log(1 + v[1] / (1 + everywhere[v[0]] - v[1])), v[0]))[:5]] for k in range(n_leaf)]

    def _mixtures(self, docs: list[tuple[list[list[str]], frozenset[str]]], rounds: int = 12) -> None:
        """Each leaf's mixture over areas, by expectation-maximisation: every label of a paper
        stems from one of the leaves its statements lie near, or from none of them. A leaf that
        only stands beside another one thus takes no share in that one's area."""
        self.areas_known = sorted({a for _, y in docs for a in y if a != NONE})
        column = {a: j for j, a in enumerate(self.areas_known)}
        k, m = len(self.centres), len(self.areas_known)
        cases = []
        seen = np.full(k, 1.0)
        for sents, y in docs:
            near = np.zeros(k)
            for s in sents:
                if t := self.terms(s):
                    near = np.maximum(near, self.nearness(t))
            seen += near
            at = np.flatnonzero(near > 0.05)
            cases.append((at, near[at], [column[a] for a in y if a != NONE]))
        table = np.full((k, m), 1.0 / max(m, 1))
        none = np.full(m, 0.02 / max(m, 1))
        for _ in range(rounds):
            count, lost = np.zeros((k, m)), np.zeros(m)
            for at, w, ys in cases:
                for j in ys:
                    p = w * table[at, j]
                    z = float(p.sum()) + none[j]
                    count[at, j] += p / z
                    lost[j] += none[j] / z
            table = count / seen[:, None]
            none = lost / len(docs)
        # a share of one is a leaf whose statements nearly always bring the area with them
        self.shares = np.minimum(table / np.maximum(table.sum(1, keepdims=True), 0.35), 1.0)

    def nearness(self, terms: tuple[str, ...]) -> np.ndarray:
        """How near a statement lies to every leaf, all together 1."""
        w = np.maximum(self.centres @ self._vector(terms), 0.0) ** SHARPNESS
        return w / max(float(w.sum()), 1e-12)

    def leaf_of(self, terms: tuple[str, ...]) -> int:
        if terms not in self.leaf:
            self.leaf[terms] = int(np.argmax(self.centres @ self._vector(terms)))
        return self.leaf[terms]

    def subjects(self, terms: tuple[str, ...]) -> dict[str, float]:
        """The statement's leaf mixture: the mixtures of the leaves, each weighted by how near
        the statement lies to it. A statement of two areas lies between their leaves."""
        if terms not in self.near:
            mix = self.nearness(terms) @ self.shares
            self.near[terms] = {a: float(v) for a, v in zip(self.areas_known, mix) if v > 0}
        return self.near[terms]

    def _cue_words(self, sentence: list[str]) -> list[str]:
        rest = [w for w in sentence if w not in self.lift]
        return [*{f"c={w}" for w in rest}, *{f"d={a} {b}" for a, b in zip(sentence, sentence[1:]) if a not in self.lift or b not in self.lift}, f"n{min(len(self.terms(sentence)), 4)}"]

    def _cues(self, docs: list[tuple[list[list[str]], frozenset[str]]]) -> None:
        """Logistic regression on cue words: is the area of a statement among the labels?"""
        rows = []
        df: Counter = Counter()
        for sents, y in docs:
            for s in sents:
                t = self.terms(s)
                if not t:
                    continue
                mix = self.subjects(t)
                if not mix:
                    continue
                a = max(mix.items(), key=lambda v: (v[1], v[0]))[0]
                feats = self._cue_words(s) + [f"t={'+'.join(t)}"]
                df.update(feats)
                rows.append((feats, a in y))
        if not rows:
            return
        w: dict[str, float] = defaultdict(float)
        rng = np.random.default_rng(3)
        bias = 0.0
        for epoch in range(12):
            rate = 0.3 / (1 + epoch)
            for i in rng.permutation(len(rows)):
                feats, y = rows[i]
                feats = [f for f in feats if df[f] >= 3]
                z = bias + sum(w[f] for f in feats)
                g = (1.0 if y else 0.0) - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                bias += rate * g * 0.3
                for f in feats:
                    w[f] += rate * (g - 0.002 * w[f])
        self.cue, self.bias = dict(w), bias

    # -- use --

    def areas(self, sents: list[list[str]], floor: float = FLOOR) -> dict[str, float]:
        """Weight of each area in which the text is set; none: ``generic``."""
        found: dict[str, float] = {}
        for s in sents:
            t = self.terms(s)
            if not t:
                continue
            z = self.bias + sum(self.cue.get(f, 0.0) for f in [*self._cue_words(s), f"t={'+'.join(t)}"])
            set_there = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            if set_there <= 0.5:
                continue
            for a, v in self.subjects(t).items():
                if v >= floor:
                    found[a] = max(found.get(a, 0.0), v * set_there)
        return found or {NONE: 1.0}


def fit_subjects(papers: DataFrame, labels: DataFrame) -> tuple[SubjectModel, DataFrame]:
    """The model fitted on at most ``LABEL_LIMIT`` labelled papers, and all abstracts."""
    texts = materialise(with_text(one_row_per_paper(papers, "abstract"), "abstract"), "abstracts")
    hand = labels.where("paper_id is not null and area is not null").groupBy("paper_id").agg(F.collect_set(F.lower(F.trim("area"))).alias("areas"))
    rows = texts.join(hand, "paper_id").orderBy(F.xxhash64("paper_id"), "paper_id").limit(LABEL_LIMIT).collect()
    return SubjectModel().fit([(statements(r["abstract"]), frozenset(r["areas"])) for r in rows]), texts


def subject_areas(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """``paper_id, area, weight``: every area in which a paper's study is set.

    A paper set in none has ``generic``; blank abstracts have no row. Without labels all
    papers are ``generic``. The cluster-level domain lists were measured as a further hint
    and left out: of the areas they name for hand-labelled papers 18 in 100 are right (check_l).
    Abstracts are assigned where they lie; the model, bounded by its parameters, is sent to
    every task.
    """
    model, texts = fit_subjects(papers, labels)
    shared = papers.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = [(p, a, v) for p, t in zip(pdf["paper_id"], pdf["abstract"]) for a, v in m.areas(statements(t)).items()]
            yield pd.DataFrame(rows, columns=["paper_id", "area", "weight"])

    return texts.mapInPandas(run, "paper_id string, area string, weight double")


def area_shares(assigned: DataFrame) -> DataFrame:
    """``area, papers, share``: how much of the collection each area has."""
    assigned = materialise(assigned.select("paper_id", "area"), "areas")
    per = assigned.groupBy("area").agg(F.countDistinct("paper_id").alias("papers"))
    total = assigned.select("paper_id").distinct().count()
    return per.select("area", "papers", (F.col("papers") / F.lit(float(max(total, 1)))).alias("share"))
