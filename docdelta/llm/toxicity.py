"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each model is a logistic regression over the words
and the character n-grams of words that a text holds, and over the probabilities of the categories
before it; for the training rows those come from models that did not see them (out of fold), so a
later model learns from probabilities as good as it will get. Features too are chosen for each fold
without its rows. The training rows are a bounded sample; features are counted and documents scored by
Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docdelta.llm.common import mapped, names_beside, quoted, small_batches, written

#: At most so many labelled rows of either class of the last category are trained on.
SAMPLE = 2500
#: Features that a model sees, shared out among the categories: a size of the model, whatever the data.
FEATURES = 3000
#: Rows of the sample that must hold a feature before it can be chosen.
MIN_ROWS = 3
FOLDS = 5
LEAST_CUTOFF = 0.25
_SPACE = 1 << 24
_NGRAMS = (4, 5)
_WORD = re.compile(r"\w+")
_CACHE = 200_000


def word_features(word: str) -> list[int]:
    """Hashes of the whole word and of the n-grams of the word between its edges."""
    edged = f"<{word}>"
    parts = {edged, *(edged[i : i + n] for n in _NGRAMS for i in range(len(edged) - n + 1))}
    return [xxhash.xxh3_64_intdigest(x.encode()) % _SPACE for x in parts]


def tokens(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Chain:
    """Logistic models in order; each takes the features and the probabilities of those before it."""

    def __init__(self, features: np.ndarray, weights: list[np.ndarray], biases: list[float], cutoff: float):
        self.place = {int(x): i for i, x in enumerate(features)}
        self.weights, self.biases, self.cutoff = weights, biases, cutoff
        self.cache: dict[str, tuple[int, ...]] = {}

    def present(self, text: str | None) -> list[int]:
        """The places of the features in the whole text."""
        out: set[int] = set()
        for word in tokens(text):
            own = self.cache.get(word)
            if own is None:
                if len(self.cache) >= _CACHE:
                    self.cache.clear()
                own = self.cache[word] = tuple(self.place[x] for x in word_features(word) if x in self.place)
            if own:
                out.update(own)
        return list(out)

    def probabilities(self, text: str | None) -> list[float]:
        at = self.present(text)
        before: list[float] = []
        for w, b in zip(self.weights, self.biases, strict=True):
            z = b + float(w[at].sum()) + sum(x * y for x, y in zip(w[len(self.place) :], before, strict=False))
            before.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return [float(x) for x in before]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with running moments; deterministic."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y).astype(np.float32) / len(y)
        g, gb = x.T @ e + l2 * w, float(e.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= (0.1 * (m / a) / (np.sqrt(v / c) + 1e-6)).astype(np.float32)
        b -= 0.1 * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return w, float(b)


def fit_chain(features: np.ndarray, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray | None = None, chosen: list[np.ndarray] | None = None) -> Chain:
    """labels: a column for each category. weight: of each row when the cut-off is chosen. fold: of each row.

    chosen[f] are the columns of x that the models without fold f see, chosen[-1] those of the last models; all if None.
    """
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    chosen = [np.arange(x.shape[1])] * (FOLDS + 1) if chosen is None else chosen
    weights, biases = [], []
    before, out_of_fold = np.empty((len(x), 0), np.float32), np.zeros(len(x))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float32)
        out_of_fold = np.zeros(len(x))
        for f, columns in enumerate(chosen[:-1]):
            seen = fold != f
            if seen.all():
                continue
            w, b = fit_logistic(np.column_stack((x[seen][:, columns], before[seen])), y[seen])
            out_of_fold[~seen] = 1 / (1 + np.exp(-np.clip(np.column_stack((x[~seen][:, columns], before[~seen])) @ w + b, -30, 30)))
        w, b = fit_logistic(np.column_stack((x[:, chosen[-1]], before)), y)
        weights.append(w)
        biases.append(b)
        before = np.column_stack((before, out_of_fold)).astype(np.float32)
    return Chain(features[chosen[-1]], weights, biases, _cutoff(out_of_fold, labels[:, -1], weight))


def _cutoff(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which a row counts as positive: the best F1 over the rows as weighted, but no
    less than LEAST_CUTOFF, where few rows could put it among the probabilities of clean ones."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hit, picked = np.cumsum(weight * y), np.cumsum(weight)
    last = np.append(p[1:] < p[:-1], True)
    f1 = np.where(last, 2 * hit / (picked + hit[-1] + 1e-9), 0)
    best = f1.max(initial=0)
    ok = np.flatnonzero(f1 >= best - 1e-9)
    if not len(ok) or best == 0:
        return 1.0
    i = ok[0]
    return max(LEAST_CUTOFF, float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """The chain over `categories`, columns of labels with 0 or 1; None without rows of both classes.

    At most `sample` rows of either class of the last category, the first by hash of the id, are
    trained on. Rows that lack an id or a label are left out; of repeated labels the largest counts.
    Each model sees `features` features, the likeliest to tell a category by chi-square among its own
    training rows; ties go to the smaller hash.
    """
    last = categories[-1]
    own = [F.max(F.col(c).cast("int")).alias(c) for c in categories]
    known = labels.select(F.col(id_col).cast("long").alias("id"), *categories).dropna().groupBy("id").agg(*own)
    counts = {int(r[last] > 0): r["count"] for r in known.groupBy(last).count().collect()}
    if set(counts) != {0, 1}:
        return None
    picked = [known.where(F.col(last) == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(picked, "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({y for w in tokens(x) for y in word_features(w)}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.list_(pa.int32()))], ["id", *categories, "features"])

    small_batches(docs.sparkSession)
    plan = ", ".join(f"`{c}` int" for c in categories)
    rows = written(texts.select("id", "text", *categories).mapInArrow(describe, f"id long, {plan}, features array<int>"), "toxicity")

    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int"))
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("all"), *[F.sum(c).alias(f"in_{c}") for c in categories]).collect()}
    if not sizes:
        return None
    # Of every feature its rows by fold, so that each fold's features can be chosen without the fold.
    parts = ["all", *(f"in_{c}" for c in categories)]
    each = rows.select(F.explode("features").alias("feature"), "fold", F.lit(1).alias("all"), *[F.col(c).alias(f"in_{c}") for c in categories])
    each = each.groupBy("feature").agg(*[F.sum(F.when(F.col("fold") == f, F.col(x)).otherwise(0)).alias(f"{x}_{f}") for f in range(FOLDS) for x in parts])
    each = written(each.where(sum(F.col(f"all_{f}") for f in range(FOLDS)) >= MIN_ROWS), "features")
    best: list[set[int]] = []
    for left_out in (*range(FOLDS), None):
        seen = [f for f in range(FOLDS) if f != left_out]
        n = float(sum(sizes[f]["all"] for f in seen if f in sizes))
        held = sum(F.col(f"all_{f}") for f in seen)
        own: set[int] = set()
        for c in categories:
            positive = float(sum(sizes[f][f"in_{c}"] for f in seen if f in sizes))
            gap = sum(F.col(f"in_{c}_{f}") for f in seen) * F.lit(n) - held * F.lit(positive)
            chi2 = gap * gap / (held * (F.lit(n) - held + 1))
            own |= {r.feature for r in each.where(held > 0).orderBy(F.desc(chi2), "feature").select("feature").limit(features // len(categories)).collect()}
        best.append(own)
    names = np.array(sorted(set().union(*best)), np.int64)
    kept = rows.select("id", "fold", *categories, F.array_intersect("features", F.array(*[]).cast("array<int>") if not len(names) else F.lit(names.tolist()).cast("array<int>")).alias("at")).orderBy("id")
    got = kept.collect()
    x = np.zeros((len(got), len(names)), np.float32)
    for i, r in enumerate(got):
        x[i, np.searchsorted(names, r["at"])] = 1
    y = np.array([[r[c] > 0 for c in categories] for r in got], np.float32).reshape(len(got), len(categories))
    share = {k: counts[k] / max(1, (y[:, -1] == k).sum()) for k in (0, 1)}
    chosen = [np.searchsorted(names, np.array(sorted(own), np.int64)) for own in best]
    return fit_chain(names, x, y, np.where(y[:, -1] == 1, share[1], share[0]), np.array([r["fold"] for r in got]), chosen)


def classify(docs: DataFrame, chain: Chain | None, categories: Sequence[str], text_col: str = "text") -> DataFrame:
    """Every row of docs with p_<category> for each category and is_<last category> before its own columns.

    A null or empty text has no features and gets the probabilities of the biases alone. A probability
    equal to the cut-off is flagged. Without a chain all probabilities are 0 and nothing is flagged. A
    column named like a new one gets `_input` behind its name.
    """
    names = [f"p_{c}" for c in categories]
    out = StructType()
    for x in names:
        out = out.add(x, "double")
    out = out.add(f"is_{categories[-1]}", "boolean")
    if chain is None:
        own = names_beside(out.names, docs.columns)
        return docs.select(*[F.lit(0.0).alias(x) for x in names], F.lit(False).alias(out.names[-1]), *[quoted(x).alias(y) for x, y in zip(docs.columns, own, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(chain.place), np.int64), chain.weights, chain.biases, chain.cutoff))

    def make():
        own = Chain(*shared.value)

        def predict(texts: pa.Array) -> list[pa.Array]:
            p = np.array([own.probabilities(x) for x in texts.to_pylist()]).reshape(len(texts), len(names))
            return [*(pa.array(x) for x in p.T), pa.array(p[:, -1] >= own.cutoff)]

        return predict

    return mapped(docs, [quoted(text_col)], out, make)
