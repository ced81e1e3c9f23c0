"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from SIDE tokens on either side, itself hidden: the sum of one embedding
per place goes through tanh to a two-step softmax, first over classes of words, then over the words
of the class. A document's score is the sum of the log-probabilities of all its tokens.

The words come from the counts over all documents. The most common have outputs of their own in the
network; every other word has one of BUCKETS outputs by its last bytes, times its own share of that
bucket's occurrences. Those shares are a Spark table that grows with the corpus. Tasks hold its NEAR most
common words, and the table is joined to the documents' other words; all words that the corpus lacks have
one share of a bucket together.

Documents are encoded once and dealt by hash to runs of about RUN_TOKENS tokens, and each run to one of
ROUNDS rounds, so every token is trained on once. In a round each of its runs trains a copy of the
network, in numpy and in an order by hash, from a common start; the copies' weighted mean, formed by a
tree of Spark groupings, is the start of the next round and at last the model. Runs depend on the rows
alone, so the model is the same however they are partitioned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docdelta.llm.common import discard, mapped, names_beside, quoted, small_batches, utf8, written
from docdelta.llm.shingles import words

SIDE = 2
WIDTH = 16
CLASSES, PER_CLASS = 32, 64
BUCKETS = 64
VOCABULARY = CLASSES * PER_CLASS - BUCKETS
PAD = CLASSES * PER_CLASS
STEP = 16_384
RATE = 0.15
#: Times that the copies are averaged and go on from their mean.
ROUNDS = 4
#: Tokens of a run, about.
RUN_TOKENS = 500_000
#: Words without outputs of their own whose counts go to every task.
NEAR = 200_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Models that one grouping averages, and the parts that a model is cut into.
FAN_IN, PARTS = 32, 16


def count_words(docs: DataFrame) -> DataFrame:
    """(word, count) over all texts (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "count"])

        for batch in batches:
            for text in utf8(batch.column(0)):
                held.update(words(text))
            if len(held) >= HELD_WORDS:
                yield out()
                held = Counter()
        if held:
            yield out()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


class Vocabulary:
    """Ids of words: the most common ones by rank, buckets of other words behind them.

    others has (hash, log_count) of the other words that occur more than once, near holds the most common
    of them, totals the occurrences of all other words by bucket.
    """

    def __init__(self, ranked: list[bytes], others: DataFrame | None = None, totals: dict[int, int] | None = None, near: dict[int, float] | None = None):
        self.near = near or {}
        self.ids = {w: i for i, w in enumerate(ranked[:VOCABULARY])}
        self.others = others
        #: log(1 / (total + 1)) of the buckets, 0 for words with outputs of their own.
        self.shares = np.zeros(VOCABULARY + BUCKETS)
        for bucket, total in (totals or {}).items():
            self.shares[VOCABULARY + bucket] = -np.log(total + 1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "others": None}  # tasks have no tables

    def coded(self, split: list[bytes]) -> list[int]:
        get = self.ids.get
        return [i if (i := get(w)) is not None else VOCABULARY + zlib.crc32(w[-3:]) % BUCKETS for w in split]

    def encode(self, text: bytes | None) -> list[int]:
        return self.coded(words(text))


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, list[int]]:
    """The vocabulary of the word counts, and the counts of the words with ids."""
    top = counts.orderBy(F.desc("count"), "word").limit(VOCABULARY).collect()
    ranked, own = [bytes(r["word"]) for r in top], [r["count"] for r in top]
    if len(ranked) < VOCABULARY:
        return Vocabulary(ranked), own
    known = counts.sparkSession.createDataFrame([(w,) for w in ranked], "word binary")  # VOCABULARY rows
    others = counts.join(F.broadcast(known), "word", "left_anti")
    bucket = F.pmod(F.crc32(F.unhex(F.expr("right(hex(word), 6)"))), F.lit(BUCKETS))
    totals = {r["bucket"]: r["total"] for r in others.groupBy(bucket.alias("bucket")).agg(F.sum("count").alias("total")).collect()}  # BUCKETS rows
    others = others.where("count > 1").select(F.xxhash64("word").alias("hash"), F.ln("count").alias("log_count"))
    near = {r["hash"]: r["log_count"] for r in others.orderBy(F.desc("log_count"), "hash").limit(NEAR).collect()}
    return Vocabulary(ranked, others, totals, near), own


class WindowNetwork:
    """float32 weights in one flat vector: embeddings by place, class and word outputs with biases."""

    SHAPES = ((2 * SIDE, PAD + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, PER_CLASS), (CLASSES, PER_CLASS))
    SIZE = sum(int(np.prod(x)) for x in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.parts, at = [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n
        self.embed, self.bias, self.to_class, self.class_bias, self.to_word, self.word_bias = self.parts

    @classmethod
    def start(cls, counts: list[int]) -> WindowNetwork:
        """Small random weights; biases that give the word frequencies."""
        out = cls(np.random.default_rng(7).normal(0, 0.1, cls.SIZE).astype(np.float32))
        n = np.ones(CLASSES * PER_CLASS)
        n[: len(counts)] += counts
        grid = n.reshape(CLASSES, PER_CLASS)
        out.bias[:] = 0
        out.class_bias[:] = np.log(grid.sum(1) / grid.sum())
        out.word_bias[:] = np.log(grid / grid.sum(1, keepdims=True))
        return out

    def _hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.bias + self.embed[0][near[0]]
        for j in range(1, 2 * SIDE):
            total += self.embed[j][near[j]]
        return np.tanh(total)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def log_probabilities(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """near: ids at the 2 * SIDE places around each target."""
        group, word = target // PER_CLASS, target % PER_CLASS
        order = np.argsort(group.astype(np.uint8), kind="stable")  # tokens of one class lie together
        hidden, group, word = self._hidden(near[:, order]), group[order], word[order]
        own = self._log_picked(hidden @ self.to_class + self.class_bias, group)
        ends = np.searchsorted(group, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            at = slice(ends[c], ends[c + 1])
            own[at] += self._log_picked(hidden[at] @ self.to_word[c] + self.word_bias[c], word[at])
        out = np.empty_like(own)
        out[order] = own
        return out

    @staticmethod
    def _log_picked(z: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of each row the logarithm of the softmax at one place, without the others'."""
        z -= z.max(1, keepdims=True)
        picked = z[np.arange(len(z)), which]
        return np.maximum(picked - np.log(np.exp(z, out=z).sum(1)), np.float32(np.log(1e-30)))

    def gradient(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        n = len(target)
        grad = WindowNetwork(np.zeros(self.SIZE, np.float32))
        hidden, group, word = self._hidden(near), target // PER_CLASS, target % PER_CLASS
        p = self._softmax(hidden @ self.to_class + self.class_bias)
        p[np.arange(n), group] -= 1
        grad.to_class[:], grad.class_bias[:] = hidden.T @ p, p.sum(0)
        back = p @ self.to_class.T
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            at = order[ends[c] : ends[c + 1]]
            h = hidden[at]
            q = self._softmax(h @ self.to_word[c] + self.word_bias[c])
            q[np.arange(len(at)), word[at]] -= 1
            grad.to_word[c], grad.word_bias[c] = h.T @ q, q.sum(0)
            back[at] += q @ self.to_word[c].T
        back *= 1 - hidden * hidden
        grad.bias[:] = back.sum(0)
        wide = np.arange(WIDTH)
        for j in range(2 * SIDE):
            at = (near[j][:, None] * WIDTH + wide).ravel()
            grad.embed[j] = np.bincount(at, back.ravel(), (PAD + 1) * WIDTH).reshape(-1, WIDTH)
        grad.flat /= n
        return grad.flat


def word_hash(word: bytes) -> int:
    """The same 64 bits as Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (h >> 63 << 64)


def windows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with padding between texts, places of the tokens, text of each token)."""
    sizes = np.array([len(x) for x in texts], np.int64)
    ids = np.full(int(sizes.sum()) + SIDE * (len(texts) + 1), PAD, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    places = np.arange(int(sizes.sum())) + SIDE * (owner + 1)
    if len(places):
        ids[places] = np.concatenate([np.asarray(x, np.int64) for x in texts])
    return ids, places, owner


def _near(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([ids[places + d] for d in range(-SIDE, SIDE + 1) if d])


def fit(docs: DataFrame) -> tuple[Vocabulary, WindowNetwork]:
    """The model of all docs (column text); rows equal in all columns fall into one run."""
    counted = written(count_words(docs), "words")
    vocabulary, counts = vocabulary_of(counted)
    total = counted.agg(F.sum("count")).head()[0] or 0
    encoded = _encoded(docs, vocabulary, -(-total // RUN_TOKENS))
    # Weights, and behind them their summed squared gradients, which set the size of steps.
    state = np.concatenate([WindowNetwork.start(counts).flat, np.full(WindowNetwork.SIZE, 1e-4, np.float32)])
    for i in range(ROUNDS):
        state = _round(encoded.where(F.col("run") % ROUNDS == i), state)
    discard(encoded)
    return vocabulary, WindowNetwork(state[: WindowNetwork.SIZE].copy())


def _encoded(docs: DataFrame, vocabulary: Vocabulary, runs: int) -> DataFrame:
    """(run, place, ids): each text's ids as 16-bit numbers, its run and its place there; written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        words_of = shared.value
        return lambda texts: [pa.array([np.array(words_of.encode(x), np.int16).tobytes() for x in utf8(texts)], pa.binary())]

    place = F.xxhash64(*map(quoted, docs.columns))
    rows = docs.select("text", F.pmod(place, F.lit(max(ROUNDS, runs))).cast("int").alias("run"), F.xxhash64(place).alias("place"))
    return written(mapped(rows, [F.col("text")], StructType.fromDDL("ids binary"), make, ["run", "place"]), "encoded")


def _round(encoded: DataFrame, state: np.ndarray) -> np.ndarray:
    """The mean of the copies that go from state over a run each."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(state)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, own, seen = None, shared.value, 0
        held: list[np.ndarray] = []
        size = 0

        def step() -> None:
            nonlocal held, size
            ids, places, _ = windows(held)
            for i in range(0, len(places), STEP):
                at = places[i : i + STEP]
                g = net.gradient(_near(ids, at), ids[at])
                squares[:] += g * g
                net.flat -= RATE * len(at) / STEP * g / np.sqrt(squares)
            held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if size:
                step()
            if seen:
                parts = np.array_split(own, PARTS)
                yield pa.RecordBatch.from_arrays([pa.array([run] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["run", "part", "tokens", "weights"])

        for batch in batches:
            for now, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != run:
                    if run is not None:
                        yield from out()
                    run, own, seen = now, shared.value.copy(), 0
                    held, size = [], 0
                    net, squares = WindowNetwork(own[: WindowNetwork.SIZE]), own[WindowNetwork.SIZE :]
                held.append(np.frombuffer(data, np.int16))
                size += len(held[-1])
                seen += len(held[-1])
                if size >= STEP:
                    step()
        if run is not None:
            yield from out()

    def average(key, table):
        table = table.sort_by("run")
        tokens = np.array(table.column("tokens").to_pylist(), np.float64)
        total = sum(w * np.frombuffer(x, np.float32) for w, x in zip(tokens, table.column("weights").to_pylist(), strict=True)) / tokens.sum()
        return pa.table({"run": pa.array([key[1].as_py()], pa.int64()), "part": pa.array([key[0].as_py()], pa.int32()), "tokens": pa.array([int(tokens.sum())], pa.int64()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    small_batches(spark)
    plan = "run long, part int, tokens long, weights binary"
    rows = encoded.repartition("run").sortWithinPartitions("run", "place").select("run", "ids")
    models = written(rows.mapInArrow(train, plan), "models")
    while (left := models.where("part = 0").count()) > 1:
        groups = max(1, left // FAN_IN)
        grouped = models.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        mean = written(grouped.groupBy("part", "group").applyInArrow(average, plan), "models")
        discard(models)
        models = mean
    rows = sorted(models.collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(r["weights"], np.float32) for r in rows]) if rows else state


def score(docs: DataFrame, vocabulary: Vocabulary, network: WindowNetwork, text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """Every row of docs with n_tokens, log_likelihood and mean_log_likelihood before its own columns, or those in kept.

    A text without words, null too, has no tokens, a sum of 0 and a null mean. Repeated rows stay. A
    column named like a new one gets `_input` behind its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network.flat))
    with_others = vocabulary.others is not None
    pair = pa.struct([("hash", pa.int64()), ("n", pa.int32())])

    def make():
        words_of, flat = shared.value
        net, shares, known, near = WindowNetwork(flat), words_of.shares, words_of.ids, words_of.near

        def rest(split: list[bytes]) -> tuple[float, list[dict]]:
            """Of the words that have no outputs of their own, the summed log-counts of those in near, and the others."""
            if not with_others:
                return 0.0, []
            counts, out = 0.0, []
            for word, n in Counter(x for x in split if x not in known).items():
                h = word_hash(word)
                if (own := near.get(h)) is None:
                    out.append({"hash": h, "n": n})
                else:
                    counts += n * own
            return counts, out

        def rate(texts: pa.Array) -> list[pa.Array]:
            split = [words(x) for x in utf8(texts)]
            ids, places, owner = windows([words_of.coded(x) for x in split])
            each = np.concatenate([np.empty(0), *(net.log_probabilities(_near(ids, at), ids[at]) + shares[ids[at]] for i in range(0, len(places), STEP) if len(at := places[i : i + STEP]))])
            n, total = np.bincount(owner, minlength=len(split)), np.bincount(owner, each, len(split)).astype(float)
            others = [rest(x) for x in split]
            return [pa.array(n, pa.int64()), pa.array(total + np.array([x for x, _ in others])), pa.array([x for _, x in others], pa.list_(pair))]

        return rate

    kept = docs.columns if kept is None else kept
    own = [f"own{i}" for i in range(len(kept))]
    rows = mapped(docs, [quoted(text_col)], StructType.fromDDL("n_tokens long, total double, others array<struct<hash: long, n: int>>"), make, kept).toDF("n_tokens", "total", "others", *own)
    total = F.col("total")
    if with_others:
        rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "scored")
        each = rows.select("id", F.inline("others")).join(vocabulary.others, "hash")
        rows = rows.drop("others").join(each.groupBy("id").agg(F.sum(F.col("n") * F.col("log_count")).alias("counts")), "id", "left")
        total += F.coalesce("counts", F.lit(0.0))
    names = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    return rows.select("n_tokens", total.alias(names[1]), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias(names[2]), *own).toDF(*names, *names_beside(names, kept))
