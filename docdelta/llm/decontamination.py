r"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every item of the benchmark as a sequence of words
(`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z). A document's words stream through it
and it tells at each word the length of the longest item passage that ends there. Where that
length reaches WINDOW words, or where a whole shorter item ends, the words of the match are hit.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docdelta.llm.common import discard, mapped, names_beside, quoted, small_batches, written

WINDOW = 10
#: Words of items in one automaton, about. A larger benchmark takes several, one after the other over all documents.
AUTOMATON_WORDS = 300_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text: str | None) -> str:
    """A-Z lower-cased, everything else as it is; places of characters stay the same."""
    if not text:
        return ""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


class ItemAutomaton:
    """A generalised suffix automaton of the items' words."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, set[int]] = {}
        texts = sorted({tuple(w) for _, w in items if w})
        self.shortest = min([window, *map(len, texts)])
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in text] for text in texts]
        for text in coded:
            self._add(text)
        self._shorts(coded)
        self.windows: dict[tuple[int, ...], list[object]] = {}
        for item, text in items:
            if item is None:
                continue
            own = [self.ids[w] for w in text]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                held = self.windows.setdefault(tuple(own[i : i + window]), [])
                if not held or held[-1] != item:  # an item's own windows come one after another
                    held.append(item)

    def _add(self, text: list[int]) -> None:
        step, link, length, last = self.step, self.link, self.length, 0
        for c in text:
            if (q := step[last].get(c)) is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = self._state(length[last] + 1)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = cur
                    p = link[p]
                if p < 0:
                    link[cur] = 0
                elif length[q := step[p][c]] == length[p] + 1:
                    link[cur] = q
                else:
                    link[cur] = self._clone(p, c, q)
                last = cur
            else:
                last = self._clone(last, c, q)

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.step[new] = dict(self.step[q])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def _shorts(self, texts: list[list[int]]) -> None:
        """ends[state]: lengths of whole short items that end every match which reaches the state."""
        own: dict[int, set[int]] = {}
        for text in texts:
            if len(text) < self.window:
                at = 0
                for c in text:
                    at = self.step[at][c]
                while self.length[self.link[at]] >= len(text):
                    at = self.link[at]
                own.setdefault(at, set()).add(len(text))
        self.ends: list[tuple[int, ...]] = [()] * len(self.step)
        if own:
            for v in sorted(range(1, len(self.step)), key=self.length.__getitem__):
                mine = own.get(v, ())
                self.ends[v] = (*mine, *self.ends[self.link[v]]) if mine else self.ends[self.link[v]]

    def matches(self, text: list[str]) -> list[tuple[int, int]]:
        """(start, length) of each window that occurs in the text: WINDOW words, or a whole short item."""
        get = self.ids.get
        coded = [get(w, -1) for w in text]
        found, step, link, length, window, ends = [], self.step, self.link, self.length, self.window, self.ends
        at = matched = 0
        for i, c in enumerate(coded):
            if c < 0:
                at = matched = 0
                continue
            while at and c not in step[at]:
                at = link[at]
                matched = length[at]
            if (to := step[at].get(c)) is None:
                continue
            at = to
            matched += 1
            if matched >= window:
                found.append((i - window + 1, window))
            for n in ends[at]:
                if n <= matched:
                    found.append((i - n + 1, n))
        return found

    def occurring(self, text: list[str], found: list[tuple[int, int]]) -> set[object]:
        """The items that have one of the found windows."""
        out: set[object] = set()
        for start, n in found:
            out.update(self.windows.get(tuple(self.ids[w] for w in text[start : start + n]), ()))
        return out


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, most_words: int = AUTOMATON_WORDS) -> tuple[DataFrame, int]:
    """(shard, automaton) of the items dealt by hash, pickled and written, and the number of shards.

    Each is built by a task of its own, so neither the driver nor a worker ever holds all of them.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(x)) for x in batch.column(0).to_pylist())], pa.int64())], ["n"])

    def build(table: pa.Table) -> pa.Table:
        held = [(item, words(text)) for item, text in zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True)]
        return pa.table({"shard": table.column("shard")[:1], "automaton": pa.array([pickle.dumps(ItemAutomaton(held, window))], pa.binary())})

    items = benchmark.select(quoted(id_col).alias("item"), quoted(text_col).alias("text"))
    total = items.select("text").mapInArrow(sizes, "n long").agg(F.sum("n")).head()[0] or 0
    n = max(1, -(-total // most_words))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return written(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata"), n


def _covered(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, length) as sorted (start, end), apart from each other."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n))
        else:
            out.append((start, start + n))
    return out


def _hits(automaton: ItemAutomaton, text: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
    """The covered (start, end) of a text's words, and the items that occur."""
    if len(text) < automaton.shortest or not (hits := automaton.matches(text)):
        return [], set()
    return _covered(hits), {str(x) for x in automaton.occurring(text, hits)}


def items_digest(items: set[object]) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items)).encode()).hexdigest()


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stood between two kept parts is one space."""
    places = [m.span() for m in WORD.finditer(lower(text))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return " ".join(y for x in out if (y := x.strip()))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256 and clean before its own columns.

    n_hit counts the words inside any occurrence of a window, n_items the items that have an
    occurring window, clean is the text without hit words (the same text where none is hit). A null
    text has no words and stays null. Items with a null or wordless text have no windows; repeated
    items count once for each id; items without an id hit words but are not counted or named. An
    empty benchmark hits nothing. A column named like a new one gets `_input` behind its name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards, n_shards = automata(benchmark, item_id, item_text, window, most_words)
    out = StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, clean string")

    def automaton(shard: int) -> bytes:
        rows = shards.where(F.col("shard") == shard).select("automaton").collect()  # one row at most
        return bytes(rows[0][0]) if rows else pickle.dumps(ItemAutomaton([], window))

    def finished(texts: list[str | None], split: list[list[str]], found: list[tuple[list[tuple[int, int]], set[str]]]) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in split], pa.int64()),
            pa.array([sum(b - a for a, b in x) for x, _ in found], pa.int64()),
            pa.array([len(x) for _, x in found], pa.int64()),
            pa.array([items_digest(x) for _, x in found], pa.string()),
            pa.array([cut(x, y) if y else x for x, (y, _) in zip(texts, found, strict=True)], pa.string()),
        ]

    if n_shards == 1:
        shared = spark.sparkContext.broadcast(automaton(0))

        def make():
            held = pickle.loads(shared.value)

            def hit(column: pa.Array) -> list[pa.Array]:
                texts = column.to_pylist()
                split = [words(x) for x in texts]
                return finished(texts, split, [_hits(held, x) for x in split])

            return hit

        return mapped(docs, [quoted(text_col)], out, make)

    own = [f"own{i}" for i in range(len(docs.columns))]
    rows = written(docs.select(F.monotonically_increasing_id().alias("id"), quoted(text_col).alias("whole"), *[quoted(x).alias(y) for x, y in zip(docs.columns, own, strict=True)]), "documents")
    passes = []
    for shard in range(n_shards):
        shared = spark.sparkContext.broadcast(automaton(shard))

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = pickle.loads(shared.value)
            for batch in batches:
                found = [(row, *_hits(held, words(x))) for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                found = [x for x in found if x[1]]
                spans = pa.array([[{"a": a, "b": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), spans, pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))], ["row", "spans", "items"])

        passes.append(written(rows.select("id", "whole").mapInArrow(one, "row long, spans array<struct<a: long, b: long>>, items array<string>"), "hits"))
        shared.destroy()
    discard(shards)
    hits = spark.read.schema(passes[0].schema).parquet(*[x.written_to for x in passes])
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(*columns: pa.Array) -> list[pa.Array]:
        spans, items, texts = (x.to_pylist() for x in columns)
        found = [(_covered([(y["a"], y["b"] - y["a"]) for y in x or ()]), set(z or ())) for x, z in zip(spans, items, strict=True)]
        return finished(texts, [words(x) for x in texts], found)

    joined = rows.join(hits, F.col("id") == F.col("row"), "left")
    return mapped(joined, [F.col("spans"), F.col("items"), F.col("whole")], out, lambda: merge, own).toDF(*out.names, *names_beside(out.names, docs.columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit: int = 0, max_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without benchmark passages, with the columns of docs.

    Documents with at most max_hit hit words stay as they are. Of the others the hit spans go, and
    the whole document goes where they cover more than max_coverage of its words.
    """
    found = scan(docs, benchmark, text_col)
    found = found.where((F.col("n_hit") <= max_hit) | (F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")))
    own = zip(docs.columns, found.columns[-len(docs.columns) :], strict=True)
    return found.select(*[(F.when(F.col("n_hit") > max_hit, F.col("clean")).otherwise(quoted(y)) if x == text_col else quoted(y)).alias(x) for x, y in own])
