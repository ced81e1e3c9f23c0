r"""Exact n-gram Jaccard self-join with token-combination prefixes.

A document's set holds its distinct k-word shingles. Two documents link when
100 * |intersection| >= percent * |union|. Steps:

1. Texts with equal sets fall together into one node (the set's digest), so copies cost one entry.
2. Shingles that many sets hold form the frequent class: each run of documents counts its own,
   the counts are summed, and the FREQUENT most common make the class, a fixed-size broadcast.
   Which shingles are in it changes speed alone, never the result.
3. Each set is put in the order rare shingles first, frequent ones last, and its prefix is extended
   until n_rare + max(0, n_frequent - 1) = max_missing + 1, where max_missing is how many shingles
   a partner may lack. Two linked sets then share a rare prefix shingle or two frequent ones. The
   index has a key for each rare prefix shingle and for each pair of frequent ones. Pairs of pairs
   grow with the prefix, so sets above SMALL shingles index the frequent ones singly as well;
   sizes between take both forms, and so every possible pair of sizes has one in common.
4. A key that several sets have is split into bands of similar sizes. Keys with at most DIRECT members
   have all their pairs verified.
5. A larger one has a leader, the member with the largest share of keys in such groups: the least changed
   text of a group of copies. Each node is verified against the leader with which it shares most keys;
   large groups of near copies become stars, linear in their size. Where the key still joins different
   components, each member x is compared with the leader L, once for each (x, L),
   and gives its delta d(x), the symmetric difference of the two sets. Since a and b differ in exactly
   d(a) against d(b), a link of a and b is an overlap of their deltas:
   2 * |d(a) & d(b)| >= |d(a)| + |d(b)| - H, with H = (|a| + |b|) * (100 - percent) / (100 + percent).
   Of two members without a common component one at least isn't linked with L, so its delta is longer
   than H, and the other shares more than half of its own delta with it. The deltas' prefixes, tokens
   that few members of the group lack or add first, are the keys of the next turn, which goes through
   steps 4 and 5 again. What texts of a group have in common is in no delta and makes no key.
6. A pair is verified by the intersection of the whole sets, computed again from whole texts. Texts move
   only for pairs that their parities let pass: the bits that an odd number of a set's shingles fall on.
   Where the parities of two sets differ, the sets do, so more such bits than H rule a link out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.llm.common import connected, discard, quoted, small_batches, utf8, written
from docdelta.llm.shingles import overlap, set_digest, shingle_set

#: At most so many shingles are in the frequent class (8 bytes each in the broadcast).
FREQUENT = 200_000
#: Shingles that are counted together before the rare ones of the run are left out.
RUN = 4_000_000
#: A shingle of a run is reported from so many sets on.
RUN_MIN = 4
#: Sets up to this size index pairs of frequent shingles.
SMALL = 200
#: Bits of a set's parity, by 64, at least; a larger set has twice as many as shingles, rounded up to a power of two.
PARITY = 16
#: Bits of a key. Two keys that fall together make pairs to look at, never a link.
KEY_BITS = 48
#: Bits of the filter that picks the texts worth moving; it lets too many pass, never too few.
FILTER_BITS = 1 << 24
#: Open keys with at most so many members have their pairs verified without deltas.
DIRECT = 16
#: Turns with deltas. They end earlier where the keys left make no more pairs than keys of DIRECT members
#: would make of the entries at first; the pairs of what is left then are verified without deltas.
TURNS = 6
#: What an entry may meet: entries linked with the leader (MEETS_IN), others (MEETS_OUT).
IS_IN, MEETS_IN, MEETS_OUT = 1, 2, 4
#: Distinct nodes that a task remembers to leave out copies.
SEEN = 1_000_000


def _least(n: int, percent: int) -> int:
    """The fewest shingles that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def _parity(shingles: np.ndarray) -> np.ndarray:
    bits = max(64 * PARITY, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(k: int):
    """Rows (kind 0: doc_id, node, n) for each document, (kind 1: count, shingle) for common shingles, and
    (kind 2: node, n, packed text, parity) for each node with shingles, without the copies that a task sees."""

    def common(held: list[np.ndarray]) -> pa.RecordBatch | None:
        if not held:
            return None
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= RUN_MIN
        if not keep.any():
            return None
        return rows(1, pa.array(counts[keep].astype(np.int64)), tokens[keep].view(np.int64), np.zeros(int(keep.sum()), np.int32))

    def rows(kind, a, b, n, texts=None, parities=None):
        size = len(b)
        texts = pa.nulls(size, pa.binary()) if texts is None else pa.array(texts, pa.binary())
        parities = pa.nulls(size, pa.list_(pa.int64())) if parities is None else pa.array(parities, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), a, pa.array(b), pa.array(n), texts, parities], ["kind", "a", "b", "n", "text", "parity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, pack = [], 0, set(), zstandard.ZstdCompressor(3)  # texts move with each pair: packed well, they move cheaply
        for batch in batches:
            nodes, sizes, new = [], [], []
            for text in utf8(batch.column(1)):
                shingles = shingle_set(text, k)
                nodes.append(node := set_digest(shingles))
                sizes.append(len(shingles))
                if node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    held.append(shingles)
                    size += len(shingles)
                    if len(shingles):
                        new.append((node, len(shingles), pack.compress(text), _parity(shingles)))
                if size >= RUN:
                    if (out := common(held)) is not None:
                        yield out
                    held, size = [], 0
            yield rows(0, batch.column(0).cast(pa.int64()), np.array(nodes, np.int64), np.array(sizes, np.int32))
            if new:
                own, lengths, texts, parities = zip(*new, strict=True)
                yield rows(2, pa.nulls(len(new), pa.int64()), np.array(own, np.int64), np.array(lengths, np.int32), texts, parities)
        if (out := common(held)) is not None:
            yield out

    return run


def _keys(shingles: np.ndarray, is_frequent: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of one set."""
    n = len(shingles)
    need = n - _least(n, percent) + 1
    mix = np.uint64(0x9E3779B97F4A7C15)
    rare, often = shingles[~is_frequent], shingles[is_frequent]
    out = []
    if n > SMALL:
        out.append(np.concatenate((rare[:need], often[: max(0, need - len(rare))])) ^ mix)
    if _least(n, percent) <= SMALL:
        out.append(rare[:need])
        if len(rare) < need:
            # One more than is missing: of need - len(rare) + 1 frequent ones two at least are shared.
            picked = often[: need - len(rare) + 1]
            if len(picked) > 1:
                i, j = np.array(list(combinations(range(len(picked)), 2))).T
                out.append((picked[i] * mix) ^ picked[j])
    return np.concatenate(out) & np.uint64((1 << KEY_BITS) - 1)


def _index(k: int, percent: int, frequent: np.ndarray):
    """Entries of nodes (node, packed text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, nodes, sizes, counts = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = shingle_set(unpack.decompress(text), k)
                at = np.searchsorted(frequent, shingles)
                at[at == len(frequent)] = 0
                is_frequent = frequent[at] == shingles if len(frequent) else np.zeros(len(shingles), bool)
                own = _keys(shingles, is_frequent, percent)
                keys.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                sizes.append(np.full(len(own), len(shingles), np.int32))
                counts.append(np.full(len(own), len(own), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in keys], nodes, sizes, counts)], ["key", "node", "n", "keys"])

    return run


def _filter(nodes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits with those of the nodes set: a few kilobytes a row, a fixed number of rows."""
    place = F.pmod(F.shiftright("node", 8), F.lit(FILTER_BITS))
    rows = nodes.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).cast("int").alias("bucket")).agg(F.expr("bitmap_construct_agg(int(p % 32768))").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in rows.collect():
        out[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _picked(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """Those rows of texts (node first) whose nodes the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (batch.column(0).to_numpy(zero_copy_only=False) >> 8) % FILTER_BITS
            yield batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))

    return texts.mapInArrow(run, texts.schema)


def _folded(parity: str, other: str) -> Column:
    """A parity with as few bits as that of a set that is less than twice as small."""
    n = F.size(other)
    return F.when(F.size(parity) > n, F.zip_with(F.slice(parity, F.lit(1), n), F.slice(parity, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(parity))


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that may link by sizes and parities; written."""
    own = marks.groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with(_folded("parity_a", "parity_b"), _folded("parity_b", "parity_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    out = written(met.where(_sizes_fit("n_a", "n_b", percent) & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b"), "possible")
    discard(pairs)
    return out


def _compared(pairs: DataFrame, marks: DataFrame, texts: DataFrame, k: int, percent: int, with_delta: bool = False) -> DataFrame:
    """Rows (a, b, n_a, n_b, linked, delta) for the pairs (a, b), tested on the whole texts and written.

    delta holds the hashes that one of the sets has alone. Without it, the links alone are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, unpack = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            ids_a, ids_b = (batch.column(i).to_pylist() for i in (0, 1))
            rows = []
            for a, b, text_a, text_b in zip(ids_a, ids_b, utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if b != last:
                    last, held = b, shingle_set(unpack.decompress(text_b), k)
                own = shingle_set(unpack.decompress(text_a), k)
                both = overlap(own, held)
                linked = 100 * both >= percent * (len(own) + len(held) - both)
                if with_delta:
                    rows.append((a, b, len(own), len(held), linked, np.setxor1d(own, held, assume_unique=True).view(np.int64)))
                elif linked:
                    rows.append((a, b, len(own), len(held), True, None))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    names = ["a", "b", "n_a", "n_b", "linked", "delta"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
    small_batches(pairs.sparkSession)
    if not with_delta:
        pairs = _possible(pairs, marks, percent)
    bits = _filter(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    picked = written(_picked(texts, bits), "picked")
    own = picked.groupBy("node").agg(F.first("text").alias("text"))  # by the join's own shuffle
    sided = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    sided = sided.join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    out = written(sided.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a int, n_b int, linked boolean, delta array<long>"), "compared")
    discard(picked, pairs)
    return out


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _banded(entries: DataFrame, percent: int) -> DataFrame:
    """The entries with their keys split by size, and the members of each: a set is in two neighbouring bands, and
    two sets whose sizes fit meet in one of them. Bands with one member are left out, and those whose members all are in a neighbouring one.

    Entries that are dealt by key stay where they are: the window lies within a key.
    """
    band = F.floor(F.ln("n") / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else 2 * F.col("n")
    by = Window.partitionBy("key").orderBy("band")
    below, same, above = (F.count("*").over(by.rangeBetween(k, k)) for k in (-1, 0, 1))
    rows = entries.withColumn("band", band).withColumns({"below": below, "same": same, "above": above})
    first = F.when(F.col("below") > 0, F.struct("band", (F.col("below") + F.col("same")).alias("members")))
    second = F.when((F.col("above") > 0) | (F.col("below") == 0), F.struct((F.col("band") + 1).alias("band"), (F.col("same") + F.col("above")).alias("members")))
    rows = rows.withColumn("x", F.explode(F.array_compact(F.array(first, second)))).where("x.members > 1")
    return rows.select(F.xxhash64("key", "x.band").alias("key"), "node", "n", "keys", "x.members")


def _open(entries: DataFrame, label: DataFrame) -> DataFrame:
    """The entries of keys that join different components, with each node's component; written."""
    named = written(entries.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    out = written(named.join(keys, "key"), "open")
    discard(named)
    return out


def _leads(entries: DataFrame) -> DataFrame:
    """(key, lead, n_lead, of_lead): each key's leader with its set's size and component; written."""
    shared = entries.groupBy("node").agg(F.count("*").alias("shared"))
    each = entries.join(shared, "node").withColumn("share", F.col("shared") / F.col("keys"))
    found = each.groupBy("key").agg(F.max(F.struct("share", "node", "n", "component")).alias("x"))
    return written(found.select("key", F.col("x.node").alias("lead"), F.col("x.n").alias("n_lead"), F.col("x.component").alias("of_lead")), "leads")


def _stars(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each node with one leader of another component, the one with which it shares most keys."""
    met = entries.where((F.col("component") != F.col("of_lead")) & _sizes_fit("n", "n_lead", percent))
    met = met.groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("keys"))
    return written(met.groupBy("a").agg(F.max_by("b", F.struct("keys", "b")).alias("b")), "pairs")


def _direct(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that share a key and may link."""
    x, y = entries.alias("x"), entries.alias("y")
    roles = (
        (F.col("x.role").bitwiseAND(IS_IN) > 0) & (F.col("y.role").bitwiseAND(MEETS_IN) > 0)
        | (F.col("y.role").bitwiseAND(IS_IN) > 0) & (F.col("x.role").bitwiseAND(MEETS_IN) > 0)
        | (F.col("x.role").bitwiseAND(F.col("y.role")).bitwiseAND(MEETS_OUT) > 0)
    )
    # From its first common token on, a pair can share no more tokens than either delta still has.
    most = 2 * (100 + percent) * F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    reach = most >= (100 + percent) * (F.col("x.d") + F.col("y.d")) - (100 - percent) * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _sizes_fit("x.n", "y.n", percent) & roles & reach)
    return written(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")


def _delta_entries(deltas: DataFrame, percent: int) -> DataFrame:
    """Entries from the prefixes of the deltas (a, b, n_a, n_b, linked, delta) to leaders b."""
    less, more = 100 - percent, 100 + percent
    each = deltas.select("a", "b", "n_a", "n_b", "linked", F.size("delta").alias("d"), F.explode("delta").alias("token"))
    # Members linked with the leader have one component, so a token that they alone have joins nothing.
    held = each.groupBy("b", "token").agg(F.count("*").alias("held"), F.count_if(~F.col("linked")).alias("out")).where("held > 1 and out > 0").drop("out")
    own = Window.partitionBy("b", "a")
    at = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "token")) - 1  # tokens that join nothing come first
    some = each.join(held, ["b", "token"]).withColumn("at", at)
    d = F.col("d")
    # With a partner that isn't linked with the leader, more than so many tokens are shared.
    with_out = F.greatest(F.lit(0), F.floor((d * more + (F.col("n_b") - F.col("n_a")) * less) / (2 * more)))
    # With any partner at least so many, as no delta is shorter than this one by more than H.
    with_any = F.greatest(F.lit(1), d - F.floor(F.col("n_a") * less / percent))
    meets_out, meets_in = F.col("at") < d - with_out, F.col("at") < d - with_any + 1
    role = F.when(F.col("linked"), F.when(meets_out, IS_IN).otherwise(0)).otherwise(F.when(meets_in, MEETS_IN).otherwise(0) + F.when(meets_out, MEETS_OUT).otherwise(0))
    some = some.withColumn("role", role.cast("int")).where("role > 0")
    return some.select(F.xxhash64("b", "token").alias("key"), F.col("a").alias("node"), F.col("n_a").alias("n"), F.col("d").alias("keys"), "role", "d", F.col("at").cast("int").alias("at"))


def _links(entries: DataFrame, marks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that connect what the nodes of the entries' keys connect; written."""
    links: list[DataFrame] = []

    def add(found: DataFrame) -> None:
        links.append(found.where("linked").select("a", "b"))

    def label() -> DataFrame:
        out = links[0]
        for x in links[1:]:
            out = out.unionByName(x)
        return connected(out)

    start = {"role": F.lit(MEETS_OUT), "d": F.lit(0), "at": F.lit(0), "component": F.col("node")}
    entries = entries.withColumns(start)
    linear = entries.count()
    for turn in range(TURNS + 1):
        most = DIRECT if turn < TURNS else None
        if turn and most:
            pairs = entries.agg(F.sum((F.col("members") - 1) / 2)).head()[0] or 0
            most = DIRECT if pairs > DIRECT / 2 * linear else None
        add(_compared(_direct(entries if most is None else entries.where(F.col("members") <= most), percent), marks, texts, k, percent))
        large = written(entries.where("false" if most is None else F.col("members") > most).drop("members"), "large")
        if turn:
            discard(entries)
        if not large.head(1):
            discard(large)
            break
        leads = _leads(large)
        led = written(large.join(leads, "key"), "led")
        add(_compared(_stars(led, percent), marks, texts, k, percent))
        left = _open(led.drop("component", "of_lead"), label())
        discard(large, leads, led)
        far = written(left.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "far")
        discard(left)
        if not far.head(1):
            break
        deltas = _compared(far, marks, texts, k, percent, with_delta=True)
        add(deltas)
        left = _open(_delta_entries(deltas, percent), label())
        entries = written(left.join(left.groupBy("key").agg(F.count("*").alias("members")), "key"), "entries")
        discard(left)
        if not entries.head(1):
            break
    return label()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs.

    component_id is the smallest id that links reach. A null or wordless text has no shingles and
    is its own component. Rows with a null id take part; they get the smallest id of their
    component, null if it has none. Repeated ids stay separate rows. Other columns are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("the prefixes are exact for a percentage above 50 and up to 100")
    small_batches(docs.sparkSession)
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    seen = written(docs.mapInArrow(_describe(k), "kind int, a long, b long, n int, text binary, parity array<long>"), "sets")
    rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "n")
    often = seen.where("kind = 1").groupBy("b").agg(F.sum("a").alias("held")).orderBy(F.desc("held"), "b").limit(FREQUENT)
    frequent = np.sort(np.array([x.b for x in often.collect()], np.int64).view(np.uint64))
    whole = seen.where("kind = 2").select(F.col("b").alias("node"), "n", "text", "parity")

    sizes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    sizes = written(sizes, "nodes")

    # The index moves once: what finds the keys of several sets, leaves out copies and counts members needs a key's entries in one task each time.
    entries = whole.select("node", "text").mapInArrow(_index(k, percent, frequent), "key long, node long, n int, keys int").repartition("key")
    own = Window.partitionBy("key")
    several = entries.withColumns({"low": F.min("node").over(own), "high": F.max("node").over(own)}).where("low != high").drop("low", "high")
    shared = written(_banded(several.distinct(), percent), "shared")
    # Copies that different tasks have seen stay until a join deals them by node. Texts are read where they are.
    marks = written(_picked(whole.select("node", "n", "parity"), _filter(shared)), "marks")
    label = _links(shared, marks, whole.select("node", "text"), k, percent)
    discard(shared, marks)

    nodes = sizes.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(nodes.join(least, "component").select("node", "component_id"), "components")
    out = rows.join(named, "node")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
