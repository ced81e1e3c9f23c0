r"""Line deduplication across documents with a sharded minimal perfect hash.

A line's key is the line without `[\x20\x09-\x0D]` at its ends, A-Z lower-cased. Keys of MIN_CHARS
code points or more that two documents or more hold are kept in the document with the smallest id
and dropped from all others. The distinct hashes of those keys are dealt to shards; each shard
becomes a minimal perfect hash (levels of bits: a key's place at the first level where it is
alone, its rank is its slot) over compact arrays of fingerprints, document counts and first
holders. Documents probe the arrays; their lines are never joined. A task hashes the lines of a block of
documents first and then goes through the shards once for the block, however many there are.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docdelta.llm.common import mapped, quoted, shared_dir, small_batches, utf8, written

MIN_CHARS = 10
#: Keys that a shard should hold: about 20 bytes each.
SHARD_KEYS = 200_000
#: Bytes of shards that a worker keeps between batches.
CACHE_BYTES = 96 << 20
#: Bytes of documents in a block.
BLOCK_BYTES = 32 << 20
#: A null id counts as one document, behind all others.
NO_ID = (1 << 63) - 1
_SEED = 0x51ED270B


def line_key(line: bytes) -> bytes | None:
    """The key, or None where it is too short."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def key_hash(key: bytes) -> tuple[int, int]:
    """A 128-bit hash in two halves: the low one finds the slot, the high one is the fingerprint."""
    h = xxhash.xxh3_128_intdigest(key)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (keys ^ np.uint64((_SEED * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: n keys to the slots 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(1, dtype=np.int64)
            self.ranks.append(base + np.concatenate(([0], np.cumsum(ones)))[:-1])
            base += int(ones.sum())
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while len(left):
            size = (2 * len(left) + 63) // 64 * 64
            at = _place(left, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 where no level has it; a key from outside may get any slot."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = _place(keys[open_], level, len(bits) * 8).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            own = at[hit]
            words = bits.view(np.uint64)[own >> 6] & ((np.uint64(1) << (own & 63).astype(np.uint64)) - np.uint64(1))
            out[open_[hit]] = ranks[own >> 6] + np.bitwise_count(words).astype(np.int64)
            open_ = open_[~hit]
        return out


class Shard:
    """Fingerprints, counts and first holders in the order of a perfect hash."""

    def __init__(self, table: PerfectHash, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.table, self.prints, self.counts, self.firsts = table, prints, counts, firsts
        self.nbytes = prints.nbytes + counts.nbytes + firsts.nbytes + sum(x.nbytes for x in (*table.levels, *table.ranks))

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> Shard:
        table = PerfectHash.build(low)
        order = np.empty(len(low), np.int64)
        order[table.slots(low)] = np.arange(len(low))
        return cls(table, high[order], np.minimum(counts[order], (1 << 32) - 1).astype(np.uint32), firsts[order])

    def parts(self) -> list[bytes]:
        sizes = np.array([len(x) for x in self.table.levels], np.int64)
        return [x.tobytes() for x in (sizes, np.concatenate(self.table.levels), self.prints, self.counts, self.firsts)]

    @classmethod
    def of(cls, parts: list[bytes]) -> Shard:
        sizes, levels, prints, counts, firsts = (np.frombuffer(x, t) for x, t in zip(parts, (np.int64, np.uint8, np.uint64, np.uint32, np.int64), strict=True))
        return cls(PerfectHash(np.split(levels, np.cumsum(sizes)[:-1])), prints, counts, firsts)

    def first_holders(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first holder of each key, -1 for keys that the shard lacks."""
        slot = self.table.slots(low)
        safe = np.maximum(slot, 0)
        return np.where((slot >= 0) & (self.prints[safe] == high), self.firsts[safe], np.int64(-1 << 63))


_ABSENT = np.int64(-1 << 63)
_cache: OrderedDict[str, Shard | None] = OrderedDict()


def _load(path: str) -> Shard | None:
    """The shard of that path, None if it has no keys. The cache is the worker's own."""
    if path in _cache:
        _cache.move_to_end(path)
        return _cache[path]
    fs, name = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        shard = None
    else:
        with fs.open_input_file(name) as f:
            sizes = np.frombuffer(f.read(40), np.int64)
            shard = Shard.of([f.read(int(n)) for n in sizes])
    _cache[path] = shard
    while len(_cache) > 1 and sum(x.nbytes for x in _cache.values() if x) > CACHE_BYTES:
        _cache.popitem(last=False)
    return shard


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each document."""
    for batch in batches:
        low, high, docs = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            own = {key_hash(key) for line in (text or b"").split(b"\n") if (key := line_key(line))}
            for a, b in own:
                low.append(a)
                high.append(b)
            docs += [doc] * len(own)
        arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(docs, pa.int64())], ["low", "high", "doc"])


def build_index(docs: DataFrame) -> tuple[str, int]:
    """Writes the shards over the keys that several of docs (doc, text) hold; the folder and the number of shards."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = docs.mapInArrow(_lines, "low long, high long, doc long").groupBy("low", "high").agg(F.count("*").alias("count"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    keys = written(keys.where("first != last").drop("last"), "keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    folder = shared_dir(spark, "lines")

    def build(key, table):
        columns = [table.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("low", "high", "count", "first")]
        parts = Shard.build(columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2], columns[3]).parts()
        fs, name = pafs.FileSystem.from_uri(folder)
        fs.create_dir(name, recursive=True)
        path = f"{name}/{key[0].as_py()}"
        own = f"{path}.{xxhash.xxh3_64_hexdigest(str(id(parts)) + str(np.random.random()))}"
        with fs.open_output_stream(own, compression=None) as f:
            f.write(np.array([len(x) for x in parts], np.int64).tobytes())
            for x in parts:
                f.write(x)
        fs.move(own, path)  # a repeated task writes the same bytes
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([table.num_rows], pa.int64())})

    shard = F.pmod(F.shiftright("low", 7), F.lit(shards))
    keys.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, keys long").agg(F.sum("keys")).collect()
    return folder, shards


def _probe(folder: str, shards: int):
    def make():
        def probe(docs: pa.Array, column: pa.Array) -> list[pa.Array]:
            texts = utf8(column)
            low, high, owner, place = [], [], [], []
            split = [(text or b"").split(b"\n") for text in texts]
            ids = docs.to_pylist()
            for i, lines in enumerate(split):
                for j, line in enumerate(lines):
                    if key := line_key(line):
                        a, b = key_hash(key)
                        low.append(a)
                        high.append(b)
                        owner.append(i)
                        place.append(j)
            low, high = np.array(low, np.uint64), np.array(high, np.uint64)
            shard = (low.view(np.int64) >> 7) % shards
            first = np.full(len(low), _ABSENT, np.int64)
            for s in np.unique(shard):
                if table := _load(f"{folder}/{s}"):
                    at = shard == s
                    first[at] = table.first_holders(low[at], high[at])
            owner = np.array(owner, np.int64)
            drop = (first != _ABSENT) & (first != np.array(ids, np.int64)[owner]) if len(low) else np.zeros(0, bool)
            gone: dict[int, set[int]] = {}
            for i in np.flatnonzero(drop):
                gone.setdefault(int(owner[i]), set()).add(place[i])
            kept = [b"\n".join(x for j, x in enumerate(lines) if j not in gone[i]) if i in gone else texts[i] or b"" for i, lines in enumerate(split)]
            return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(x) for x in split], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(split))], pa.int64())]

        return probe

    return make


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with kept (its text without dropped lines), n_lines and n_dropped before its own columns.

    A null text counts as empty: one empty line, kept as ''. Rows with a null id count as one
    document behind all others; repeated ids count as one document. A column named like a new one
    gets `_input` behind its name.
    """
    doc, text = F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID)), quoted(text_col)
    folder, shards = build_index(docs.select(doc.alias("doc"), text.alias("text")))
    return mapped(docs, [doc, text], StructType.fromDDL("kept string, n_lines long, n_dropped long"), _probe(folder, shards), hold=BLOCK_BYTES)
