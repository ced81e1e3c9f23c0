import numpy as np
import pytest

from docdelta.llm import line_dedup
from docdelta.llm.line_dedup import PerfectHash, Shard, dedup_lines

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs):
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    at = lambda d: line_dedup.NO_ID if d is None else d
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(at(doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and at(doc) != min(held[key(x)]))]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(n))


def test_shard_knows_members_and_only_those():
    r = np.random.default_rng(1)
    low, high = r.integers(0, 1 << 63, (2, 3000), dtype=np.uint64)
    shard = Shard.of(Shard.build(low[:2000], high[:2000], np.arange(2000) + 2, np.arange(2000)).parts())
    assert (shard.first_holders(low[:2000], high[:2000]) == np.arange(2000)).all()
    assert (shard.first_holders(low[2000:], high[2000:]) == -1 << 63).all()
    assert sorted(shard.counts) == list(range(2, 2002))


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    shared = [f"Geteilte Zeile Nummer {i}" for i in range(40)] + ["kurz", "Ébène ABCDE", "  tabbed line here\t"]
    r = np.random.default_rng(3)
    docs = [(int(i), "\n".join([*(shared[k] for k in r.integers(0, len(shared), 6)), f"eigene Zeile {i}", ""])) for i in r.permutation(60)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(((x.doc_id, x.kept, x.n_lines, x.n_dropped) for x in got.collect()), key=repr) == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    got = dedup_lines(odd_docs).collect()
    assert sorted(((x.doc_id, x.kept, x.n_lines, x.n_dropped) for x in got), key=repr) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert {x.node for x in got} == {"x", "y", "z", "w", "", None}
    assert dedup_lines(no_docs).count() == 0


def test_a_block_visits_each_shard_once(spark, monkeypatch):
    """More shards than the cache holds: a block of documents loads none of them twice."""
    import pyarrow as pa

    docs = [(i, "\n".join(f"line number {(i * 7 + j) % 400}" for j in range(20))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc long, text string")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "CACHE_BYTES", 1)
    folder, shards = line_dedup.build_index(frame)
    loads = []
    load = line_dedup._load
    monkeypatch.setattr(line_dedup, "_load", lambda path: loads.append(path) or load(path))
    probe = line_dedup._probe(folder, shards)()
    kept = probe(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]))[0].to_pylist()
    assert shards > 10 and len(loads) == len(set(loads)) <= shards
    assert dict(zip((i for i, _ in docs), kept)) == {x[0]: x[1] for x in brute(docs)}
