import numpy as np
import pytest
from pyspark.sql import functions as F

from docdelta.llm import topk


def brute(rows, asked, k):
    good = [(i, np.floor(np.array(v, float) * 1024).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for n, (q, v) in enumerate(good):
        if asked(q):
            scored = sorted((-int(w @ v), i) for m, (i, w) in enumerate(good) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def clustered(n, width, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width)) * 3
    return [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.05 * r.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("sizes", [(64, 4096, 1024, 32 << 20), (3, 7, 40, 500)])
def test_results_equal_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("BLOCK", "RANGE", "SEEDS", "GROUP_BYTES"), sizes):
        monkeypatch.setattr(topk, name, n)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, []), (305, [2.0]), (306, rows[7][1])]
    rows += [(40, rows[40][1]), (40, [0.5] * 6), (7, rows[3][1])]  # repeated ids: queries and candidates of their own
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.exact_topk(vectors, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 20 == 0, 10)


def test_bounds_skip_most_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 512)
    rows = clustered(3000, 16)
    counts = []
    add = topk.Search.add
    values = np.array([v for _, v in rows])
    whole = np.floor(values * 1024).astype(np.int64)
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 100 == 0, 10)
    # The same search in the order that exact_topk makes: rows by nearest pivot.
    near = (2 * whole @ whole[:100].T - (whole[:100] ** 2).sum(1)).argmax(1)
    order = np.argsort(near, kind="stable")
    search = topk.Search(np.arange(0, 3000, 100), whole[::100], 10, np.arange(200), whole[:200])
    for i in range(0, 3000, 512):
        at = order[i : i + 512]
        add(search, at, at, whole[at])
        counts.append((search.skipped, search.blocks))
    assert search.skipped > 0.7 * search.blocks


def test_skipped_blocks_hold_no_ties():
    values = np.zeros((1000, 4), np.int64)
    values[640:, 0] = 9
    search = topk.Search(np.array([-1]), np.array([[1, 0, 0, 0]]), 3)
    search.add(np.arange(1000), np.arange(1000), values)
    assert search.best[0][0].tolist() == [640, 641, 642] and search.best[0][1].tolist() == [9, 9, 9] and search.skipped == 10


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.exact_topk(one, F.lit(True)).count() == 0 and topk.exact_topk(one.limit(0), F.lit(True)).count() == 0
