import random
import re

import numpy as np
from pyspark.sql import functions as F

from docdelta.llm import jaccard_join


def test_the_index_moves_once(spark, monkeypatch):
    """It was written, and shuffled once for the keys of several sets and once more for their entries."""
    plans, write = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    docs = [(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(40))) for i in range(40)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85)
    assert sorted(r.component_id for r in got.collect()) == sorted(i // 2 * 2 for i in range(40))
    assert "index" not in plans
    initial = plans["shared"].split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", initial)) == 1
    assert "texts" not in plans and "Exchange" not in plans["marks"].split("== Initial Plan ==")[-1]


def test_bands_meet_every_fitting_pair_and_none_repeats_another(spark):
    """A key whose sets are of like size had two bands with the same members."""
    r = random.Random(3)
    sizes = {(key, node): r.choice((r.randint(40, 48), r.randint(20, 400))) for key in range(60) for node in range(r.randint(1, 7))}
    rows = [(key, node, n, 9) for (key, node), n in sizes.items()]
    for percent in (80, 85, 100):
        got = jaccard_join._banded(spark.createDataFrame(rows, "key long, node long, n int, keys int").withColumn("node", F.col("key") * 100 + F.col("node")).repartition("key"), percent).collect()
        groups = {}
        for x in got:
            groups.setdefault(x.key, []).append(x.node)
        assert all(x.members == len(groups[x.key]) > 1 for x in got)
        met = {(a, b) for own in groups.values() for a in own for b in own if a < b}
        for (k, a), n in sizes.items():
            for b in range(a + 1, 7):
                if (m := sizes.get((k, b))) and percent * max(n, m) <= 100 * min(n, m):
                    assert (k * 100 + a, k * 100 + b) in met
        sets = [frozenset(x) for x in groups.values()]
        assert not any(x <= y for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)


def test_parities_tell_large_sets_apart(spark):
    """Sets far above the bits of a parity all looked alike, so the texts of every pair of them moved."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3600, dtype=np.uint64)
    other = r.integers(0, 1 << 63, 3600, dtype=np.uint64)
    sets = {1: base, 2: np.concatenate([base[:3300], other[:200]]), 3: other, 4: np.concatenate([base[:3500], other[:1200]])}
    texts = spark.createDataFrame([(node, len(x), jaccard_join._parity(np.sort(x)).tolist()) for node, x in sets.items() for _ in range(2)], "node long, n int, parity array<long>")
    pairs = jaccard_join.written(spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long"), "pairs")
    assert len({len(r.parity) for r in texts.collect()}) == 2
    left = {tuple(x) for x in jaccard_join._possible(pairs, texts, 80).collect()}
    assert (1, 2) in left and (2, 4) not in left and not left & {(1, 3), (2, 3), (3, 4)}
