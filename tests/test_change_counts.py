import random

import pytest

from docdelta.checkpoint import written
from docdelta.operators import align, decide, postprocess
from docdelta.plans import compare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(pairs):
    kept, out = [], []
    for x, y in pairs:
        out.append(not any((p or q) and (x in p and y in q or p in x and q in y) for p, q in kept))
        if out[-1]:
            kept.append((x, y))
    return out


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_few_kept_rows_are_gone_through_without_an_index(monkeypatch, few):
    """The index was made for every job, and took most of the time of job_results and job_payloads behind the alignment."""
    monkeypatch.setattr(postprocess, "FEW", few)
    r = random.Random(few)
    pairs = [("".join(r.choices("ab ", k=r.choice((0, 2, 5, 40)))), "".join(r.choices("ab", k=r.choice((0, 1, 6, 30))))) for _ in range(400)]
    pairs += [(x[1:-1], y) for x, y in pairs[:60]] + [(f"a{x}b", y + "a") for x, y in pairs[:60]]
    kept, got = postprocess.Kept(), []
    for x, y in pairs:
        got.append(not kept.nested(x, y))
        if got[-1]:
            kept.add(x, y)
    assert got == brute(pairs) and bool(kept.having[0]) == (few < sum(got))


def test_counts_of_rows_need_no_word_diffs(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 41}." for k in range(200))) for i in range(4)], "doc_id long, text string")
    decided = compare.compared(docs, compare.candidate_pairs(docs))
    counts, rows = (compare.change_rows(decided, only=only).groupBy("job_id").count() for only in (compare.COUNTED, None))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, rows.collect())) != []
    assert "diff_segments" in plan(compare.change_rows(decided)) and "diff_segments" not in plan(counts)


def test_documents_of_one_file_are_prepared_by_all_tasks(spark):
    """One task prepared nearly all, twice."""
    docs = written(spark.createDataFrame([(i, f"Ein Satz {i}. Noch einer. " * 9) for i in range(64)], "doc_id long, text string").coalesce(1), "docs")
    found = compare.involved(docs, compare.candidate_pairs(docs))
    assert found.count() == 64 and "REPARTITION_BY_NUM" in plan(found).split("MapInArrow")[-1]


def test_pairs_with_one_side_are_not_normalised(spark):
    """Every row was normalised, orphans as well, which took most of the time of decided."""
    rows = [("j", 1, 0, None, "Eins zwei.", ""), ("j", 2, None, 0, "", "Drei."), ("j", 3, 1, 1, "1) Vier", "Vier"), ("j", 4, 2, 2, "Eins zwei drei", "Ganz anders"), ("j", 5, 3, 3, "", "")]
    pairs = spark.createDataFrame(rows, "job_id string, pair_index int, a_index int, b_index int, text_a string, text_b string")
    got = {r.pair_index: (r.decided, r.normal_a) for r in decide.heuristics(pairs).collect()}
    assert got == {1: ("orphan_a", None), 2: ("orphan_b", None), 3: ("normalized_equal", "Vier"), 4: (None, "Eins zwei drei"), 5: ("empty_pair", None)}


def test_tiles_are_dealt_to_as_many_tasks_as_there_are_partitions(spark, monkeypatch):
    """Tiles have few bytes for their work, and adaptive execution merged them into one task."""
    monkeypatch.setattr(align, "CELLS", 0)
    segment = lambda k: (k, f"Satz {k} von vielen", 0, 9)
    jobs = spark.createDataFrame([("j", [segment(k) for k in range(30)], [segment(k) for k in range(28)])], f"job_id string, segments_a {align.SEGMENTS}, segments_b {align.SEGMENTS}")
    found = align.aligned(jobs)
    assert found.count() == 30 and "REPARTITION_BY_NUM" in plan(found)
