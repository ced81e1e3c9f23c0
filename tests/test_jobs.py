"""Failures, expiring state, the work queue and snapshots."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from docdelta.operators import decide, metrics
from docdelta.plans import compare, progress
from docdelta.streaming import jobs


def open_pairs(spark, rows):
    """rows (job, index, question): pairs that differ."""
    pairs = spark.createDataFrame([(j, i, q, f"respuesta larga y distinta {q[::-1]}") for j, i, q in rows], "job_id string, pair_index int, text_a string, text_b string")
    index = F.col("pair_index") - 1
    return pairs.withColumns({
        **{f"{x}_index": index for x in ("a", "b")}, **{f"{x}_indices": F.array(index) for x in ("a", "b")}, **{f"block_chars_{x}": F.lit(5) for x in ("a", "b")},
        **{f"chars_{x}": F.lit(50) for x in ("a", "b")}, "alignment_score": F.lit(0.5), "pair_type": F.lit("matched"), "__first": F.lit("own"), "a.b": F.lit(1),
    })


def by_last(log=None):
    """A model by the question's last word; it notes in log what it was asked."""

    def answer(prompt):
        text = json.loads(prompt[1]["content"])["block_a"]["text"]
        if log:
            with open(log, "a") as f:
                f.write(text + "\n")
        match text.split()[-1]:
            case "key":
                raise KeyError("k")
            case "none":
                return None
            case "bad":
                raise decide.ResponseError("bad")
            case "exit":
                raise AssertionError
        return json.dumps({"choices": [{"message": {"content": {"changes": [{"change_type": "added", "source_b": text}]}}}]})

    return lambda: answer


def outcomes(rows):
    return {(r.job_id, r.pair_index): (r.row_source, r.error and (r.error.stage, r.error.error_type, r.error.message), len(r.changes)) for r in rows.collect()}


@pytest.mark.parametrize("wave", [1, 2, 32])
def test_every_exception_is_an_outcome(spark, monkeypatch, wave):
    monkeypatch.setattr(decide, "WAVE", wave)
    rows = [("j", 1, "uno ok"), ("j", 2, "uno key"), ("j", 3, "uno ok"), ("j", 4, "dos bad"), ("j", 5, "dos bad"), ("j", 6, "tres none"), ("j", 7, "uno key"), ("j", 8, "x exit"), ("k", 1, "uno key"), ("l", 1, "uno ok")]
    pairs = open_pairs(spark, rows).drop("__first")
    got = outcomes(decide.decided(pairs, by_last(), ratio=0.9))
    assert got == {
        ("j", 1): ("llm", None, 1), ("j", 2): ("failed", ("compare_pair", "KeyError", "'k'"), 0), ("j", 3): ("cache", None, 1), ("j", 4): ("fallback", ("compare_pair_fallback", "ResponseError", "bad"), 1), ("j", 5): ("cache", None, 1),
        ("j", 6): ("fallback", ("compare_pair_fallback", "ResponseError", decide.UNUSABLE), 1), ("j", 7): ("failed", ("compare_pair", "KeyError", "'k'"), 0), ("j", 8): ("failed", ("compare_pair", "AssertionError", "AssertionError"), 0),
        ("k", 1): ("failed", ("compare_pair", "KeyError", "'k'"), 0), ("l", 1): ("llm", None, 1),
    }
    stopped = outcomes(decide.decided(pairs, by_last(), ratio=0.2))
    assert stopped == {k: v for k, v in got.items() if k != ("j", 8)}  # int(8 * 0.2) = 1 failure is borne, the second ends the job


def test_a_job_behind_its_limit_is_not_asked(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(decide, "WAVE", 2)
    log = tmp_path / "asked"
    rows = [("j", i, f"n{i} key") for i in range(1, 21)] + [("k", i, f"m{i} ok") for i in range(1, 21)]
    got = outcomes(decide.decided(open_pairs(spark, rows).drop("__first"), by_last(str(log)), ratio=0.0))
    assert {k for k in got if k[0] == "j"} == {("j", 1)} and sum(k[0] == "k" for k in got) == 20
    asked = log.read_text().split("\n")
    assert sum(x.endswith("key") for x in asked) == 2 and sum(x.endswith("ok") for x in asked) == 20


def test_job_payloads_and_served(spark):
    pairs = open_pairs(spark, [("j", 1, "a ok"), ("j", 2, "b key"), ("j", 3, "b key"), ("k", 1, "c bad")]).drop("__first")
    decided = decide.decided(pairs, by_last())
    facts = {r.job_id: r for r in metrics.job_facts(decided).collect()}
    assert (facts["j"].failed_blocks, facts["j"].threshold, facts["j"].threshold_reached, facts["j"].compared_pairs, facts["j"].status) == (2, 1, True, 3, "error")
    assert [e.pair_id for e in facts["j"].errors] == ["j-2", "j-3"] and facts["j"].aligned_a == 5
    docs = spark.createDataFrame([(1, "x" * 50), (2, "y" * 50)], "doc_id long, clean_text string").withColumn("segments", F.array(F.lit(1), F.lit(2)))
    jobs_ = spark.createDataFrame([("j", 1, 2), ("k", 2, 1), ("none", 1, 1)], "job_id string, doc_a long, doc_b long")
    rows = decided.select("job_id", F.explode("changes").alias("c"))
    got = {r.job_id: r for r in compare.job_payloads(decided, rows, jobs_, docs).collect()}
    assert (got["j"].ok, got["j"].error, got["j"].progress.step) == (False, "Resultado parcial: 2 de 3 bloques fallidos", "completado_con_errores")
    assert (got["k"].ok, got["k"].error, got["k"].meta.cache.resolved_by_fallback) == (True, "Resultado parcial: 1 bloques resueltos con fallback local", 1)
    assert (got["none"].status, got["none"].error, got["none"].meta.diagnostics.total_pairs, got["none"].meta.segmentation.doc_a_blocks) == ("done", None, 0, 2)
    assert got["j"].meta.diagnostics.alignment_coverage_ratio_a == 0.1 and got["j"].meta.diagnostics.failed_ratio == pytest.approx(2 / 3)
    empty = decide.decided(pairs.limit(0), by_last())
    assert empty.count() == 0 and compare.job_payloads(empty, rows.limit(0), jobs_, docs).where("status = 'done'").count() == 3


EVENT = "sid string, field string, value string, ts timestamp, seq long"
DAY = dt.datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    """A file of events whose times are hours."""
    path = folder / name
    spark.createDataFrame([(s, f, v, None if h is None else DAY + dt.timedelta(hours=h), q) for s, f, v, h, q in rows], EVENT).coalesce(1).write.parquet(str(path))
    time.sleep(0.02)


def expired(spark, folder, out):
    stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    jobs.append_stream(jobs.expiring(stream, "ts"), str(out / "rows"), str(out / "log")).start().awaitTermination()
    return sorted((r.sid, r.life, r.field, r.value) for r in spark.read.schema("sid string, life int, field string, value string, updated timestamp").parquet(str(out / "rows")).collect())


def test_state_goes_a_day_behind_its_last_update(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    put(spark, src, "1", [("a", "x", "old", 0, 1), ("a", "x", "new", 1, 2), ("a", "y", "tie1", 1, 3), ("a", "y", "tie2", 1, 4), ("b", "x", "b", 2, 1), (None, "x", "v", 3, 1), ("c", None, "v", 3, 1), ("c", "x", "v", None, 1)])
    assert expired(spark, src, out) == []
    put(spark, src, "2", [("b", "y", "more", 20, 2)])
    assert expired(spark, src, out) == []
    put(spark, src, "3", [("d", "x", None, 25.5, 1)])  # a's day is over, b's isn't
    assert expired(spark, src, out) == [("a", 0, "x", "new"), ("a", 0, "y", "tie2")]
    put(spark, src, "4", [("a", "z", "again", 30, 1), ("b", "x", "late", 46, 3)])  # a begins anew; b begins anew 26 hours behind its last
    assert expired(spark, src, out) == [("a", 0, "x", "new"), ("a", 0, "y", "tie2"), ("b", 0, "x", "b"), ("b", 0, "y", "more")]
    put(spark, src, "5", [("e", "x", "e", 200, 1)])
    got = expired(spark, src, out)
    assert ("b", 1, "x", "late") in got and ("d", 0, "x", None) in got and any(x[2:] == ("z", "again") for x in got) and not any(x[0] == "e" for x in got)


JOB = "sid string, path_a string, path_b string"


def worked(spark, src, out, run, **options):
    stream = spark.readStream.schema(JOB).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    jobs.work(stream, run, str(out / "jobs"), str(out / "log"), **options).start().awaitTermination()
    return {r.sid: (r.status, r.error) for r in spark.read.parquet(str(out / "jobs/states")).collect()}


def queue_file(spark, src, name, rows):
    spark.createDataFrame(rows, JOB).coalesce(1).write.parquet(str(src / name))
    time.sleep(0.02)


def test_each_job_once_over_two_runs(spark, tmp_path):
    src = tmp_path / "q"
    run = lambda new: new.select("sid", F.concat("path_a", "path_b").alias("both"))
    queue_file(spark, src, "1", [("a", "1", "2"), ("a", "1", "2"), ("b", "3", "4"), (None, "5", "6")])
    assert worked(spark, src, tmp_path, run) == {"a": ("done", None), "b": ("done", None)}
    assert worked(spark, src, tmp_path, run) == {"a": ("done", None), "b": ("done", None)}
    queue_file(spark, src, "2", [("b", "3", "4"), ("c", "7", "8")])
    assert set(worked(spark, src, tmp_path, run)) == {"a", "b", "c"}
    results = spark.read.parquet(str(tmp_path / "jobs/results"))
    assert sorted((r.sid, r.both) for r in results.collect()) == [("a", "12"), ("b", "34"), ("c", "78")] and spark.read.parquet(str(tmp_path / "jobs/states")).count() == 3


def test_failing_and_slow_jobs_become_errors(spark, tmp_path):
    src = tmp_path / "q"
    queue_file(spark, src, "1", [("slow", "1", "2")])
    queue_file(spark, src, "2", [("bad", "1", "2")])
    queue_file(spark, src, "3", [("good", "1", "2")])

    def sleepy(batches):
        for b in batches:
            if "slow" in b.column(0).to_pylist():
                time.sleep(60)
            yield b

    def run(new):
        if new.where("sid = 'bad'").count():
            raise ValueError("broken file")
        return new.select("sid").mapInArrow(sleepy, "sid string")

    began = time.time()
    got = worked(spark, src, tmp_path, run, seconds=4)
    assert time.time() - began < 50
    assert got["slow"] == ("error", "time limit of 4 s") and got["good"] == ("done", None) and got["bad"][0] == "error" and "broken file" in got["bad"][1]


def test_snapshots_equal_the_batch_result(spark, tmp_path):
    rows = [(j, i, 6, "llm", [f"c{i % 4}"]) for j in ("j", "k") for i in range(1, 7)]
    kind = "job_id string, pair_index int, total_pairs long, row_source string, changes array<string>"
    rows_of = lambda pairs: pairs.select("job_id", F.explode("changes").alias("c")).distinct()
    src, out = tmp_path / "in", str(tmp_path / "snap")

    def run(own, every):
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(kind).parquet(str(src))
        jobs.snapshots(stream, rows_of, out, str(tmp_path / "log"), every).start().awaitTermination()
        got, progress = jobs.latest(spark, out)
        return sorted((r.job_id, r.c) for r in got.collect()), {r.job_id: (r.completed_pairs, r.percent) for r in progress.collect()}

    want = lambda n, job: sorted({(job, f"c{i % 4}") for i in range(1, n + 1)})
    assert run([r for r in rows if r[0] == "j" and r[1] <= 2], 2) == (want(2, "j"), {"j": (2, 45)})
    assert run([r for r in rows if r[0] == "j" and r[1] == 3] + [r for r in rows if r[0] == "k" and r[1] <= 4], 2) == (want(2, "j") + want(4, "k"), {"j": (2, 45), "k": (4, 70)})
    assert run([r for r in rows if r[0] == "j" and r[1] > 3], 2) == (want(6, "j") + want(4, "k"), {"j": (6, 95), "k": (4, 70)})


def test_phases_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decide, "WAVE", 1)
    text = "El contrato de arrendamiento entra en vigor el primer dia del mes. Las partes firman dos copias iguales del documento. El pago se realiza cada trimestre sin demora."
    other = text.replace("dos copias", "nueve ejemplares completos y sellados").replace("trimestre", "semana habil")
    docs = spark.createDataFrame([(1, text), (2, other), (3, ""), (4, text)], "doc_id long, text string")
    pairs = spark.createDataFrame([("edit", 1, 2), ("same", 1, 4), ("none", 3, 3)], "job_id string, doc_a long, doc_b long")
    path = str(tmp_path / "states")
    decided = progress.compared_with_progress(docs, pairs, path, by_last())
    want = compare.compared(docs, pairs, by_last())
    assert sorted(map(str, decided.select("job_id", "pair_index", "row_source").collect())) == sorted(map(str, want.select("job_id", "pair_index", "row_source").collect()))
    told = spark.read.parquet(path).where("field = 'percent'").orderBy("seq").collect()
    percents = {s: [int(r.value) for r in told if r.sid == s] for s in ("edit", "same", "none")}
    assert percents["none"] == [20, 32, 42]
    for s in ("edit", "same"):
        assert percents[s][:3] == [20, 32, 42] and percents[s][-1] == 100 and percents[s][-2] == 95 and percents[s][3:] == sorted(percents[s][3:]) and min(percents[s][3:]) >= 20
    states = {(r.sid, r.field): r.value for r in progress.jobs.fold(spark.read.parquet(path)).collect()}
    assert states["same", "status"] == "done" and json.loads(states["edit", "metrics"])["phase"] == "completed" and states["edit", "step"] == "completado"
    phases = [json.loads(r.value) for r in spark.read.parquet(path).where("field = 'metrics' and sid = 'edit'").orderBy("seq").collect()]
    assert [x["phase"] for x in phases][:3] == ["extraction", "extraction", "pairing"] and phases[1]["doc_a_blocks"] > 0 and [x["elapsed_ms"] for x in phases] == sorted(x["elapsed_ms"] for x in phases)


def test_heuristics_are_one_pass_and_prompts_are_not_dealt(spark):
    pairs = spark.createDataFrame([("j", k, f"uno {k % 3}", "otra cosa" if k % 2 else f"uno {k % 3}") for k in range(1, 9)], "job_id string, pair_index int, text_a string, text_b string")
    pairs = pairs.select("*", *[F.col("pair_index").alias(f"{x}_index") for x in ("a", "b")], *[F.array("pair_index").alias(f"{x}_indices") for x in ("a", "b")], F.lit("matched").alias("pair_type"), F.lit(0.5).alias("alignment_score"))
    found = decide.heuristics(pairs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 1
    assert {(r.pair_index, r.decided) for r in found.collect()} == {(k, None if k % 2 else "normalized_equal") for k in range(1, 9)}
    open_ = found.where("decided is null").withColumn("own", decide.fallback(F.col("text_a"), F.col("text_b"), F.col("a_index"), F.col("b_index")))
    answers = decide.ask(open_, lambda: lambda prompt: json.dumps({"choices": [{"message": {"content": json.dumps({"changes": [{"type": "new", "a": json.loads(prompt[1]["content"])["block_a"]["text"]}]})}}]}))
    assert "messages" not in answers.columns
    shuffled = answers._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.index("Responde exclusivamente") < shuffled.index("RepartitionByExpression")  # made above the shuffle
    assert {(r.pair_index, r.row_source, r.changes[0].source_a) for r in answers.collect()} == {(1, "llm", "uno 1"), (3, "llm", "uno 0"), (5, "llm", "uno 2"), (7, "cache", "uno 1")}


def test_only_what_the_model_needs_goes_through_python(spark):
    pair = {"job_id": 1, "normal_a": "a", "normal_b": "b", "text_a": "a", "text_b": "b", "a_index": 0, "b_index": 0, "a_indices": [0], "b_indices": [0], "alignment_score": 0.5, "pair_type": "matched"}
    rows = spark.createDataFrame([{**pair, "pair_index": k} for k in (1, 2)] + [{**pair, "pair_index": k, "normal_b": "c", "text_b": "c"} for k in (3, 4)] + [{**pair, "pair_index": 5, "normal_b": "d", "text_b": "d"}])

    def model():
        def answer(prompt):
            assert [x["role"] for x in prompt] == ["system", "user"]
            b = json.loads(prompt[1]["content"])["block_b"]["text"]
            if b == "c":
                raise decide.ResponseError("none")
            if b == "d":
                raise LookupError("lost")
            return json.dumps({"choices": [{"message": {"content": {"changes": [{"change_type": "new", "source_b": b}]}}}]})

        return answer

    found = decide.ask(rows, model)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # the pairs' other columns stay where they are
    got = {x.pair_index: (x.row_source, [c.change_type for c in x.changes], x.error and x.error.error_type) for x in found.collect()}
    assert got == {1: ("llm", ["añadido"], None), 2: ("cache", ["añadido"], None), 3: ("fallback", ["modificado"], "ResponseError"), 4: ("cache", ["modificado"], None), 5: ("failed", [], "LookupError")}
