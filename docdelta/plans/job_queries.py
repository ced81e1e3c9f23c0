"""Registered queries for jobs: failures, results, state that expires, the work queue, snapshots, progress; with DuckDB SQL of the same rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docdelta.checkpoint import shared_dir, written
from docdelta.operators import chat, decide, metrics, postprocess, segment, view
from docdelta.plans import compare, progress
from docdelta.plans.queries import _t, query
from docdelta.sources import files
from docdelta.streaming import jobs

# Open pairs made of events: a user is a job; the model loses some questions and has no usable answer to others.
FAIL_RATIO = 0.1
_ASKED = """n AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pair_index, event_id % 9 AS k, event_id % 5 = 0 AS same, event_type FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, event_type, k, same ORDER BY pair_index) AS turn, floor(count(*) OVER (PARTITION BY job_id) * 0.1) AS most, count(*) OVER (PARTITION BY job_id) AS total FROM n),
s AS (SELECT *, CASE WHEN same THEN 'heuristic' WHEN k IN (1, 2) THEN 'failed' WHEN turn > 1 THEN 'cache' WHEN k IN (3, 4) THEN 'fallback' ELSE 'llm' END AS row_source FROM r),
p AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN row_source = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY pair_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) WHERE before <= most)"""


def _unsteady_model():
    """A model whose answer depends on the last letter of the question alone."""

    def answer(prompt: list[dict]) -> str:
        text = json.loads(prompt[1]["content"])["block_a"]["text"]
        if text[-1] in "12":
            raise LookupError(f"lost {text[-1]}")
        if text[-1] in "34":
            raise decide.ResponseError("no answer")
        return json.dumps({"choices": [{"message": {"content": {"changes": [{"change_type": "modificado", "source_a": text}]}}}]})

    return answer


def _questions(spark, d) -> DataFrame:
    index = F.col("n")
    e = _t(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    question = F.concat(F.lit("pregunta "), F.col("event_type"), F.lit(" "), F.col("event_id") % 9)
    indices = F.array(index - 1)
    pairs = e.select(
        F.col("user_id").alias("job_id"), index.alias("pair_index"), question.alias("text_a"), F.when(F.col("event_id") % 5 == 0, question).otherwise("respuesta que no se le parece").alias("text_b"),
        *[(index - 1).alias(f"{x}_index") for x in ("a", "b")], *[indices.alias(f"{x}_indices") for x in ("a", "b")], *[F.lit(10).alias(f"block_chars_{x}") for x in ("a", "b")], *[F.lit(100).alias(f"chars_{x}") for x in ("a", "b")],
        F.lit(0.5).alias("alignment_score"), F.lit("matched").alias("pair_type"),
    )
    return pairs


def _decided(spark, d) -> DataFrame:
    return decide.decided(_questions(spark, d), lambda: _unsteady_model(), ratio=FAIL_RATIO)


@query(f"""WITH {_ASKED} SELECT job_id, CAST(pair_index AS INTEGER) AS pair_index, row_source, CASE WHEN row_source IN ('heuristic', 'failed') THEN 0 ELSE 1 END AS changes,
CASE row_source WHEN 'failed' THEN 'compare_pair' WHEN 'fallback' THEN 'compare_pair_fallback' END AS stage, CASE row_source WHEN 'failed' THEN 'LookupError' WHEN 'fallback' THEN 'ResponseError' END AS error_type,
CASE row_source WHEN 'failed' THEN concat('lost ', k) WHEN 'fallback' THEN 'no answer' END AS message FROM p""")
def pair_outcomes(spark, d):
    """Pairs decided by a model that fails: each has its outcome, and a job ends where it has failed too often."""
    return _decided(spark, d).select("job_id", "pair_index", "row_source", F.size("changes").alias("changes"), "error.stage", "error.error_type", "error.message")


@query(f"""WITH {_ASKED}, g AS (SELECT job_id, max(total) AS total_pairs, CAST(max(most) AS BIGINT) AS threshold, count(*) FILTER (row_source = 'failed') AS failed_blocks, count(*) FILTER (row_source = 'fallback') AS fallback_blocks,
count(*) FILTER (row_source = 'cache') AS cache_hits, count(*) FILTER (row_source IN ('llm', 'cache')) AS llm_rows, count(*) FILTER (row_source = 'fallback') AS fallback_rows, max(pair_index) AS last FROM p GROUP BY job_id)
SELECT job_id, total_pairs, CASE WHEN failed_blocks > threshold THEN last ELSE total_pairs END AS compared_pairs, threshold, failed_blocks > threshold AS threshold_reached, failed_blocks, fallback_blocks, cache_hits, llm_rows, fallback_rows,
failed_blocks + fallback_blocks AS errors, CASE WHEN failed_blocks = 0 AND fallback_blocks = 0 THEN 'done' WHEN failed_blocks / CAST(total_pairs AS DOUBLE) >= 0.5 THEN 'error' ELSE 'done_with_warnings' END AS status FROM g""")
def job_diagnostics(spark, d):
    facts = metrics.job_facts(_decided(spark, d))
    return facts.select("job_id", "total_pairs", "compared_pairs", "threshold", "threshold_reached", "failed_blocks", "fallback_blocks", "cache_hits", "llm_rows", "fallback_rows", F.size("errors").cast("long").alias("errors"), "status")


def _results(spark, d) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "events")
    results = e.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("sid")).agg(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("rows"))
    results = results.select("sid", F.lit("done").alias("status"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), "rows", F.when(F.col("sid") % 2 == 0, "{}").alias("meta"))
    states = e.select(F.col("user_id").alias("sid")).distinct().withColumn("status", F.when(F.col("sid") % 2 == 0, "error").otherwise("running"))
    return results, states.withColumn("error", F.concat(F.lit("fallo "), F.col("sid")))


@query("""WITH r AS (SELECT user_id AS sid, count(*) FILTER (event_type = 'click') AS n FROM events WHERE user_id % 3 = 0 GROUP BY ALL)
SELECT sid, 'done' AS status, true AS ok, NULL AS error, CAST(n AS INTEGER) AS rows FROM r UNION ALL SELECT DISTINCT user_id, 'error', false, concat('fallo ', user_id), 0 FROM events WHERE user_id % 2 = 0 AND user_id % 3 <> 0""")
def served_results(spark, d):
    """What readers of jobs get: results, and errors of jobs that have a state alone."""
    return compare.served(*_results(spark, d)).withColumn("rows", F.size("rows"))


@query("SELECT user_id AS sid FROM events WHERE user_id % 3 = 0 GROUP BY user_id HAVING user_id % 2 = 0 OR count(*) FILTER (event_type = 'click') > 0")
def useful_results(spark, d):
    return compare.has_useful_data(_results(spark, d)[0]).select("sid")


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files, one file at a time."""
    source = _t(spark, d, name)
    # A stream reads folders: a table of one file is read from a folder that lists only that file.
    one = len(source.inputFiles()) == 1
    reader = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"{name}.parquet" if one else "*.parquet")
    return reader.parquet(d if one else f"{d}/{name}.parquet")


_LIVES = """e AS (SELECT CAST(user_id AS VARCHAR) AS sid, event_type AS field, CAST(event_id AS VARCHAR) AS value, ts, event_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 86400000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY sid ORDER BY us, event_id)),
l AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY sid ORDER BY us, event_id) AS INTEGER) AS life FROM g),
f AS (SELECT sid, life, field, arg_max(value, (us, event_id)) AS value, max(us) AS updated, max(max(us)) OVER (PARTITION BY sid, life) AS last FROM l GROUP BY sid, life, field)"""


@query(f"WITH {_LIVES} SELECT sid, life, field, value, updated FROM f WHERE last // 1000 + 86400000 < (SELECT max(us) // 1000 FROM e)")
def expired_states(spark, d):
    """Users as jobs whose state goes a day behind their last event: what was known of them then."""
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("field"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = shared_dir(spark, "expired")
    stream = jobs.expiring(rows.withColumn("value", F.col("event_id")), "ts", tie="event_id")
    jobs.append_stream(stream, path, shared_dir(spark, "expired_log")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).withColumn("updated", F.unix_micros("updated"))


@query("SELECT user_id AS sid, count(*) AS rows, 'done' AS status, CAST(NULL AS VARCHAR) AS error FROM events GROUP BY user_id")
def worked_jobs(spark, d):
    """Users as jobs of a queue: each is worked on once, though the queue holds it many times."""
    events, path = _t(spark, d, "events"), shared_dir(spark, "work")
    queue = _stream(spark, d, "events").select(F.col("user_id").alias("sid"))
    run = lambda new: new.join(events.select(F.col("user_id").alias("sid")), "sid").groupBy("sid").agg(F.count("*").alias("rows"))
    jobs.work(queue, run, path, shared_dir(spark, "work_log")).start().awaitTermination()
    return spark.read.parquet(f"{path}/states").drop("batch").join(spark.read.parquet(f"{path}/results").drop("batch"), "sid", "left").select("sid", "rows", "status", "error")


@query(f"""WITH {_ASKED}, g AS (SELECT job_id, count(*) FILTER (row_source = 'failed') AS f, count(*) FILTER (row_source = 'fallback') AS b, max(total) AS t, max(pair_index) AS last, max(most) AS most FROM p GROUP BY job_id),
z AS (SELECT *, CASE WHEN f = 0 AND b = 0 THEN 'done' WHEN f / CAST(t AS DOUBLE) >= 0.5 THEN 'error' ELSE 'done_with_warnings' END AS status FROM g)
SELECT CAST(job_id AS VARCHAR) AS sid, '100' AS percent, CASE status WHEN 'error' THEN 'completado_con_errores' ELSE 'completado' END AS step, status, CASE WHEN f > most THEN last ELSE t END AS completed, true AS in_order FROM z""")
def progress_states(spark, d):
    """The last state that each job tells, and whether it told its percents in order."""
    told = progress.Progress(spark, shared_dir(spark, "progress"))
    progress.decided_with_progress(_questions(spark, d), told, lambda: _unsteady_model(), ratio=FAIL_RATIO)
    states = told.states().groupBy("sid").agg(*[F.max(F.when(F.col("field") == x, F.col("value"))).alias(x) for x in ("percent", "step", "status", "metrics")])
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("value").cast("int").alias("percent")))), lambda x: x["percent"])
    order = spark.read.parquet(told.path).where("field = 'percent'").groupBy("sid").agg(steps.alias("steps")).select("sid", (F.col("steps") == F.array_sort("steps")).alias("in_order"))
    return states.join(order, "sid").select("sid", "percent", "step", "status", F.get_json_object("metrics", "$.completed_pairs").cast("long").alias("completed"), "in_order")


@query(f"WITH {_ASKED}, k AS (SELECT job_id, event_type, k, min(pair_index) AS first FROM p WHERE row_source IN ('llm', 'cache', 'fallback') GROUP BY ALL), c AS (SELECT job_id, count(*) AS rows FROM k GROUP BY job_id) SELECT p.job_id, count(*) AS completed_pairs, count(*) FILTER (row_source = 'failed') AS failed_blocks, count(*) FILTER (row_source = 'fallback') AS fallback_blocks, max(coalesce(rows, 0)) AS rows, least(99, CAST(floor(count(*) / CAST(max(total) AS DOUBLE) * 75) AS INTEGER) + 20) AS percent FROM p LEFT JOIN c USING (job_id) GROUP BY p.job_id")
def result_snapshots(spark, d):
    """The newest snapshot of each job: its progress and the number of its de-duplicated rows, by exact duplicates."""
    decided = _decided(spark, d).select("job_id", "pair_index", "total_pairs", "row_source", "text_a", "text_b", "changes")
    source = written(decided, "decided").written_to
    stream = spark.readStream.schema(decided.schema).option("maxFilesPerTrigger", 4).parquet(source)
    path = shared_dir(spark, "snapshots")
    rows_of = lambda pairs: pairs.where(F.size("changes") > 0).select("job_id", "text_a", "text_b").distinct()
    jobs.snapshots(stream, rows_of, path, shared_dir(spark, "snapshots_log")).start().awaitTermination()
    rows, progress = jobs.latest(spark, path)
    counts = rows.groupBy("job_id").agg(F.count("*").alias("rows"))
    return progress.join(counts, "job_id", "left").fillna(0, "rows").select("job_id", "completed_pairs", "failed_blocks", "fallback_blocks", "rows", "percent")


# Rows with all searched fields, made of events; segments hold what no other field has.
_WIDE = """w AS (SELECT event_id AS block_id, lower(concat_ws(' ', concat('p-', user_id), CASE event_type WHEN 'click' THEN 'añadido' ELSE 'modificado' END, CASE user_id % 3 WHEN 0 THEN 'alta' ELSE 'Media' END, CASE event_id % 4 WHEN 0 THEN 'critica' ELSE 'baja' END,
concat('Resumen ', user_id % 50), CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('nota ', event_type) END, concat('Texto ', user_id % 20), concat('texto ', user_id % 7), concat('Texto ', user_id % 20), concat('texto ', user_id % 7),
concat('trozo', event_id % 11, ' ', event_type), concat('otro', event_id % 13, ' '), CASE event_id % 3 WHEN 0 THEN 'llm' ELSE 'heuristic' END, 'heuristic', concat('modelo-', event_id % 5), event_id % 97, user_id % 89)) AS t FROM events),
q AS (SELECT DISTINCT query FROM (SELECT lower(substr(event_type, 1, 1 + CAST(event_id % 5 AS BIGINT))) AS query FROM events UNION ALL SELECT concat('resumen ', user_id % 50) FROM events UNION ALL SELECT concat('trozo', event_id % 17) FROM events UNION ALL SELECT concat(event_id % 97, ' ', user_id % 89) FROM events WHERE event_id % 50 = 0 UNION ALL SELECT 'añad') WHERE query <> '')"""


def _wide(spark, d) -> tuple[DataFrame, DataFrame]:
    e, u, i = _t(spark, d, "events"), F.col("user_id"), F.col("event_id")
    numbered = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    part = lambda *texts: F.array(*[F.struct(F.lit("equal").alias("type"), x.alias("text")) for x in texts])
    rows = e.select(
        i.alias("block_id"), numbered("p-", u).alias("pair_id"), F.when(F.col("event_type") == "click", "añadido").otherwise("modificado").alias("change_type"), F.when(u % 3 == 0, "alta").otherwise("Media").alias("confidence"),
        F.when(i % 4 == 0, "critica").otherwise("baja").alias("severity"), numbered("Resumen ", u % 50).alias("summary"), F.when(i % 6 != 0, F.concat(F.lit("nota "), "event_type")).alias("llm_comment"),
        numbered("Texto ", u % 20).alias("text_a"), numbered("texto ", u % 7).alias("text_b"), numbered("Texto ", u % 20).alias("display_text_a"), numbered("texto ", u % 7).alias("display_text_b"),
        part(numbered("trozo", i % 11), F.col("event_type")).alias("display_segments_a"), part(numbered("otro", i % 13), F.lit("")).alias("display_segments_b"),
        F.when(i % 3 == 0, "llm").otherwise("heuristic").alias("result_origin"), F.lit("heuristic").alias("decision_source"), numbered("modelo-", i % 5).alias("model_name"), (i % 97).alias("chunk_index_a"), (u % 89).alias("chunk_index_b"),
    )
    queries = e.select(F.explode(F.array(F.substr("event_type", F.lit(1), (1 + i % 5).cast("int")), numbered("resumen ", u % 50), numbered("trozo", i % 17), F.when(i % 50 == 0, F.concat_ws(" ", i % 97, u % 89)), F.lit("  AÑAD"))).alias("query"))
    return rows, queries


@query(f"WITH {_WIDE} SELECT query, count(*) AS n, min(block_id) AS first, max(block_id) AS last, CAST(sum(block_id) AS BIGINT) AS total FROM q JOIN w ON contains(t, query) GROUP BY query")
def view_search_index(spark, d):
    """Texts looked for in all seventeen searched fields by an index of their substrings."""
    rows, queries = _wide(spark, d)
    found = view.searched(rows, view.search_index(rows, ["block_id"]), queries, ["block_id"])
    return found.groupBy("query").agg(F.count("*").alias("n"), F.min("block_id").alias("first"), F.max("block_id").alias("last"), F.sum("block_id").alias("total"))


@query("""SELECT event_id, concat('p-', user_id) AS pair_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'h1' END, CASE WHEN event_id % 3 = 0 THEN 'h2' END, '') AS pair_hash, coalesce(CASE WHEN event_id % 3 = 0 THEN 'h2' END, CASE WHEN event_id % 5 = 0 THEN 'h1' END, '') AS cache_pair_hash,
CASE WHEN event_id % 2 = 0 THEN 'vista' ELSE concat('texto ', user_id) END AS display_text_a, concat('texto ', user_id) AS prompt_text_a_literal, 'pendiente_confirmacion' AS materiality, CASE WHEN event_id % 4 = 0 THEN 'alta' ELSE 'baja' END AS confidence,
CASE WHEN event_id % 7 = 0 THEN 'llm' WHEN user_id % 2 = 0 THEN 'cache' ELSE 'fallback' END AS result_origin, CASE WHEN user_id % 3 = 0 THEN 'validated' ELSE 'fallback_applied' END AS result_validation_status,
CASE WHEN event_id % 6 = 0 THEN true ELSE user_id % 3 <> 0 END AS fallback_applied, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id END AS block_word_count_a, '' AS impact, 0 AS offset_end_b, CAST(0.5 AS DOUBLE) AS alignment_score, 2 AS segments, 1 AS related, 57 AS fields FROM events""")
def view_row_fields(spark, d):
    """All fields of rows as readers get them, from rows that have some."""
    u, i = F.col("user_id"), F.col("event_id")
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), F.lit(x).alias("text"))
    rows = _t(spark, d, "events").select(
        "event_id", F.concat(F.lit("p-"), u).alias("pair_id"), F.when(i % 5 == 0, "h1").otherwise("").alias("pair_hash"), F.when(i % 3 == 0, "h2").alias("cache_pair_hash"), F.concat(F.lit("texto "), u).alias("text_a"), F.when(i % 2 == 0, "vista").alias("display_text_a"),
        F.when(i % 4 == 0, "alta").alias("confidence"), F.when(i % 7 == 0, "llm").alias("result_origin"), (u % 2 == 0).alias("cache_hit"), (u % 3 == 0).alias("llm_success"), F.when(i % 6 == 0, True).alias("fallback_applied"),
        F.when(i % 9 == 0, "x").otherwise(i.cast("string")).alias("block_word_count_a"), F.lit("0.5").alias("alignment_score"), F.array(part(" Equal", "a"), part("unbekannt", "b"), part("insert", ""), part("delete", "c")).alias("display_segments_a"), F.array(F.lit(0), F.lit(4)).alias("related_block_ids"),
    )
    out = view.normalized_rows(rows, ["event_id"])
    picked = ["pair_id", "pair_hash", "cache_pair_hash", "display_text_a", "prompt_text_a_literal", "materiality", "confidence", "result_origin", "result_validation_status", "fallback_applied", "block_word_count_a", "impact"]
    return out.select("event_id", *picked, F.col("offset_end_b").cast("int").alias("offset_end_b"), "alignment_score", F.size("display_segments_a").alias("segments"), F.size("related_block_ids").alias("related"), F.lit(len(out.columns) - 1).alias("fields"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN concat('Parejas: ', event_id % 4, '/4;') ELSE 'Parejas: 0/4;' END || CASE WHEN user_id % 3 > 0 THEN concat('Fallos: ', user_id % 3, ';') ELSE '' END || CASE WHEN user_id % 2 > 0 THEN 'Fallback local: 1;' ELSE '' END || concat('Fase: ', event_type) || CASE WHEN event_id % 2 = 0 THEN ';Documento: A' ELSE '' END AS facts FROM events")
def progress_facts(spark, d):
    u, i = F.col("user_id"), F.col("event_id")
    state = F.struct((i % 4).alias("completed_pairs"), F.lit(4).alias("total_pairs"), (u % 3).alias("failed_blocks"), (u % 2).alias("fallback_blocks"), F.col("event_type").alias("phase"), F.when(i % 2 == 0, "A").alias("current_file"))
    return _t(spark, d, "events").select("event_id", F.array_join(metrics.progress_facts(state), ";").alias("facts"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def favourite_chats(spark, d):
    """The entries of users that are among given ones."""
    wanted = _t(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey")
    return chat.favourites(_t(spark, d, "events").select("event_id", "user_id"), "user_id", wanted)


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS place FROM customer QUALIFY place <= 100")
def chats_in_name_order(spark, d):
    """The first hundred in order of names, numbered as they come."""
    rows = chat.by_name(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey").limit(100)
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)  # one partition: numbers from 1 in the order of the rows


_REPLY = """CASE event_id % 6 WHEN 0 THEN 'eliminado' WHEN 1 THEN 'añadido' WHEN 2 THEN 'modificado' WHEN 3 THEN 'añadido' WHEN 4 THEN 'modificado' END"""


@query(f"SELECT event_id, {_REPLY} AS change_type, CASE event_id % 6 WHEN 1 THEN '' WHEN 5 THEN NULL ELSE event_type END AS source_a, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 0 THEN 'alta' ELSE 'media' END AS confidence, CASE event_id % 6 WHEN 2 THEN user_id END AS anchor_a FROM events")
def model_replies(spark, d):
    """Answers of models in several shapes: objects, fences, thoughts, tool calls, repaired quotes and commas, none."""
    i, e = F.col("event_id") % 6, F.col("event_type")
    wrap = lambda message: F.concat(F.lit('{"choices": [{"message": '), message, F.lit("}]}"))
    quoted = lambda body: F.to_json(F.struct(body.alias("content")))
    text = F.when(i == 0, wrap(F.concat(F.lit('{"content": {"changes": [{"change_type": "eliminado", "source_a": "'), e, F.lit('", "confidence": "HIGH"}]}}'))))
    text = text.when(i == 1, wrap(quoted(F.lit('<think>{"changes": 1}</think> ```json\n{"diffs": [{"type": "new"},]}\n```'))))
    text = text.when(i == 2, wrap(quoted(F.concat(F.lit('antes {"rows": [{"kind": "changed", "before": "'), e, F.lit('", "index_a": "'), F.col("user_id"), F.lit('"}, {"kind": "??"}]} despues')))))
    text = text.when(i == 3, wrap(F.concat(F.lit('{"tool_calls": [{"function": {"arguments": "{\\"items\\": [{\\"action\\": \\"added\\", \\"a\\": \\"'), e, F.lit('\\"}]}"}}]}'))))
    text = text.when(i == 4, wrap(quoted(F.concat(F.lit("{“results”: [{“change”: “modified”, “text_a”: “"), e, F.lit("”}]}"))))).otherwise("no JSON")

    @F.pandas_udf("array<struct<change_type: string, source_a: string, confidence: string, anchor_a: int>>")
    def read(answers: pd.Series) -> pd.Series:
        return answers.map(lambda x: None if (found := decide.response_changes(x)) is None else [{k: c[k] for k in ("change_type", "source_a", "confidence", "anchor_a")} for c in found])

    return _t(spark, d, "events").select("event_id", F.get(read(text), 0).alias("c")).select("event_id", "c.change_type", "c.source_a", "c.confidence", "c.anchor_a")


@query("""WITH r AS (SELECT user_id AS job_id, event_id AS block_id, event_type AS t FROM events WHERE event_id % 2 = 0), k AS (SELECT job_id, min(block_id) AS block_id, t FROM r GROUP BY job_id, t),
c AS (SELECT DISTINCT user_id AS job_id, event_type AS t, min(event_id) OVER (PARTITION BY user_id, event_type) AS ord FROM events WHERE event_id % 2 = 1),
f AS (SELECT c.job_id, c.t, c.ord, row_number() OVER (PARTITION BY c.job_id ORDER BY c.ord) + coalesce((SELECT max(block_id) FROM k WHERE k.job_id = c.job_id), 0) AS block_id FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.job_id = c.job_id AND k.t = c.t))
SELECT job_id, block_id, concat('p', block_id) AS pair_id, t AS text_a FROM k UNION ALL SELECT job_id, block_id, concat('reconcile-', block_id), t FROM f""")
def reconciled_rows(spark, d):
    """Changes that no row of a job states yet go behind its rows."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id"), F.col("event_type").alias("t"))
    level = {c: F.lit("media") for c in ("confidence", "severity")}
    rows = e.where("event_id % 2 = 0").select("job_id", F.col("event_id").alias("block_id"), F.concat(F.lit("p"), "event_id").alias("pair_id"), F.lit("modificado").alias("change_type"), *[F.col("t").alias(c) for c in ("text_a", "display_text_a")], *[F.lit("x").alias(c) for c in ("text_b", "display_text_b", "llm_comment", "summary")]).withColumns(level)
    changes = e.where("event_id % 2 = 1").select("job_id", F.col("event_id").alias("ord"), F.lit("modificado").alias("change_type"), F.col("t").alias("source_a"), F.lit("x").alias("source_b"), F.lit("y").alias("summary"), F.lit("z").alias("evidence")).withColumns(level)
    return postprocess.reconciled(rows, changes).select("job_id", "block_id", "pair_id", "text_a")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('café ', event_type, '·', event_id) ELSE concat('Ebene üß', event_id) END AS text FROM events")
def decoded_files(spark, d):
    """Texts as files of two encodings, read back."""
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("café "), "event_type", F.lit("·"), i)).otherwise(F.concat(F.lit("Ebene üß"), i))
    found = _t(spark, d, "events").select("event_id", F.when(i % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1")).alias("content"))
    return files.read_text(found).select("event_id", "text")


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS path, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY k) - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS seq, CASE event_id % 3 WHEN 0 THEN 'table_row' WHEN 1 THEN 'list_item' ELSE 'paragraph' END AS block_type,
CASE event_id % 3 WHEN 0 THEN concat(event_id, ' | ', event_type) WHEN 1 THEN concat('- é', event_type) ELSE concat('{', event_id, '} ', event_type) END AS text FROM e""")
def rtf_blocks(spark, d):
    """Users' events as RTF files: list items, paragraphs and table rows."""
    i, e = F.col("event_id"), F.col("event_type")
    part = F.when(i % 3 == 0, F.concat(F.lit(r"\trowd\cellx9 "), i, F.lit(r"\cell "), e, F.lit(r"\cell\row\pard "))).when(i % 3 == 1, F.concat(F.lit(r"{\b - \'e9"), e, F.lit(r"}\par "))).otherwise(F.concat(F.lit(r"\{"), i, F.lit(r"\} "), e, F.lit(r"\par ")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", part.alias("p")))), lambda x: x["p"]), "")
    found = _t(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.encode(F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 X;}}"), body, F.lit("}")), "UTF-8").alias("content"))
    return files.read_office(found.withColumn("extension", F.lit(".rtf"))).where("not drop_in_canonical").select("path", "seq", "block_type", "text")


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS path, CAST(k // 40 + 1 AS INTEGER) AS page, CAST((k % 40) // 4 AS INTEGER) AS block, CAST(k % 4 AS INTEGER) AS line, concat(event_type, ' (', event_id, ')') AS text, CAST(50 + user_id % 7 AS DOUBLE) AS x0, CAST(92 + ((k % 40) // 4) * 70 + (k % 4) * 12 AS DOUBLE) AS y0 FROM e""")
def pdf_spans(spark, d):
    """Users' events as PDF files of forty lines a page, four a block."""
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    numbered = _t(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    y = 700 - F.floor(k % 40 / 4) * 70 - k % 4 * 12
    show = F.concat(F.lit("BT /F1 10 Tf 1 0 0 1 "), 50 + u % 7, F.lit(" "), y, F.lit(" Tm ("), "event_type", F.lit(r" \("), i, F.lit(r"\)) Tj ET "))
    page = numbered.groupBy("user_id", F.floor(k / 40).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", show.alias("s")))), lambda x: x["s"]), "").alias("s"))
    # Objects 1 to 3 are the catalog, the list of pages and the font; page n is object 10 + 2 n, its content the next one.
    own = F.concat((10 + 2 * F.col("page")).cast("string"), F.lit(" 0 obj << /Type /Page /Parent 2 0 R /Contents "), (11 + 2 * F.col("page")).cast("string"), F.lit(" 0 R >> endobj "), (11 + 2 * F.col("page")).cast("string"), F.lit(" 0 obj << /Length "), F.length("s"), F.lit(" >> stream\n"), "s", F.lit("\nendstream endobj "))
    body = F.array_sort(F.collect_list(F.struct("page", own.alias("o"))))
    whole = page.groupBy("user_id").agg(body.alias("b"))
    kids = F.array_join(F.transform("b", lambda x: F.concat((10 + 2 * x["page"]).cast("string"), F.lit(" 0 R"))), " ")
    text = F.concat(F.lit("%PDF-1.4 1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Kids ["), kids, F.lit("] >> endobj 3 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj "), F.array_join(F.transform("b", lambda x: x["o"]), ""), F.lit("trailer << /Root 1 0 R >>"))
    found = whole.select(F.col("user_id").cast("string").alias("path"), F.lit(".pdf").alias("extension"), F.encode(text, "UTF-8").alias("content"))
    return files.pdf_spans(found).select("path", "page", "block", "line", "text", F.round("bbox.x0", 3).alias("x0"), F.round("bbox.y0", 3).alias("y0"))


@query("SELECT event_id, CASE WHEN c >= 1200 THEN least(120, greatest(80, CAST(round_even(c / 5, 0) AS INTEGER))) ELSE greatest(24, CAST(round_even(c / 5, 0) AS INTEGER)) END AS least_words FROM (SELECT event_id, CAST(event_id % 1500 + 1 AS DOUBLE) AS c FROM events)")
def word_budgets(spark, d):
    """Words that a window of so many characters has at least."""

    @F.pandas_udf("int")
    def budget(chars: pd.Series) -> pd.Series:
        return chars.map(lambda c: segment.word_budget(c)[0])

    return _t(spark, d, "events").select("event_id", budget((F.col("event_id") % 1500 + 1).cast("int")).alias("least_words"))
