"""Job state: an append-only table of field updates, folded in batch or as a stream."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docdelta.checkpoint import shared_dir

# Seconds for which a job's state is kept behind its last update, and that a job may take.
TTL, TIME_LIMIT = 86_400, 480


def encoded(value: Column, is_nested: Column) -> Column:
    """Values as they are stored: nested ones as JSON, others as text; null as None."""
    return F.when(is_nested, F.to_json(value)).otherwise(F.coalesce(value.cast("string"), F.lit("None")))


def decoded(value: Column) -> Column:
    """The stored text as a variant: parsed where it is JSON, else the text itself."""
    return F.coalesce(F.try_parse_json(value), F.variant_get(F.to_variant_object(F.array(value)), "$[0]", "variant"))


def fold(events: DataFrame, sid: str = "sid", field: str = "field", value: str = "value", order: list[str] | None = None) -> DataFrame:
    """(sid, field, value, updates): the latest value of each field of a job."""
    key = F.struct(*(order or ["seq"]))
    return events.groupBy(sid, field).agg(F.max_by(value, key).alias("value"), F.count("*").alias("updates"))


def fold_stream(events: DataFrame, time: str, sid: str = "sid", field: str = "field", value: str = "value", tie: str = "seq") -> DataFrame:
    """The same fold over a stream. The table stays complete, so no state is ever dropped."""
    return events.groupBy(sid, field).agg(F.max_by(value, F.struct(time, tie)).alias("value"), F.count("*").alias("updates"))


def to_table(stream: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    """A writer that reads what there is and keeps the folded table complete; start it with .start().

    Executors write the table as Parquet to the shared folder; the view called name reads the last one.
    """
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, "folded")
    # The view is there from the start, and stays empty where the stream has no rows.
    spark.createDataFrame([], stream.schema).createOrReplaceTempView(name)

    def put(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/{batch}")
        spark.read.schema(stream.schema).parquet(f"{path}/{batch}").createOrReplaceTempView(name)

    return stream.writeStream.outputMode("complete").foreachBatch(put).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def activity_windows(events: DataFrame, time: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, field, n): events of each kind in tumbling windows; later ones than the watermark are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size), "field").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "field", "n")


def append_pairs(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Partial results of running jobs: change rows appended by job as their pairs are done."""
    return rows.writeStream.outputMode("append").format("parquet").partitionBy("sid").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def expiring(events: DataFrame, time: str, sid: str = "sid", field: str = "field", value: str = "value", tie: str = "seq", ttl: int = TTL, late: str = "0 seconds") -> DataFrame:
    """(sid, life, field, value, updated): what is known of each job when it expires, ttl seconds behind its last update.

    A job that is heard of again after that begins a new life without the old fields. Of two updates of a
    field the later one counts, of equal times the one with the larger tie. The state of a job is its fields alone; it goes
    when the watermark, `late` behind the newest event, passes its end. Events without a job, field or time are left out.
    """
    rows = events.select(F.col(sid).cast("string").alias("sid"), F.col(field).alias("field"), F.col(value).cast("string").alias("value"), F.col(time).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("seq"))
    rows = rows.where("sid is not null and field is not null and at is not null").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    columns = ["sid", "life", "field", "value", "updated"]

    def ended(key: str, life: int, fields: dict) -> list[tuple]:
        return [(key, life, name, x, pd.Timestamp(us, unit="us", tz="UTC")) for name, (us, _, x) in fields.items()]

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, life, last = state.get if state.exists else ("{}", 0, -1)
        fields, out = json.loads(text), []
        if state.hasTimedOut:
            out = ended(key[0], life, fields)
            fields, life, last = {}, life + 1, -1
        else:
            for x in sorted((x for batch in batches for x in zip(batch["us"], batch["seq"], batch["field"], batch["value"], strict=True)), key=lambda x: (x[0], x[1])):
                us, seq, name, own = int(x[0]), int(x[1]), x[2], x[3]
                if last >= 0 and us - last >= ttl * 1_000_000:
                    out += ended(key[0], life, fields)
                    fields, life = {}, life + 1
                if name not in fields or [us, seq] >= fields[name][:2]:
                    fields[name] = [us, seq, own]
                last = max(last, us)
            end = last // 1000 + ttl * 1000
            if end <= state.getCurrentWatermarkMs():
                out += ended(key[0], life, fields)
                fields, life, last = {}, life + 1, -1
        if fields:
            state.update((json.dumps(fields), life, last))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    found = rows.groupBy("sid").applyInPandasWithState(step, "sid string, life int, field string, value string, updated timestamp", "fields string, life int, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """What there is of a stream of finished rows, as Parquet."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path with its batch column, None where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def work(queue: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, seconds: float = TIME_LIMIT) -> DataStreamWriter:
    """Takes jobs (sid, ...) from a stream, works on them by run, and keeps results and states below path.

    A micro-batch is what is taken at a time (a file, with maxFilesPerTrigger 1). Each sid is worked on once, however often
    it is in the queue or a batch is repeated: a batch writes under its own number, and jobs that other batches have are left out. A batch that
    fails, or takes more than so many seconds, is stopped, and its jobs get the state error; later batches go on.
    Rows without a sid are left out; of rows with one sid any one counts. The states are (sid, status, error).
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("sid is not null").dropDuplicates(["sid"])
        if (done := _stored(spark, f"{path}/states")) is not None:
            new = new.join(done.where(F.col("batch") != number).select("sid"), "sid", "left_anti")
        jobs = f"{path}/taken/batch={number}"
        new.write.mode("overwrite").parquet(jobs)  # what this batch has taken stays the same while it works
        new, tag, late, error = spark.read.schema(new.schema).parquet(jobs), f"work-{uuid.uuid4().hex}", threading.Event(), None

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            run(new).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        except Exception as e:  # the jobs' outcome, not the queue's end
            error = f"time limit of {seconds:g} s" if late.is_set() else f"{type(e).__name__}: {str(e)[:300]}"
        finally:
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)
        status = F.lit("done" if error is None else "error")
        new.select("sid", status.alias("status"), F.lit(error).cast("string").alias("error")).write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    return queue.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def snapshots(decided: DataFrame, rows_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: int = 1, job: str = "job_id") -> DataStreamWriter:
    """Results of running jobs from a stream of their decided pairs (job, pair_index, total_pairs, ...), kept as versions below path.

    Each batch appends its pairs. Jobs that have passed another `every` pairs by it, or have all, get a new version: rows_of
    (de-duplicated change rows) of all their pairs so far, and their progress. Other jobs' versions are neither read nor written. A repeated batch
    writes the same under its own number. latest() reads the newest version of each job.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")
        pairs = spark.read.parquet(f"{path}/pairs").where(F.col("batch") <= number).dropDuplicates([job, "pair_index"])
        counts = pairs.join(batch.select(job).distinct(), job, "left_semi").groupBy(job).agg(
            F.count("*").alias("completed_pairs"), F.count_if(F.col("batch") < number).alias("__before"), F.max("total_pairs").alias("total_pairs"),
            F.count_if(F.col("row_source") == "failed").alias("failed_blocks"), F.count_if(F.col("row_source") == "fallback").alias("fallback_blocks"),
        )
        passed = F.floor(F.col("completed_pairs") / every) > F.floor(F.col("__before") / every)
        due = counts.where(passed | (F.col("completed_pairs") >= F.col("total_pairs"))).drop("__before")
        due.write.mode("overwrite").parquet(f"{path}/progress/batch={number}")
        due = spark.read.schema(due.schema).parquet(f"{path}/progress/batch={number}")
        rows_of(pairs.drop("batch").join(due.select(job), job, "left_semi")).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return decided.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest(spark: SparkSession, path: str, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """The rows and the progress of each job's newest snapshot."""
    progress = spark.read.parquet(f"{path}/progress")
    newest = progress.groupBy(job).agg(F.max("batch").alias("batch"))
    share = F.when(F.col("total_pairs") > 0, F.col("completed_pairs") / F.col("total_pairs")).otherwise(1.0)
    progress = progress.join(newest, [job, "batch"]).withColumn("percent", F.least(F.lit(99), F.floor(share * 75).cast("int") + 20))
    return spark.read.parquet(f"{path}/rows").join(newest, [job, "batch"], "left_semi").drop("batch"), progress.drop("batch")
