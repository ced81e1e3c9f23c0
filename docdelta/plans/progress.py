"""A comparison that tells how far its jobs are while it runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.checkpoint import written
from docdelta.operators import decide, metrics
from docdelta.plans import compare
from docdelta.streaming import jobs

# Percent, step and detail of the phases before pairs are compared.
PHASES = {
    "a": (20, "extrayendo", "Extrayendo y normalizando Documento A"),
    "b": (32, "extrayendo", "Documento A procesado. Extrayendo Documento B"),
    "pairs": (42, "segmentando", "Emparejando bloques entre ambos documentos"),
}


class Progress:
    """Updates of job states as a table of (sid, seq, field, value) below path; jobs.fold gives the newest value of each field.

    One small append for each phase tells all jobs of a run; nothing about single jobs passes through the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seq, self.began = spark, path, 0, time.monotonic()

    def tell(self, rows: DataFrame, percent: Column, step: Column, detail: Column, status: Column | None = None, **facts: Column) -> None:
        """An update of the jobs of rows (job_id)."""
        own = {"elapsed_ms": F.lit(int((time.monotonic() - self.began) * 1000)), **facts}
        fields = {"percent": percent.cast("string"), "step": step, "detail": detail, "status": F.lit("running") if status is None else status, "metrics": F.to_json(F.struct(*[v.alias(k) for k, v in own.items()]))}
        pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))).alias("field", "value")
        out = rows.select(F.col("job_id").cast("string").alias("sid"), F.lit(self.seq).cast("long").alias("seq"), pairs)
        out.write.mode("append").parquet(self.path)
        self.seq += 1

    def states(self) -> DataFrame:
        return jobs.fold(self.spark.read.parquet(self.path))


def decided_with_progress(rows: DataFrame, progress: Progress, model: Callable[[], decide.Model] | None = None, **options) -> DataFrame:
    """decide.decided of aligned pairs, written, with the share of pairs compared after each wave of questions, and the end."""
    # The counts told last: answers behind the pair with which a job ends count until that is known, and no count is taken back.
    last = written(rows.groupBy("job_id").agg(F.count("*").alias("total")).withColumns({x: F.lit(0).cast("long") for x in ("done", "failed", "fallback")}), "told")
    lit = F.lit

    def compared(answers: DataFrame) -> None:
        nonlocal last
        counts = answers.groupBy("job_id").agg(F.count("*").alias("n0"), F.count_if(F.col("row_source") == "failed").alias("n1"), F.count_if(F.col("row_source") == "fallback").alias("n2"))
        done = last.join(counts, "job_id", "left")
        last = done = written(done.select("job_id", "total", *[F.greatest(x, F.coalesce(f"n{k}", lit(0))).alias(x) for k, x in enumerate(("done", "failed", "fallback"))]), "told")
        facts = {"phase": lit("comparison"), "completed_pairs": F.col("done"), "total_pairs": F.col("total"), "failed_blocks": F.col("failed"), "fallback_blocks": F.col("fallback")}
        detail = F.concat(lit("Pareja "), "done", lit("/"), "total", lit(" · fallback="), "fallback", lit(" · errores="), "failed")
        progress.tell(done, metrics.progress_percent(F.col("done"), F.col("total")), lit("comparando"), detail, **facts)

    out = written(decide.decided(rows, model, on_wave=compared, **options), "decided")
    compared(out)
    facts = metrics.job_facts(out)
    bad = F.col("status") == "error"
    done = F.when(F.col("status") == "done", "Comparación finalizada").otherwise("Comparación finalizada con advertencias")
    progress.tell(facts, lit(100), F.when(bad, "completado_con_errores").otherwise("completado"), done, F.col("status"), phase=lit("completed"), completed_pairs=F.col("compared_pairs"), total_pairs=F.col("total_pairs"), failed_blocks=F.col("failed_blocks"), fallback_blocks=F.col("fallback_blocks"))
    return out


def compared_with_progress(docs: DataFrame, pairs: DataFrame, path: str, model: Callable[[], decide.Model] | None = None) -> DataFrame:
    """compare.compared, whose jobs' states are told below path as they come: 20, 32 and 42 before pairs are compared, 20 to 95 while they are, 100 at the end.

    Documents of the left sides are prepared first, then those that only right sides have. A job without pairs of segments has no state behind 42.
    """
    progress, lit = Progress(docs.sparkSession, path), F.lit
    phase = lambda name, rows, **facts: progress.tell(rows, *map(lit, PHASES[name]), **facts)
    docs, side = docs.select("doc_id", "text"), lambda x: pairs.select(F.col(f"doc_{x}").alias("doc_id")).distinct()
    blocks = lambda rows, x: rows.select(F.col("doc_id").alias(f"doc_{x}"), F.size("segments").alias(f"doc_{x}_blocks"), F.length("clean_text").alias(f"doc_{x}_chars"))
    phase("a", pairs, phase=lit("extraction"), current_file=lit("A"))
    left = written(compare.prepared(docs.join(side("a"), "doc_id", "left_semi")), "left")
    known = pairs.join(blocks(left, "a"), "doc_a", "left")
    phase("b", known, phase=lit("extraction"), current_file=lit("B"), doc_a_blocks=F.col("doc_a_blocks"), doc_a_chars=F.col("doc_a_chars"))
    right = written(compare.prepared(docs.join(side("b").join(side("a"), "doc_id", "left_anti"), "doc_id", "left_semi")), "right")
    both = left.unionByName(right)
    phase("pairs", known.join(blocks(both, "b"), "doc_b", "left"), phase=lit("pairing"), doc_a_blocks=F.col("doc_a_blocks"), doc_b_blocks=F.col("doc_b_blocks"))
    return decided_with_progress(written(compare.paired(pairs, both), "pairs"), progress, model)
