"""The whole comparison: documents and pairs of them to change rows, job metadata and status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from docdelta.checkpoint import written
from docdelta.functions.similarity import diff_segments
from docdelta.functions.text import collapse, joined_texts, normalize_text, strip
from docdelta.operators import align, decide, metrics, postprocess
from docdelta.operators.segment import OVERLAP_CHARS, TARGET_CHARS, segmented

PREFIX = 60


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (strip(F.coalesce("text", F.lit(""))) != ""))


def _jobs(pairs: DataFrame) -> DataFrame:
    return pairs.where("doc_a is not null").select(F.concat_ws("-", "doc_a", "doc_b").alias("job_id"), "doc_a", "doc_b")


def candidate_pairs(docs: DataFrame) -> DataFrame:
    """(job_id, doc_a, doc_b): each document that has a text with the next one by id. Rows with one id are one document; rows without an id take no part.

    Ranges of ids are paired apart; the first of a range follows the last of the range before it, which
    takes one row for each range.
    """
    ids = _with_text(docs).select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    ids = written(ids, "ids")
    inside = ids.select(F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")).alias("doc_a"), F.col("doc_id").alias("doc_b"))
    edges = ids.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    between = edges.select(F.lag("last").over(Window.orderBy("part")).alias("doc_a"), F.col("first").alias("doc_b"))
    return _jobs(inside.unionByName(between))


def alike_pairs(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(job_id, doc_a, doc_b): documents whose texts begin alike, each with the one before it by id. Blank texts begin like none."""
    same = Window.partitionBy(F.substring("text", 1, prefix)).orderBy("doc_id")
    return _jobs(_with_text(docs).select(F.lag("doc_id").over(same).alias("doc_a"), F.col("doc_id").alias("doc_b")))


def prepared(docs: DataFrame, corrected: bool = False, target_chars: int = TARGET_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, clean_text, segments) of plain texts: canonical text, normal form, windows.

    Chunks of a text are joined by blank lines; white space within a chunk is collapsed first, so the
    normaliser sees paragraphs, not lines.
    """
    chunks = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), collapse), lambda x: x != "")
    clean = docs.select("doc_id", normalize_text(F.array_join(chunks, "\n\n"), corrected).alias("clean_text"))
    return segmented(clean, "clean_text", target_chars, overlap_chars)


def paired(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Aligned pairs of segments of each job, labelled, with the texts and places of both sides."""
    side = lambda x: documents.select(F.col("doc_id").alias(f"doc_{x}"), F.col("segments").alias(f"segments_{x}"), F.length("clean_text").alias(f"chars_{x}"))
    jobs = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b")
    # Few rows with much work each: dealt evenly, however small they are.
    jobs = jobs.repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id")
    rows = align.aligned(jobs)
    for x in ("a", "b"):
        rows = rows.withColumns({
            f"text_{x}": joined_texts(F.transform(F.col(f"blocks_{x}"), lambda s: s["text"])),
            f"block_chars_{x}": F.aggregate(F.col(f"blocks_{x}"), F.lit(0), lambda acc, s: acc + F.length(s["text"])),
            f"start_{x}": F.coalesce(F.array_min(F.transform(F.col(f"blocks_{x}"), lambda s: s["start_char"])), F.lit(0)),
            f"end_{x}": F.coalesce(F.array_max(F.transform(F.col(f"blocks_{x}"), lambda s: s["end_char"])), F.lit(0)),
            f"{x}_index": F.try_element_at(F.col(f"{x}_indices"), F.lit(-1)),
        }).drop(f"blocks_{x}")
    return align.labelled(rows)


#: Columns that tell how many rows de-duplication leaves.
COUNTED = ["job_id", "block_id", "change_type", "summary", "text_a", "text_b", "display_text_a", "display_text_b"]


def change_rows(decided: DataFrame, model_name: str = "local-model", only: list[str] | None = None) -> DataFrame:
    """One row for each change, de-duplicated within its job. only: the columns, COUNTED ones at least, without which nothing else is made."""
    source = F.col("row_source")
    rows = decided.where(F.size("changes") > 0).withColumn("__diff", diff_segments("text_a", "text_b"))
    rows = rows.select("*", F.posexplode("changes").alias("__at", "c"))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("pair_index", "__at"))
    span = lambda x: F.when(F.size(f"{x}_indices") > 0, F.struct(F.col(f"start_{x}").alias("start"), F.col(f"end_{x}").alias("end")))
    first = lambda x: F.coalesce(F.array_min(f"{x}_indices"), F.lit(-1))
    by_model = source.isin("llm", "cache")
    pairing = F.struct("alignment_score", F.col("pair_type").alias("strategy"), "pair_type", F.lit(align.ALGORITHM).alias("algorithm"), "reanchored", "match_reason", F.col("a_indices").alias("matched_indices_a"), F.col("b_indices").alias("matched_indices_b"))
    out = rows.select(
        "job_id", number.alias("block_id"), F.concat_ws("-", "job_id", "pair_index").alias("pair_id"),
        F.col("c.source_a").alias("text_a"), F.col("c.source_b").alias("text_b"), F.col("text_a").alias("display_text_a"), F.col("text_b").alias("display_text_b"),
        F.col("__diff.a").alias("display_segments_a"), F.col("__diff.b").alias("display_segments_b"),
        "c.change_type", "c.confidence", "c.severity", "c.summary", F.col("c.evidence").alias("llm_comment"),
        source.alias("result_origin"), by_model.alias("llm_success"), (source == "cache").alias("cache_hit"), (source == "fallback").alias("fallback_applied"), source.alias("decision_source"),
        F.when(by_model, model_name).otherwise("local").alias("model_name"), first("a").alias("chunk_index_a"), first("b").alias("chunk_index_b"),
        F.col("start_a").alias("offset_start_a"), F.col("end_a").alias("offset_end_a"), F.col("start_b").alias("offset_start_b"), F.col("end_b").alias("offset_end_b"),
        F.array().cast("array<int>").alias("related_block_ids"), pairing.alias("pairing"), F.struct(span("a").alias("a"), span("b").alias("b")).alias("source_spans"),
    )
    return postprocess.deduplicated(out if only is None else out.select(*only))


def involved(docs: DataFrame, pairs: DataFrame, corrected: bool = False) -> DataFrame:
    """The prepared documents of the pairs; both sides of a job read them, so they are worth writing."""
    ids = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    own = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    # A file gives few tasks, and most of its rows to one of them.
    own = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return prepared(own, corrected)


def compared(docs: DataFrame, pairs: DataFrame, model: Callable[[], decide.Model] | None = None, corrected: bool = False) -> DataFrame:
    """The decided pairs of segments of all jobs."""
    rows = written(paired(pairs, written(involved(docs, pairs, corrected), "documents")), "pairs")  # alignments are dear, and several branches read them
    return written(decide.decided(rows, model), "decided")


def job_meta(decided: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each job: counts, coverage and status. Jobs without pairs of segments count 0 and are done."""
    facts = metrics.job_facts(decided)
    done = facts.select(
        "job_id", F.col("total_pairs").alias("pairs"), "matched", "reanchored", "orphan_a", "orphan_b", "cache_hits", F.col("fallback_blocks").alias("fallbacks"), "failed_blocks",
        *[metrics.coverage(F.col(f"aligned_{x}"), F.col(f"chars_{x}")).alias(f"coverage_{x}") for x in ("a", "b")], "status",
    )
    out = pairs.select("job_id").join(done, "job_id", "left").join(rows.groupBy("job_id").agg(F.count("*").alias("rows")), "job_id", "left")
    return out.fillna(0).fillna("done", "status")


def job_payloads(decided: DataFrame, rows: DataFrame, pairs: DataFrame, documents: DataFrame, target_chars: int = TARGET_CHARS, overlap_chars: int = OVERLAP_CHARS, model_name: str = "local-model", ratio: float = metrics.ERROR_RATIO) -> DataFrame:
    """The result of each job without its rows: job_id, status, ok, error, progress and meta (audit, cache, segmentation, pairing, diagnostics, error_summary, documents).

    documents is what prepared() gave. A job without pairs has counts of 0 and is done.
    """
    side = lambda x: documents.select(F.col("doc_id").alias(f"doc_{x}"), F.length("clean_text").cast("long").alias(f"doc_{x}_chars"), F.size("segments").cast("long").alias(f"doc_{x}_blocks"))
    jobs = pairs.join(side("a"), "doc_a", "left").join(side("b"), "doc_b", "left").join(metrics.job_facts(decided).drop("chars_a", "chars_b"), "job_id", "left")
    jobs = jobs.join(rows.groupBy("job_id").agg(F.count("*").alias("final_rows")), "job_id", "left").fillna(0).fillna("done", "status").fillna(False, "threshold_reached")
    c, zero = F.col, F.lit(0).cast("long")
    share = F.when(c("total_pairs") > 0, c("failed_blocks") / c("total_pairs")).otherwise(0.0)
    partial = (c("failed_blocks") > 0) | (c("fallback_blocks") > 0) | c("threshold_reached")
    errors = F.coalesce(c("errors"), F.array().cast(ArrayType(decide.ERROR)))
    warnings = F.array_compact(F.array(
        F.when(c("failed_blocks") > 0, F.format_string("%d de %d bloques fallidos", "failed_blocks", "total_pairs")),
        F.when(c("fallback_blocks") > 0, F.format_string("%d bloques resueltos con fallback local", "fallback_blocks")),
    ))
    detail = F.when(F.size(warnings) > 0, F.array_join(warnings, "; ")).otherwise("se detectaron advertencias")
    of = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    lit = F.lit
    progress = of(
        percent=lit(100), step=F.when(c("status") == "error", "completado_con_errores").otherwise("completado"),
        detail=F.when(partial, "Comparación finalizada con resultado parcial").otherwise("Comparación finalizada"),
        completed_pairs=c("compared_pairs"), total_pairs=c("total_pairs"), failed_blocks=c("failed_blocks"), fallback_blocks=c("fallback_blocks"),
    )
    pairing = of(strategy=lit(align.ALGORITHM), pair_count=c("total_pairs"), matched_pairs=c("matched"), orphan_a=c("orphan_a"), orphan_b=c("orphan_b"), reanchored_pairs=c("reanchored"))
    coverage = {f"alignment_coverage_ratio_{x}": metrics.coverage(c(f"aligned_{x}"), c(f"doc_{x}_chars")) for x in ("a", "b")}
    diagnostics = of(
        failed_blocks=c("failed_blocks"), fallback_blocks=c("fallback_blocks"), compared_pairs=c("compared_pairs"), total_pairs=c("total_pairs"), failed_ratio=share, partial_result=partial,
        threshold=c("threshold"), threshold_reached=c("threshold_reached"), **coverage, orphan_pairs=c("orphan_a") + c("orphan_b"), deduplicated_rows=F.greatest(zero, c("rows_before") - c("final_rows")), errors=errors,
    )
    summary = of(failed_blocks=c("failed_blocks"), fallback_blocks=c("fallback_blocks"), total_pairs=c("total_pairs"), failed_ratio=share, threshold=c("threshold"), threshold_reached=c("threshold_reached"), valid_rows_before_reconciliation=c("rows_before"), errors=errors)
    cache = of(policy=lit("incremental_result_file"), resolved_from_cache=c("cache_hits"), resolved_by_llm=c("llm_rows"), resolved_by_fallback=c("fallback_rows"), resolved_by_heuristic=c("heuristic_rows"), failed_blocks=c("failed_blocks"), fallback_blocks=c("fallback_blocks"), model_name=lit(model_name))
    segmentation = of(target_chars=lit(target_chars), overlap_chars=lit(overlap_chars), doc_a_blocks=c("doc_a_blocks"), doc_b_blocks=c("doc_b_blocks"))
    documents_ = of(a=of(doc_id=c("doc_a"), clean_chars=c("doc_a_chars"), segment_count=c("doc_a_blocks")), b=of(doc_id=c("doc_b"), clean_chars=c("doc_b_chars"), segment_count=c("doc_b_blocks")))
    audit = of(all_rows_count=c("final_rows"), filtered_rows_count=c("final_rows"), unchanged_rows_count=zero)
    meta = of(audit=audit, cache=cache, segmentation=segmentation, pairing=pairing, diagnostics=diagnostics, partial_result=partial, error_summary=summary, documents=documents_)
    return jobs.select("job_id", "status", (c("status") != "error").alias("ok"), F.when(c("status") != "done", F.concat(lit("Resultado parcial: "), detail)).alias("error"), progress.alias("progress"), meta.alias("meta"))


def served(results: DataFrame, states: DataFrame) -> DataFrame:
    """What a reader of a job gets: its result, or where there is none but its state is an error, that error with no rows.

    results (sid, status, ok, error, rows), states (sid, status, error). Jobs with neither are absent. Each sid is in either table at most once.
    """
    kind = results.schema["rows"].dataType
    lost = states.where(F.lower("status") == "error").join(results, "sid", "left_anti")
    lost = lost.select("sid", F.lit("error").alias("status"), F.lit(False).alias("ok"), "error", F.array().cast(kind).alias("rows"))
    return results.select("sid", "status", "ok", "error", "rows").unionByName(lost)


def has_useful_data(results: DataFrame) -> DataFrame:
    """The results that have rows, meta or an error."""
    rows = F.size(F.coalesce("rows", F.array().cast(results.schema["rows"].dataType))) > 0
    filled = lambda x: F.coalesce(F.trim(F.col(x).cast("string")), F.lit("")) != ""
    return results.where(rows | filled("meta") | filled("error"))
