"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docdelta.checkpoint import discard, shared_dir, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "connected", "discard", "mapped", "names_beside", "quoted", "shared_dir", "small_batches", "table", "together", "utf8", "written"]

#: Rows and bytes of an Arrow batch that goes to Python: they bound a worker's memory where texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def names_beside(results: list[str], columns: list[str]) -> list[str]:
    """Names for columns that stand behind results: one that a result bears, in any case of letters, gets `_input` behind it."""
    taken = {x.lower() for x in (*results, *columns)}
    out = []
    for name in columns:
        if name.lower() in {x.lower() for x in results}:
            while name.lower() in taken:
                name += "_input"
            taken.add(name.lower())
        out.append(name)
    return out


def together(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= hold:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def mapped(docs: DataFrame, inputs: list[Column], out: StructType, make: Callable[[], Callable[..., list[pa.Array]]], keep: list[str] | None = None, hold: int = 0) -> DataFrame:
    """The columns of out before those of docs, or those in keep, row by row.

    make is called in each task; what it returns turns a batch's input columns into the result
    columns; with hold, batches are put together until they have so many bytes. The columns of docs keep their types and their names, but one that a result bears gets
    `_input` behind its name.
    """
    small_batches(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    held = docs.select(*map(quoted, kept)).schema
    own = [f"c{k}" for k in range(len(kept))]
    new = [f"r{k}" for k in range(len(out))]
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in together(batches, hold) if hold else batches:
            yield pa.RecordBatch.from_arrays([*each(*batch.columns[:n]), *batch.columns[n:]], [*new, *own])

    rows = docs.select(*[x.alias(f"i{k}") for k, x in enumerate(inputs)], *[quoted(x).alias(y) for x, y in zip(kept, own, strict=True)])
    schema = StructType([*(StructField(x, y.dataType) for x, y in zip(new, out, strict=True)), *(StructField(x, y.dataType) for x, y in zip(own, held, strict=True))])
    return rows.mapInArrow(run, schema).toDF(*out.names, *names_beside(out.names, kept))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def connected(edges: DataFrame) -> DataFrame:
    """The components of edges (a, b): rows (node, component), component the smallest node.

    Every round takes the smallest label in each node's neighbourhood and then the label of that
    label, so a chain of n links takes about log2(n) rounds. A star of any size is summed on the
    map side; nothing is gathered by component. Stops when no label changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        new = (
            labels.join(near, labels["node"] == near["a"])
            .join(hop, labels["label"] == hop["at"])
            .select("node", F.col("label").alias("old"), F.least("label", "near", "jump").alias("label"))
        )
        new = written(new, "labels")
        discard(labels)
        if not new.where("old != label").head(1):
            discard(both)
            return new.select("node", F.col("label").alias("component"))
        labels = new.drop("old")
        labels.written_to = new.written_to
