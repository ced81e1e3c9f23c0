"""Views of result rows: defaults, filters, search, sort, pages and the states that a reader sees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docdelta.checkpoint import written
from docdelta.functions.text import merged_segments, strip

# Ranks, states and the fields that the search reads.
SEVERITY_RANK = {"critica": 4, "alta": 3, "media": 2, "baja": 1}
CONFIDENCE_RANK = {"alta": 3, "media": 2, "baja": 1}
SUCCESS = ("done", "done_with_warnings", "completed", "success")
FAILURE = ("error", "failed", "failure", "cancelled", "canceled")
SEARCHED = (
    "pair_id", "change_type", "confidence", "severity", "summary", "llm_comment", "text_a", "text_b", "display_text_a", "display_text_b",
    "display_segments_a", "display_segments_b", "result_origin", "decision_source", "model_name", "chunk_index_a", "chunk_index_b",
)
FIRST_ROWS, MORE_ROWS = 40, 30
#: Vectors that a block of the search has, about.
BLOCK = 2000


def _rank(values: dict[str, int], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(strip(F.coalesce(c, F.lit(""))))), F.lit(0))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Blank fields filled from others or with the value that a reader is shown."""
    rules = {
        "llm_comment": (F.col("summary"),),
        "display_text_a": (F.col("text_a"),),
        "display_text_b": (F.col("text_b"),),
        "change_type": (F.lit("pendiente_confirmacion"),),
        "confidence": (F.lit("media"),),
        "severity": (F.lit("baja"),),
    }
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), *others) for c, others in rules.items() if c in rows.columns}
    return rows.withColumns(filled)


# The fields of a row as readers get it. Texts are blank where nothing else is said; a name stands for that field's value.
TEXTS = (
    "pair_id pair_hash text_a text_b display_text_a display_text_b context_before_a context_after_a context_before_b context_after_b change_type materiality confidence final_decision severity summary impact llm_comment "
    "justification review_status decision_source result_origin result_validation_status started_at completed_at cache_pair_hash model_name prompt_version prompt_text_a_literal prompt_text_b_literal relation_type relation_notes alignment_strategy"
).split()
NUMBERS = "block_id chunk_index_a chunk_index_b offset_start_a offset_end_a offset_start_b offset_end_b block_word_count_a block_word_count_b block_size_words block_overlap_words alignment_score".split()
FLAGS = "fallback_applied cache_hit llm_success reanchored".split()
OTHERS = {
    "pair_hash": "cache_pair_hash", "cache_pair_hash": "pair_hash", "display_text_a": "text_a", "display_text_b": "text_b", "llm_comment": "summary", "prompt_text_a_literal": "text_a", "prompt_text_b_literal": "text_b",
}
DEFAULTS = {"change_type": "pendiente_confirmacion", "materiality": "pendiente_confirmacion", "final_decision": "pendiente_confirmacion", "confidence": "baja", "severity": "baja"}


def normalized_rows(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep and all fields of a row as readers get it, whichever of them rows has.

    Absent and blank fields are filled from others, then with their default; numbers that aren't some are 0; segments are
    coalesced; lists and structs that are absent are empty. A field of rows counts by its name in any case of letters.
    """
    there = {c.lower(): c for c in rows.columns}
    raw = lambda c, kind: F.col(f"`{there[c]}`").cast(kind) if c in there else F.lit(None).cast(kind)
    text = lambda c: F.nullif(raw(c, "string"), F.lit(""))
    flag = lambda c: F.coalesce(raw(c, "boolean"), F.lit(False))
    special = {
        "result_origin": F.coalesce(text("result_origin"), F.when(flag("cache_hit"), "cache").otherwise("fallback")),
        "result_validation_status": F.coalesce(text("result_validation_status"), F.when(flag("llm_success"), "validated").otherwise("fallback_applied")),
    }
    out = {c: special.get(c, F.coalesce(text(c), *([text(OTHERS[c])] if c in OTHERS else []), F.lit(DEFAULTS.get(c, "")))) for c in TEXTS}
    out |= {c: F.coalesce(F.try_to_number(raw(c, "string"), F.lit("S" + "9" * 18)).cast("long") if c not in there or rows.schema[there[c]].dataType.typeName() == "string" else raw(c, "double" if c == "alignment_score" else "long"), F.lit(0)) for c in NUMBERS}
    out["alignment_score"] = F.coalesce(F.expr(f"try_cast(`{there['alignment_score']}` AS double)") if "alignment_score" in there else F.lit(None).cast("double"), F.lit(0.0))
    out |= {c: flag(c) for c in FLAGS}
    out["fallback_applied"] = F.coalesce(raw("fallback_applied", "boolean"), ~flag("llm_success"))
    out["cache_stored_at"] = raw("cache_stored_at", "double")
    segment = "array<struct<type: string, text: string>>"
    for c in ("display_segments_a", "display_segments_b"):
        own = F.coalesce(F.col(f"`{there[c]}`") if c in there else F.lit(None).cast(segment), F.array().cast(segment))
        out[c] = merged_segments(F.transform(own, lambda x: F.struct(F.lower(strip(F.coalesce(x["type"], F.lit("equal")))).alias("type"), x["text"].alias("text"))))
    out["related_block_ids"] = F.filter(F.coalesce(raw("related_block_ids", "array<long>"), F.array().cast("array<long>")), lambda x: x > 0)
    for c in ("prompt_messages", "related_blocks"):
        out[c] = F.coalesce(F.col(f"`{there[c]}`"), F.array().cast(rows.schema[there[c]].dataType)) if c in there else F.array().cast("array<string>")
    for c in ("source_spans", "pairing"):
        out[c] = F.col(f"`{there[c]}`") if c in there else F.create_map().cast("map<string, string>")
    return rows.select(*[F.col(f"`{c}`") for c in keep or ()], *[v.alias(k) for k, v in out.items()])


def _wanted(c: Column, value: str | None) -> Column | None:
    """None where every row passes. insertado names the same rows as añadido; an empty field only passes without a filter."""
    value = (value or "").strip().lower() or "all"
    value = "añadido" if value == "insertado" else value
    if value == "all":
        return None
    own = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(own == "insertado", "añadido").otherwise(own) == value


def search_text(columns: list[str], segments: tuple[str, ...] = ("display_segments_a", "display_segments_b")) -> Column:
    """The lower-cased searched fields of a row, segments flattened."""
    part = lambda c: F.array_join(F.transform(F.col(c), lambda x: x["text"]), " ") if c in segments else F.col(c).cast("string")
    return F.lower(F.concat_ws(" ", *[part(c) for c in SEARCHED if c in columns]))


def filtered(rows: DataFrame, severity: str | None = None, change_type: str | None = None, query: str | None = None) -> DataFrame:
    for test in (_wanted(F.col("severity"), severity), _wanted(F.col("change_type"), change_type)):
        rows = rows if test is None else rows.where(test)
    text = (query or "").strip().lower()
    return rows.where(F.contains(search_text(rows.columns), F.lit(text))) if text else rows


#: Substrings of a searched text that are looked up, the rarest ones; the others are left to the comparison that follows.
LOOKED_UP = 4


def _substrings(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: Rows and characters that a block of the search index has, about.
BLOCK_ROWS, BLOCK_CHARS = 5000, 2_000_000


def _in_blocks(rows: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """(block, *keys, __text): rows dealt to blocks by their keys; in a block a row's place is that in the order of the keys."""
    dealt = rows.select(F.pmod(F.xxhash64(*keys), F.lit(blocks).cast("long")).alias("block"), *keys, search_text(rows.columns).alias("__text"))
    return _spread(dealt)


def _spread(rows: DataFrame) -> DataFrame:
    # Blocks take much work for their bytes: they are dealt to all tasks, however small they are.
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def _ordered(block: pa.Table, keys: list[str]) -> pa.Table:
    return block.sort_by([(x, "ascending") for x in keys])


def _postings(texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """The substrings of one to three characters with the places of the texts that have them, ascending."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    lengths = np.array([len(x) for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    for n in (1, 2, 3):
        at = np.flatnonzero(left >= n)
        code = sum(points[at + k] << 21 * k for k in range(n)) if len(at) else at
        codes, own = np.unique(code, return_inverse=True)
        pair = np.unique(own * len(texts) + row[at])
        cut = np.searchsorted(pair, np.arange(len(codes) + 1) * len(texts))
        place = (pair % len(texts)).astype(np.int32)
        for c, i, j in zip(codes.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield "".join(chr((c >> 21 * k & 0x1FFFFF) - 1) for k in range(n)), place[i:j]


def search_index(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(gram, block, blocks, n, packed, places): each block's substrings of one to three characters of its rows' searched fields with the n places of the rows that have it; written.

    keys tell rows apart. Blocks have about as many rows and characters each, however many rows there are, and are made
    apart. Places of many rows are a bit for each row of the block (packed), those of few numbers of 32 bits.
    """
    size = rows.select(F.length(search_text(rows.columns)).alias("n")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars")).head()
    blocks = max(1, -(-size.rows // BLOCK_ROWS), -(-size.chars // BLOCK_CHARS))

    def posted(block: pa.Table) -> pa.Table:
        out = []
        for gram, places in _postings(_ordered(block, keys).column("__text").to_pylist()):
            packed = len(places) * 32 > block.num_rows
            if packed:
                bits = np.zeros(block.num_rows, bool)
                bits[places] = True
            out.append((gram, len(places), packed, (np.packbits(bits) if packed else places).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        grams, n, packed, places = (pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.bool_(), pa.binary()), strict=True))
        one = lambda x: pa.array([x] * len(out), pa.int64())
        number = block.column("block")[0].as_py()
        return pa.Table.from_arrays([grams, one(number), one(blocks), n, packed, places], names=["gram", "block", "blocks", "n", "packed", "places"])

    index = _in_blocks(rows, keys, blocks).groupBy("block").applyInArrow(posted, "gram string, block long, blocks long, n int, packed boolean, places binary")
    return written(index, "postings")


def searched(rows: DataFrame, index: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(query, *keys): for each text of queries (query) the rows whose searched fields hold it, as filtered() finds them one by one.

    A query's rarest substrings are looked up in the index of the same rows, in the blocks that have the rarest of them;
    a longer query is then compared with the rows that have them. Queries are stripped and lower-cased; blank ones find nothing.
    """
    asked = queries.select(F.lower(strip(F.coalesce("query", F.lit("")))).alias("query")).where("query != ''").distinct()
    size = F.least(F.length("query"), F.lit(3))
    own = F.when(size == 3, _substrings(F.col("query"), 3)).otherwise(F.array("query"))
    grams = written(asked.select("query", F.explode(F.array_distinct(own)).alias("gram")), "asked")
    counts = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]), 1, LOOKED_UP)
    chosen = grams.join(counts, "gram", "left").groupBy("query").agg(rarest.alias("grams"), F.count_if(F.col("n").isNull()).alias("absent"))
    chosen = written(chosen.where("absent = 0").drop("absent"), "chosen")
    asks = chosen.select("query", "grams", F.col("grams")[0].alias("gram")).join(index.select("gram", "block"), "gram").select("block", "query", "grams")
    posts = index.join(chosen.select(F.explode("grams").alias("gram")).distinct(), "gram", "left_semi").select("block", "gram", "packed", "places")
    left = _spread(asks.unionByName(posts, allowMissingColumns=True))
    blocks = index.agg(F.max("blocks")).head()[0] or 1

    def found(asks: pa.Table, block: pa.Table) -> pa.Table:
        block = _ordered(block, keys)
        texts, held, queries, places = block.column("__text").to_pylist(), {}, [], []
        for gram, packed, own in zip(*(asks.column(x).to_pylist() for x in ("gram", "packed", "places")), strict=True):
            if gram is not None:
                held[gram] = np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8), count=len(texts))) if packed else np.frombuffer(own, np.int32)
        for query, grams in zip(asks.column("query").to_pylist(), asks.column("grams").to_pylist(), strict=True):
            if query is None or not all(x in held for x in grams):
                continue
            at = held[grams[0]]
            for x in grams[1:]:
                at = np.intersect1d(at, held[x], assume_unique=True)
            if len(query) > 3:
                at = np.array([k for k in at.tolist() if query in texts[k]], np.int64)
            if len(at):
                queries.append(pa.array([query], pa.string()).take(pa.array(np.zeros(len(at), np.int64))))
                places.append(at)
        at = pa.array(np.concatenate(places) if places else np.empty(0, np.int64), pa.int64())
        return pa.Table.from_arrays([pa.chunked_array(queries, pa.string()), *(block.column(x).take(at) for x in keys)], names=["query", *keys])

    held = _in_blocks(rows, keys, blocks)
    kinds = T.StructType([T.StructField("query", T.StringType()), *(rows.schema[x] for x in keys)])
    return left.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(found, kinds)


def sort_keys(by: str = "block_id") -> list[Column]:
    keys = {"severity_desc": [_rank(SEVERITY_RANK, F.col("severity")).desc()], "confidence_desc": [_rank(CONFIDENCE_RANK, F.col("confidence")).desc()], "change_type": [F.col("change_type").asc()]}
    return [*keys.get(by, []), F.col("block_id").asc()]


def ordered(rows: DataFrame, by: str = "block_id") -> DataFrame:
    return rows.orderBy(*sort_keys(by))


def page(rows: DataFrame, offset: int = 0, limit: int | None = None, by: str = "block_id") -> DataFrame:
    """The rows of a page in order. Sorting and limit run as one top-k, not as a full sort."""
    out = ordered(rows, by).offset(max(0, offset))
    return out if limit is None else out.limit(max(0, limit))


def pagination(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One row: total, returned, has_more, next_offset, truncated. truncated also holds for a last page."""
    left = F.greatest(F.col("total") - offset, F.lit(0))
    returned = left if limit is None else F.least(left, F.lit(limit).cast("long"))
    out = rows.agg(F.count("*").alias("total")).withColumn("returned", returned)
    more = F.col("returned") + offset < F.col("total")
    return out.select("total", "returned", more.alias("has_more"), F.when(more, F.col("returned") + offset).alias("next_offset"), (F.lit(limit is not None) & (F.col("returned") < F.col("total"))).alias("truncated"))


def is_success(status: Column) -> Column:
    return F.lower(strip(F.coalesce(status, F.lit("")))).isin(*SUCCESS)


def is_failure(status: Column) -> Column:
    return F.lower(strip(F.coalesce(status, F.lit("")))).isin(*FAILURE)


def view_state(error: Column, loading: Column, started: Column, total: Column, shown: Column) -> Column:
    return F.when(error, "error").when(loading, "loading").when(~started, "idle").when(total == 0, "empty").when(shown == 0, "filtered_empty").otherwise("ready")


def row_status(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("change_type") == "añadido", "insert").when(F.col("change_type") == "eliminado", "delete").when(F.col("change_type") == "modificado", "replace").otherwise("pending")
    return rows.withColumn("row_status", kind)


def valid_files(files: DataFrame, extensions: tuple[str, ...], most_bytes: int, path: str = "path", size: str = "length") -> DataFrame:
    """files with a reason: unsupported, empty, too_large or null where the file can be read."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return files.withColumn("reason", F.when(~extension.isin(*extensions), "unsupported").when(F.col(size) == 0, "empty").when(F.col(size) > most_bytes, "too_large"))


def top_similar(vectors: DataFrame, query_id: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors with the highest cosine to the one with query_id, itself left out; ties by id."""
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    query = vectors.where(F.col("vec_id") == query_id).limit(1).select("v").scalar()
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)
    cosine = dot(F.col("v"), F.col("q")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    out = vectors.where(F.col("vec_id") != query_id).withColumn("q", query).where("q is not null").select("vec_id", F.round(cosine, 6).alias("cosine"))
    return out.orderBy(F.desc("cosine"), "vec_id").limit(k)


def top_similar_each(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, cosine): top_similar for every row of queries. Null vectors, those with null or non-finite components and those of length 0 take no part; shorter vectors count as if zeros followed.

    Queries and vectors are dealt to blocks; a task has one block of either and hands on k rows for each query.
    """

    def dealt(df: DataFrame) -> tuple[DataFrame, int]:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v")).where("id is not null and v is not null")
        df = df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        n = max(1, -(-df.count() // BLOCK))
        return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))), n

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        width = max((len(x) for table in (left, right) for x in table.column("v").to_pylist()), default=0)

        def unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids, rows = table.column("id").to_numpy(), table.column("v").to_pylist()
            v = np.zeros((len(rows), width))
            for i, x in enumerate(rows):
                v[i, : len(x)] = x
            size = np.sqrt((v * v).sum(1))
            return ids[size > 0], v[size > 0] / size[size > 0, None]

        out = []
        if left.num_rows and right.num_rows:
            (asked, q), (ids, v) = unit(left), unit(right)
            cosines = np.round(q @ v.T, 6)
            for i, own in zip(asked, cosines, strict=True):
                order = np.lexsort((ids, -own))[: k + 1]
                out += [(int(i), int(ids[j]), float(own[j])) for j in order if ids[j] != i][:k]
        return pa.Table.from_pylist([{"query_id": a, "vec_id": b, "cosine": c} for a, b, c in out], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())]))

    (asked, n_asked), (held, n_held) = dealt(queries), dealt(vectors)
    # Both sides' keys are longs: rows of one key in two types go to different tasks.
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select("id", "v", F.col("block").alias("q"), all_of(n_held).alias("h")).groupBy("q", "h")
    right = held.select("id", "v", all_of(n_asked).alias("q"), F.col("block").alias("h")).groupBy("q", "h")
    found = left.cogroup(right).applyInArrow(best, "query_id long, vec_id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def top_rows(rows: DataFrame, per: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
