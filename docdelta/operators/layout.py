"""Layout blocks, canonical text and quality signals.

A layout is a table of blocks with doc_id and seq, as in schemas.LAYOUT; order is always explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.functions.text import LIST_PREFIX, adjusted_quality, alpha_ratio, collapse, repetition_key, strip

# Kinds of blocks and the zones of headers and footers.
BREAKS = ("page_break", "section_break")
NOISE = ("header", "footer")
PARAGRAPHS = ("paragraph", "list_item", "table_row", "header", "footer")
REPEATABLE = (*PARAGRAPHS, "line")
TOP, BOTTOM, ZONE_WORDS = 0.1, 0.9, 18
REPEAT_TOP, REPEAT_BOTTOM = 0.12, 0.88
TABLE_GAP = 24.0
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", engine: str = "text") -> DataFrame:
    """Blocks of plain text: a paragraph or list item for each chunk between blank lines, and its lines, which canonical text leaves out."""
    chunks = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n\n"), strip), lambda x: x != "")
    lines = lambda c: F.filter(F.transform(F.split(c, LINE_BREAKS), strip), lambda x: x != "")
    block = lambda t, kind, drop: F.struct(t.alias("text"), kind.alias("block_type"), F.lit(drop).alias("drop_in_canonical"))
    whole = lambda c: F.array(block(c, F.when(c.rlike(LIST_PREFIX), "list_item").otherwise("paragraph"), False))
    blocks = F.flatten(F.transform(chunks, lambda c: F.concat(whole(c), F.transform(lines(c), lambda x: block(x, F.lit("line"), True)))))
    no = F.lit(False)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks).alias("seq", "b")).select(
        "doc_id", "seq", "b.text", F.lit(None).cast("int").alias("page"), "b.block_type", F.lit(engine).alias("source_engine"),
        F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>").alias("bbox"), "b.drop_in_canonical",
        no.alias("is_repeated_header"), no.alias("is_repeated_footer"),
    )


def canonical_blocks(blocks: DataFrame) -> DataFrame:
    """Breaks and blocks that are not blank, without dropped ones unless a document has no others; normal is their text."""
    doc = Window.partitionBy("doc_id")
    out = blocks.withColumn("normal", collapse(F.col("text"))).where((F.col("normal") != "") | F.col("block_type").isin(*BREAKS))
    kept = ~F.coalesce(F.col("drop_in_canonical"), F.lit(False))
    return out.withColumn("__any", F.max(kept).over(doc)).where(kept | ~F.col("__any")).drop("__any")


def canonical_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): blocks joined by line feeds, a blank line behind breaks and between paragraph-like blocks."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = canonical_blocks(blocks).withColumn("__break", F.col("block_type").isin(*BREAKS))
    breaks = F.sum(F.col("__break").cast("int")).over(order)
    rows = rows.withColumn("__breaks", breaks).where(~F.col("__break"))
    apart = (F.col("__breaks") > F.lag("__breaks").over(order)) | (F.lag("block_type").over(order).isin(*PARAGRAPHS) & F.col("block_type").isin(*PARAGRAPHS))
    rows = rows.withColumn("piece", F.concat(F.when(F.row_number().over(order) == 1, "").when(apart, "\n\n").otherwise("\n"), F.col("normal")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("doc_id").agg(strip(text).alias("text"))


def quality_signals(blocks: DataFrame) -> DataFrame:
    """One row for each document with blocks: counts, averages, densities and the noise score of its layout."""
    every = blocks.withColumn("normal", collapse(F.col("text")))
    textual = F.col("normal") != ""
    share = lambda n: F.round(n / F.greatest(F.col("textual"), F.lit(1)), 4)
    kinds = every.groupBy("doc_id").agg(
        F.count("*").alias("block_count"), F.count_if(textual).alias("textual"),
        *[F.count_if(textual & (F.col("block_type") == k)).alias(k) for k in ("table_row", "list_item", "header", "footer")],
        F.max(F.coalesce(F.col("is_repeated_header"), F.lit(False)) | F.coalesce(F.col("is_repeated_footer"), F.lit(False))).alias("has_repeated_headers"),
    )
    n = F.greatest(F.col("canonical_block_count"), F.lit(1))
    canonical = canonical_blocks(blocks).where(textual).groupBy("doc_id").agg(
        F.count("*").alias("canonical_block_count"), F.avg(F.length("normal")).alias("chars"), F.avg(F.size(F.split("normal", " "))).alias("words"),
        F.count_distinct("normal").alias("distinct"), F.count_if(F.length("normal") <= 24).alias("short"),
        F.count_if(F.col("block_type").isin(*NOISE)).alias("noise"), F.count_if(alpha_ratio(F.col("normal")) < 0.55).alias("low_alpha"),
    )
    zero = {x: 0 for x in ("canonical_block_count", "chars", "words", "distinct", "short", "noise", "low_alpha")}
    out = kinds.join(canonical, "doc_id", "left").fillna(zero)
    duplicates, tables = (F.col("canonical_block_count") - F.col("distinct")) / n, F.col("table_row") / F.greatest(F.col("textual"), F.lit(1))
    noise = F.col("short") / n * 0.35 + F.col("noise") / n * 0.25 + tables * 0.15 + duplicates * 0.15 + F.col("low_alpha") / n * 0.10
    return out.select(
        "doc_id", "block_count", "canonical_block_count", F.round("chars", 2).alias("avg_line_length"), F.round("words", 2).alias("avg_words_per_block"),
        share(F.col("table_row")).alias("table_like_density"), share(F.col("list_item")).alias("list_item_density"),
        share(F.col("header") + F.col("footer")).alias("header_footer_density"), F.round(duplicates, 4).alias("duplicate_block_ratio"),
        F.round(F.least(F.lit(1.0), noise), 4).alias("layout_noise_score"), "has_repeated_headers",
    )


def block_type_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_type, n) over blocks that are not blank."""
    return blocks.where(collapse(F.col("text")) != "").groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


def quality_scores(signals: DataFrame, base: Column) -> DataFrame:
    return signals.withColumn("quality_score", adjusted_quality(base, F.col("layout_noise_score"), F.col("table_like_density"), F.col("has_repeated_headers")))


def union_box(box: Column) -> Column:
    """The smallest box around those of a group."""
    return F.struct(*[f(box[k]).alias(k) for k, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines of page spans (doc_id, page, block, line, span, text, bbox): text, box and type of each line."""
    order = Window.partitionBy("doc_id", "page", "block", "line").orderBy("span")
    rows = spans.where(strip(F.col("text")) != "").withColumn("gap", F.col("bbox.x0") - F.lag("bbox.x0").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ")
    lines = rows.groupBy("doc_id", "page", "block", "line").agg(joined.alias("text"), union_box(F.col("bbox")).alias("bbox"), F.count("*").alias("spans"), F.count_if(F.col("gap") >= TABLE_GAP).alias("gaps"))
    count = lambda x: F.length("text") - F.length(F.replace(F.col("text"), F.lit(x), F.lit("")))
    table = (count("|") >= 2) | (count("\t") >= 2) | ((F.col("spans") >= 3) & (F.col("gaps") >= 2))
    return lines.withColumn("block_type", F.when(table, "table_row").when(F.col("text").rlike(LIST_PREFIX), "list_item").otherwise("line")).drop("spans", "gaps")


def page_groups(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Paragraphs of page lines with the type that their lines, place and length give; heights: (doc_id, page, height)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    groups = lines.groupBy("doc_id", "page", "block").agg(
        joined.alias("text"), union_box(F.col("bbox")).alias("bbox"), F.every(F.col("block_type") == "table_row").alias("table"), F.min_by("block_type", "line").alias("first"), F.count("*").alias("lines")
    ).join(heights, ["doc_id", "page"], "left")
    few = F.size(F.split("text", " ")) <= ZONE_WORDS
    kind = F.when(F.col("table"), "table_row").when(F.col("first") == "list_item", "list_item")
    kind = kind.when((F.col("bbox.y0") / F.nullif("height", F.lit(0.0)) <= TOP) & few, "header").when((F.col("bbox.y1") / F.nullif("height", F.lit(0.0)) >= BOTTOM) & few, "footer").otherwise("paragraph")
    return groups.select("doc_id", "page", "block", "text", "bbox", kind.alias("block_type"), "lines")


def mark_repeated(blocks: DataFrame, heights: DataFrame, drop: bool = True) -> DataFrame:
    """blocks with texts that stand near the top or bottom of several pages turned into headers or footers.

    Texts are compared by key (digits as #); a key counts on two pages or more with two hits or more
    in a zone, headers before footers, and then all its blocks change.
    """
    keyed = blocks.withColumn("__key", repetition_key(F.col("text")))
    hits = keyed.where((F.col("__key") != "") & F.col("page").isNotNull() & F.col("block_type").isin(*REPEATABLE)).join(heights, ["doc_id", "page"], "left")
    high = F.nullif("height", F.lit(0.0))
    found = hits.groupBy("doc_id", "__key").agg(
        F.count_distinct("page").alias("pages"), F.count_if(F.col("bbox.y0") / high <= REPEAT_TOP).alias("top"), F.count_if(F.col("bbox.y1") / high >= REPEAT_BOTTOM).alias("bottom")
    ).where("pages >= 2 and (top >= 2 or bottom >= 2)").select("doc_id", "__key", (F.col("top") >= 2).alias("__top"))
    out = keyed.join(found, ["doc_id", "__key"], "left")
    repeated = F.col("__top").isNotNull()
    kind = F.when(F.col("__top"), "header").when(~F.col("__top"), "footer").otherwise(F.col("block_type"))
    out = out.withColumn("block_type", kind)
    if drop:
        out = out.withColumn("drop_in_canonical", F.coalesce(F.col("drop_in_canonical"), F.lit(False)) | repeated)
        out = out.withColumn("is_repeated_header", F.coalesce(F.col("__top"), F.lit(False))).withColumn("is_repeated_footer", F.coalesce(~F.col("__top"), F.lit(False)))
    return out.select(*blocks.columns)
