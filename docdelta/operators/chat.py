"""List operators over conversations, named entries and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.functions.text import CONTEXT_CHARS, clamp_context, strip

HISTORY = 6


def question_answer_pairs(turns: DataFrame, last: int | None = HISTORY, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, pair, query, answer): each assistant turn with the user turn right before it, the last few of a conversation.

    Blank turns and other roles are passed over; a user turn is answered once.
    """
    rows = turns.where(F.col("role").isin("user", "assistant") & (strip(F.coalesce("text", F.lit(""))) != ""))
    by = Window.partitionBy(conv).orderBy(order)
    rows = rows.withColumn("__role", F.lag("role").over(by)).withColumn("query", F.lag("text").over(by))
    rows = rows.where((F.col("role") == "assistant") & (F.col("__role") == "user")).select(conv, order, "query", F.col("text").alias("answer"))
    rows = rows.withColumn("pair", F.row_number().over(Window.partitionBy(conv).orderBy(order)))
    if last is not None:
        rows = rows.withColumn("__back", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))).where(F.col("__back") <= last)
    return rows.select(conv, "pair", "query", "answer")


def context_block(entries: DataFrame, group: str, name: str, text: str, order: str, limit: int = CONTEXT_CHARS) -> DataFrame:
    """(group, context): `### name` and text of the entries that are not blank, apart by blank lines, cut to the limit."""
    rows = entries.where(strip(F.coalesce(F.col(text), F.lit(""))) != "")
    part = F.concat(F.lit("### "), F.col(name), F.lit("\n"), F.col(text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"]), "\n\n")
    return rows.groupBy(group).agg(joined.alias("context")).withColumn("context", clamp_context(F.col("context"), limit))


def merge_by_name(entries: DataFrame, group: str, name: str, order: str, limit: int = 3) -> DataFrame:
    """The last entry of each name, in the order in which names came first, at most `limit` for each group."""
    values = [c for c in entries.columns if c not in (group, name)]
    merged = entries.groupBy(group, name).agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias("__first"))
    merged = merged.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy("__first"))).where(F.col("__rank") <= limit)
    return merged.select(group, name, "v.*", F.col("__rank").alias("place"))


def unseen(messages: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    return messages.join(shown.select(*keys).distinct(), keys, "left_anti")


def flattened_ids(groups: Column) -> Column:
    """The ids of nested lists in order, nulls and zeros left out."""
    return F.filter(F.flatten(F.filter(groups, lambda x: x.isNotNull())), lambda x: x.isNotNull() & (x != 0))


def sorted_fragments(fragments: Column) -> Column:
    """Fragments by page (1 where missing), then by number (99999 where missing)."""
    keyed = F.transform(fragments, lambda x: F.struct(F.coalesce(x["page"], F.lit(1)).alias("p"), F.coalesce(x["fragment"], F.lit(99_999)).alias("f"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def transcript(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, transcript): a line `[turn] role: text` for each turn."""
    line = F.concat(F.lit("["), F.col(order), F.lit("] "), F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return turns.groupBy(conv).agg(F.array_join(lines, "\n").alias("transcript"))


def name_contains(rows: DataFrame, column: str, query: str) -> DataFrame:
    return rows.where(F.contains(F.lower(column), F.lit(query.lower())))


def tab(rows: DataFrame, departments: str, name: str, popularity: str, popular_tab: str = "Más usados", tie: str | None = None) -> DataFrame:
    """The rows of a tab; the popular one shows all, most used first, equal ones in the order of tie."""
    return rows.orderBy(F.desc(popularity), *([tie] if tie else [])) if name == popular_tab else rows.where(F.array_contains(departments, name))


def level_meter(samples: DataFrame, size: int = 4000, order: str = "seq", value: str = "value") -> DataFrame:
    """(chunk, n, decibel, speaking): a count-based tumbling window over samples of 0 to 255."""
    chunk = F.floor(F.col(order) / size).alias("chunk")
    out = samples.groupBy(chunk).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    level = F.greatest(F.lit(-60.0), F.least(F.lit(0.0), F.when(F.col("rms") > 0, 20 * F.log10(F.col("rms") / 255)).otherwise(-60.0)))
    return out.select("chunk", "n", level.alias("decibel")).withColumn("speaking", F.col("decibel") > -40)


def favourites(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (one column, any number of copies)."""
    wanted = ids.select(ids[ids.columns[0]].alias("__favourite")).distinct()
    return rows.join(wanted, rows[id_col] == wanted["__favourite"], "left_semi")


def by_name(rows: DataFrame, name: str, tie: str) -> DataFrame:
    """The rows in order of their names, whatever the case of their letters; equal ones by tie, rows without a name first."""
    return rows.orderBy(F.lower(F.coalesce(F.col(name), F.lit(""))), tie)
