"""Registered queries for fields of layout, job state, views and chat, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docdelta.functions import text
from docdelta.operators import chat, layout, metrics, view
from docdelta.plans.queries import _t, query
from docdelta.streaming import jobs

# Page spans made of events: three spans a line, four lines a block, five blocks a page, one document a day.
_SPANS = """s AS (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS doc_id, event_id // 60 AS page, (event_id // 12) % 5 AS block, (event_id // 3) % 4 AS line, event_id % 3 AS span,
 CASE WHEN user_id % 11 = 0 THEN ' ' WHEN event_id % 12 = 0 AND user_id % 4 = 0 THEN concat('- ', event_type) ELSE concat(' ', event_type, CASE WHEN user_id % 9 = 0 THEN '|' ELSE '' END) END AS text,
 CAST(100 * (event_id % 3) + user_id % 30 AS DOUBLE) AS x0, CAST(100 * (event_id % 3) + 60 + user_id % 30 AS DOUBLE) AS x1, CAST(((event_id // 12) % 5) * 20 + ((event_id // 3) % 4) * 4 + 1 AS DOUBLE) AS y0, CAST(((event_id // 12) % 5) * 20 + ((event_id // 3) % 4) * 4 + 4 AS DOUBLE) AS y1 FROM events)"""
_LINES = _SPANS + """, g AS (SELECT *, trim(text) AS t, x0 - lag(x0) OVER (PARTITION BY doc_id, page, block, line ORDER BY span) AS gap FROM s WHERE trim(text) <> ''),
l AS (SELECT doc_id, page, block, line, string_agg(t, ' ' ORDER BY span) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS spans, count(*) FILTER (gap >= 24) AS gaps FROM g GROUP BY ALL),
pl AS (SELECT doc_id, page, block, line, text, x0, y0, x1, y1, CASE WHEN length(text) - length(replace(text, '|', '')) >= 2 OR (spans >= 3 AND gaps >= 2) THEN 'table_row' WHEN starts_with(text, '- ') THEN 'list_item' ELSE 'line' END AS block_type FROM l)"""


def _spans(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    part = lambda n, m: (F.floor(i / n) % m).cast("bigint")
    line = F.when(u % 11 == 0, " ").when((i % 12 == 0) & (u % 4 == 0), F.concat(F.lit("- "), "event_type")).otherwise(F.concat(F.lit(" "), "event_type", F.when(u % 9 == 0, "|").otherwise("")))
    x, y = (100 * (i % 3) + u % 30).cast("double"), (part(12, 5) * 20 + part(3, 4) * 4).cast("double")
    box = F.struct(x.alias("x0"), (y + 1).alias("y0"), (x + 60).alias("x1"), (y + 4).alias("y1"))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return _t(spark, d, "events").select(day.alias("doc_id"), F.floor(i / 60).cast("bigint").alias("page"), part(12, 5).alias("block"), part(3, 4).alias("line"), (i % 3).alias("span"), line.alias("text"), box.alias("bbox"))


@query(f"WITH {_LINES} SELECT doc_id, page, block, line, text, x0, y0, x1, y1, block_type FROM pl")
def page_lines(spark, d):
    return layout.page_lines(_spans(spark, d)).select("doc_id", "page", "block", "line", "text", "bbox.*", "block_type")


@query(f"""WITH {_LINES} SELECT doc_id, page, block, string_agg(text, ' ' ORDER BY line) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
 CASE WHEN bool_and(block_type = 'table_row') THEN 'table_row' WHEN arg_min(block_type, line) = 'list_item' THEN 'list_item'
 WHEN min(y0) / 100 <= 0.1 AND len(string_split(string_agg(text, ' ' ORDER BY line), ' ')) <= 18 THEN 'header' WHEN max(y1) / 100 >= 0.9 AND len(string_split(string_agg(text, ' ' ORDER BY line), ' ')) <= 18 THEN 'footer' ELSE 'paragraph' END AS block_type, count(*) AS lines FROM pl GROUP BY ALL""")
def page_groups(spark, d):
    spans = _spans(spark, d)
    heights = spans.select("doc_id", "page").distinct().withColumn("height", F.lit(100.0))
    return layout.page_groups(layout.page_lines(spans), heights).select("doc_id", "page", "block", "text", "bbox.*", "block_type", "lines")


@query("""WITH l AS (SELECT source, doc_id, i, line FROM (SELECT source, doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT ls[i] AS line)),
k AS (SELECT source, doc_id, i, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '\\d+', '#', 'g') AS key, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
r AS (SELECT source, key, count(*) FILTER ((i - 1) / CAST(n AS DOUBLE) <= 0.12) AS top, count(*) FILTER (i / CAST(n AS DOUBLE) >= 0.88) AS bottom FROM k WHERE length(key) >= 3 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2 AND (top >= 2 OR bottom >= 2))
SELECT source, doc_id AS page, CAST(i - 1 AS INTEGER) AS seq, CASE WHEN top >= 2 THEN 'header' ELSE 'footer' END AS block_type, top >= 2 AS is_repeated_header, top < 2 AS is_repeated_footer FROM k JOIN r USING (source, key)""")
def repeated_lines(spark, d):
    """Lines of each source's documents, a page each, that mark_repeated turns into headers or footers."""
    docs = _t(spark, d, "documents").select("source", "doc_id", F.split("text", "\n").alias("ls"))
    n, i = F.size("ls"), F.col("seq")
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), n.alias("n"), F.posexplode("ls").alias("seq", "text"))
    box = F.struct(F.lit(0.0).alias("x0"), (i / F.col("n")).alias("y0"), F.lit(1.0).alias("x1"), ((i + 1) / F.col("n")).alias("y1"))
    no = F.lit(False)
    blocks = rows.select("doc_id", "page", "seq", "text", F.lit("line").alias("block_type"), box.alias("bbox"), no.alias("drop_in_canonical"), no.alias("is_repeated_header"), no.alias("is_repeated_footer"))
    heights = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.lit(1.0).alias("height"))
    marked = layout.mark_repeated(blocks, heights).where("drop_in_canonical")
    return marked.select(F.col("doc_id").alias("source"), "page", "seq", "block_type", "is_repeated_header", "is_repeated_footer")


_STORED = "CASE user_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'None' ELSE CAST(event_id % 2 = 0 AS VARCHAR) END"


@query(f"SELECT event_id, CASE user_id % 4 WHEN 0 THEN concat('\"', event_type, '\"') WHEN 2 THEN '\"None\"' ELSE {_STORED} END AS decoded FROM events")
def job_state_values(spark, d):
    """Stored fields of job states read back: JSON is parsed, other text stays text."""
    u = F.col("user_id") % 4
    stored = F.when(u == 0, F.col("event_type")).when(u == 1, F.col("event_id").cast("string")).when(u == 2, "None").otherwise((F.col("event_id") % 2 == 0).cast("string"))
    return _t(spark, d, "events").select("event_id", F.to_json(jobs.decoded(stored)).alias("decoded"))


_DECIDED = "p AS (SELECT user_id AS job_id, event_id AS pair_index, CASE WHEN event_type = 'view' THEN 'cache' ELSE 'new' END AS row_source, event_type = 'error' AS failed FROM events), r AS (SELECT user_id AS job_id, event_id AS pair_id, CASE event_type WHEN 'click' THEN 'llm' WHEN 'view' THEN 'cache' WHEN 'purchase' THEN 'fallback' ELSE 'heuristic' END AS result_origin FROM events WHERE event_id % 3 > 0)"


def _decided(spark, d):
    e = _t(spark, d, "events")
    kind = F.col("event_type")
    pairs = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pair_index"), F.when(kind == "view", "cache").otherwise("new").alias("row_source"), (kind == "error").alias("failed"))
    origin = F.when(kind == "click", "llm").when(kind == "view", "cache").when(kind == "purchase", "fallback").otherwise("heuristic")
    return pairs, e.where("event_id % 3 > 0").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pair_id"), origin.alias("result_origin"))


@query(f"WITH {_DECIDED}, h AS (SELECT job_id, count(*) FILTER (row_source = 'cache') AS cache_hits FROM p GROUP BY job_id), k AS (SELECT job_id, count(*) FILTER (result_origin IN ('llm', 'cache')) AS llm_rows, count(*) FILTER (result_origin = 'fallback') AS fallback_rows, count(*) FILTER (result_origin = 'heuristic') AS heuristic_rows FROM r GROUP BY job_id) SELECT job_id, cache_hits, coalesce(llm_rows, 0) AS llm_rows, coalesce(fallback_rows, 0) AS fallback_rows, coalesce(heuristic_rows, 0) AS heuristic_rows FROM h LEFT JOIN k USING (job_id)")
def origin_counts(spark, d):
    return metrics.origin_counts(*_decided(spark, d))


@query(f"WITH {_DECIDED}, c AS (SELECT job_id, count(DISTINCT pair_id) AS changed_pairs, count(*) AS rows FROM r GROUP BY job_id) SELECT job_id, count(*) AS all_pairs, coalesce(max(changed_pairs), 0) AS changed_pairs, coalesce(max(rows), 0) AS rows, count(*) - coalesce(max(changed_pairs), 0) AS unchanged_pairs FROM p LEFT JOIN c USING (job_id) GROUP BY job_id")
def audit_counts(spark, d):
    return metrics.audit_counts(*_decided(spark, d))


@query(f"WITH {_DECIDED}, x AS (SELECT job_id, pair_index, failed, floor(count(*) OVER (PARTITION BY job_id) * 0.1) AS most, coalesce(sum(CAST(failed AS INTEGER)) OVER (PARTITION BY job_id ORDER BY pair_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT job_id, pair_index FROM x WHERE before <= most AND NOT failed")
def pairs_until_failed(spark, d):
    return metrics.until_failed(_decided(spark, d)[0], ratio=0.1).select("job_id", "pair_index")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS outcome, CASE WHEN user_id % 7 = 0 THEN 'error' WHEN user_id % 5 = 0 THEN 'loading' WHEN user_id % 3 = 0 THEN 'idle' WHEN event_id % 4 = 0 THEN 'empty' WHEN event_id % 3 = 0 THEN 'filtered_empty' ELSE 'ready' END AS state FROM events")
def view_states(spark, d):
    i, u, e = F.col("event_id"), F.col("user_id"), F.col("event_type")
    status = F.when(e == "click", " Done ").when(e == "view", "SUCCESS").when(e == "error", "Cancelled").otherwise("running")
    outcome = F.when(view.is_success(status), 1).when(view.is_failure(status), -1).otherwise(0)
    state = view.view_state(u % 7 == 0, u % 5 == 0, u % 3 != 0, i % 4, i % 3)
    return _t(spark, d, "events").select("event_id", outcome.alias("outcome"), state.alias("state"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'unsupported' WHEN user_id % 10 = 0 THEN 'empty' WHEN user_id % 10 > 7 THEN 'too_large' END AS reason FROM events")
def file_reasons(spark, d):
    u = F.col("user_id")
    files = _t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "a/b.EXE").otherwise("a.b/c.Txt").alias("path"), (u % 10).alias("length"))
    return view.valid_files(files, (".txt", ".docx"), 7).select("event_id", "reason")


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN CAST(event_id AS INTEGER) END AS number, CASE user_id % 3 WHEN 0 THEN event_type ELSE props END AS first, CASE user_id % 2 WHEN 0 THEN 'gz' ELSE '' END AS extension, user_id % 2 = 0 AS has_upper, event_id % 3 > 0 AS has_digit, user_id % 5 = 0 AS has_symbol FROM events")
def form_fields(spark, d):
    """Optional numbers, first text that isn't blank, file extensions, classes of password characters."""
    i, u, e = F.col("event_id"), F.col("user_id"), F.col("event_type")
    number = F.when(u % 3 == 0, F.concat(F.lit(" "), i.cast("string"), F.lit(" "))).when(u % 3 == 1, " ").otherwise("x1")
    first = text.first_text(F.lit(None).cast("string"), F.when(u % 3 == 0, F.concat(F.lit("\n"), e, F.lit(" "))).otherwise("  "), F.col("props"))
    word = F.concat(e, F.when(u % 2 == 0, "Q").otherwise(""), F.when(i % 3 > 0, "7").otherwise(""), F.when(u % 5 == 0, "!").otherwise(""))
    out = _t(spark, d, "events").select("event_id", text.optional_int(number).alias("number"), first.alias("first"), text.file_extension(F.when(u % 2 == 0, "x.tar.GZ").otherwise("readme")).alias("extension"), text.password_classes(word).alias("p"))
    return out.select("event_id", "number", "first", "extension", F.col("p.upper").alias("has_upper"), F.col("p.digit").alias("has_digit"), F.col("p.symbol").alias("has_symbol"))


@query("SELECT event_id, least(value, value * 2) / 1000 >= 0.5 OR (value < 0 AND value * 2 / 1000 >= 0.5) AS both_reliable, user_id % 3 = 0 OR (user_id % 3 = 1 AND (user_id % 50 <= 22 OR event_id % 100 >= 55)) AS scan_like FROM events")
def reliability(spark, d):
    u = F.col("user_id")
    engine = F.when(u % 3 == 0, "rapidocr").when(u % 3 == 1, "pdf").otherwise("text")
    scan = text.scan_like(engine, (u % 50).cast("double"), (F.col("event_id") % 100) / 100)
    return _t(spark, d, "events").select("event_id", text.reliable(F.col("value") / 1000, F.col("value") * 2 / 1000).alias("both_reliable"), scan.alias("scan_like"))


@query("""WITH x AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS t, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM conversations),
w AS (SELECT conv_id, CASE WHEN coalesce(t, '') = '' THEN 0 ELSE greatest(1, CAST(round_even(length(t) / 4, 0) AS INTEGER), CAST(round_even(CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END * CAST(1.35 AS DOUBLE), 0) AS INTEGER)) END + 12 AS tokens FROM x)
SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM w GROUP BY conv_id""")
def message_tokens(spark, d):
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    return turns.select("conv_id", text.estimate_message_tokens(F.col("texts")).cast("bigint").alias("tokens"))


_KINDS = "CASE event_type WHEN 'click' THEN 'insert' WHEN 'view' THEN 'delete' ELSE 'equal' END"


@query(f"""WITH s AS (SELECT user_id, event_id, {_KINDS} AS kind, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS t FROM events),
g AS (SELECT *, sum(CASE WHEN kind = last THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY event_id), '') AS last FROM s WHERE t <> ''))
SELECT user_id, CAST(run - 1 AS INTEGER) AS seq, any_value(kind) AS type, string_agg(t, '' ORDER BY event_id) AS text FROM g GROUP BY user_id, run""")
def coalesced_segments(spark, d):
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "insert").when(F.col("event_type") == "view", "delete").when(F.col("event_type") == "error", "unknown").otherwise("equal")
    one = F.struct("event_id", kind.alias("type"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_id").cast("string")).alias("text"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    merged = text.merged_segments(F.transform("s", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"))))
    return rows.select("user_id", F.posexplode(merged).alias("seq", "m")).select("user_id", "seq", "m.type", "m.text")


@query("SELECT doc_id, count(*) AS blocks, min(i) AS y0, max(i + 1) AS y1, CAST(max(length(line)) AS DOUBLE) AS x1 FROM (SELECT doc_id, CAST(i - 1 AS DOUBLE) AS i, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)) GROUP BY doc_id")
def united_boxes(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    box = F.struct(F.lit(0.0).alias("x0"), F.col("i").cast("double").alias("y0"), F.length("line").cast("double").alias("x1"), (F.col("i") + 1).cast("double").alias("y1"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), layout.union_box(box).alias("b")).select("doc_id", "blocks", "b.y0", "b.y1", "b.x1")


@query("SELECT user_id, event_type, value FROM events WHERE contains(event_type, 'ur')")
def chats_by_name(spark, d):
    return chat.name_contains(_t(spark, d, "events"), "event_type", "UR").select("user_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events WHERE user_id % 4 = 1 OR event_type = 'click'")
def chats_of_tab(spark, d):
    departments = F.array_compact(F.array(F.when(F.col("user_id") % 4 == 1, "Ventas"), F.when(F.col("event_type") == "click", "Ventas"), F.lit("Otros")))
    rows = _t(spark, d, "events").withColumn("departments", departments)
    return chat.tab(rows, "departments", "Ventas", "value").select("event_id", "user_id")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(p, 1), coalesce(f, 99999), event_id) - 1 AS INTEGER) AS place, event_id FROM (SELECT user_id, event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS p, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS f FROM events)")
def fragment_order(spark, d):
    i = F.col("event_id")
    one = F.struct(F.when(i % 5 > 0, i % 5).alias("page"), F.when(i % 3 > 0, i % 3).alias("fragment"), i.alias("event_id"))
    # Fragments with equal numbers keep the order that their fields give; nulls sort with the value that stands for them.
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.collect_list(one).alias("f"))
    keyed = F.transform("f", lambda x: F.struct(F.coalesce(x["page"], F.lit(1)).cast("int").alias("page"), F.coalesce(x["fragment"], F.lit(99_999)).cast("int").alias("fragment"), x["event_id"].alias("event_id")))
    return rows.select("user_id", F.posexplode(chat.sorted_fragments(keyed)).alias("place", "x")).select("user_id", "place", "x.event_id")


@query("SELECT user_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place FROM events WHERE event_id % 4 > 0 AND event_id > 0")
def flat_ids(spark, d):
    one = F.when(F.col("event_id") % 4 > 0, F.array(F.col("event_id"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("ids")))).alias("g"))
    return rows.select("user_id", F.posexplode(chat.flattened_ids(F.transform("g", lambda x: x["ids"]))).alias("place", "id"))


@query("WITH c AS (SELECT event_id // 400 AS chunk, count(*) AS n, sqrt(avg((user_id % 256) * (user_id % 256))) AS rms FROM events GROUP BY ALL) SELECT chunk, n, round(greatest(-60, least(0, CASE WHEN rms > 0 THEN 20 * log10(rms / 255) ELSE -60 END)), 6) AS decibel, greatest(-60, least(0, CASE WHEN rms > 0 THEN 20 * log10(rms / 255) ELSE -60 END)) > -40 AS speaking FROM c")
def level_meter(spark, d):
    samples = _t(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 256).alias("value"))
    return chat.level_meter(samples, 400).withColumn("decibel", F.round("decibel", 6))


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 50")
def popular_chats(spark, d):
    """The fifty most used entries of the popular tab, numbered as the tab has them."""
    rows = chat.tab(_t(spark, d, "events"), "", "Más usados", "value", tie="event_id").limit(50)
    return rows.coalesce(1).select("event_id", (F.monotonically_increasing_id() + 1).alias("place"))  # one partition: numbers from 1 in the order of the rows


@query("SELECT user_id AS sid, time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS field, count(*) AS n FROM events GROUP BY ALL")
def hourly_activity(spark, d):
    """The windows of the activity stream over the whole table, by job."""
    events = _t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "user_id", "event_type").alias("field"))
    out = jobs.activity_windows(events, "ts")
    return out.select(F.split("field", ":")[0].cast("bigint").alias("sid"), F.col("start").cast("timestamp_ntz").alias("start"), F.split("field", ":")[1].alias("field"), "n")
