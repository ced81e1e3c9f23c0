"""The engine's operators over the test tables, and DuckDB SQL with the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.checkpoint import shared_dir, stored
from docdelta.functions import similarity, text
from docdelta.operators import align, chat, decide, layout, metrics, postprocess, segment, view
from docdelta.plans import compare
from docdelta.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL that several oracles share.
_PAIRS = "pairs AS (SELECT doc_a, doc_id AS doc_b, concat(doc_a, '-', doc_id) AS job_id FROM (SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS doc_a FROM documents WHERE trim(text, E' \\t\\n\\r') <> '') WHERE doc_a IS NOT NULL)"
_PAIR_TEXTS = f"{_PAIRS}, t AS (SELECT p.job_id, a.text AS ta, b.text AS tb FROM pairs p JOIN documents a ON a.doc_id = p.doc_a JOIN documents b ON b.doc_id = p.doc_b)"
_CHUNKS = "chunk AS (SELECT doc_id, CAST(i AS INTEGER) AS idx, substr(trim(text, E' \\t\\n\\r'), CAST(i * 250 + 1 AS BIGINT), 250) AS piece FROM documents, LATERAL (SELECT unnest(generate_series(0, (length(trim(text, E' \\t\\n\\r')) - 1) // 250)) AS i) WHERE length(trim(text, E' \\t\\n\\r')) > 0)"
_INDEX = f"{_PAIRS}, {_CHUNKS}, ia AS (SELECT job_id, idx, piece FROM pairs JOIN chunk ON doc_id = doc_a), ib AS (SELECT job_id, idx, piece FROM pairs JOIN chunk ON doc_id = doc_b), ip AS (SELECT job_id, idx, ia.piece AS pa, ib.piece AS pb, CASE WHEN ia.piece IS NULL THEN 'orphan_b' WHEN ib.piece IS NULL THEN 'orphan_a' ELSE 'matched' END AS pair_type FROM ia FULL OUTER JOIN ib USING (job_id, idx))"
_SEVERITY = "CASE user_id % 5 WHEN 0 THEN 'critica' WHEN 1 THEN 'alta' WHEN 2 THEN 'media' WHEN 3 THEN 'baja' ELSE '' END"
_KIND = "CASE event_type WHEN 'click' THEN 'añadido' WHEN 'view' THEN 'insertado' WHEN 'purchase' THEN 'eliminado' ELSE 'modificado' END"
_ROWS = f"rows AS (SELECT event_id AS block_id, {_SEVERITY} AS severity, {_KIND} AS change_type, concat('Resumen ', user_id % 50) AS summary, concat('Texto  ', user_id % 20) AS text_a, concat('texto ', user_id % 7) AS text_b, user_id % 10 AS job_id FROM events)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows made of events: the fields that views read."""
    u = F.col("user_id")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critica", "alta", "media", "baja", "")]), (u % 5 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "añadido").when(F.col("event_type") == "view", "insertado").when(F.col("event_type") == "purchase", "eliminado").otherwise("modificado")
    numbered = lambda prefix, n: F.concat(F.lit(prefix), (u % n).cast("string"))
    return _t(spark, d, "events").select(
        F.col("event_id").alias("block_id"), severity.alias("severity"), kind.alias("change_type"), numbered("Resumen ", 50).alias("summary"),
        numbered("Texto  ", 20).alias("text_a"), numbered("texto ", 7).alias("text_b"), (u % 10).alias("job_id"),
    )


def _pair_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    side = lambda x: docs.select(F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"t{x}"))
    return compare.candidate_pairs(docs).join(side("a"), "doc_a").join(side("b"), "doc_b").select("job_id", "ta", "tb")


def _index_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    pairs = compare.candidate_pairs(docs)
    chunks = docs.select("doc_id", F.explode(segment.fixed_chunks(F.col("text"))).alias("s")).select("doc_id", "s.index", "s.text")
    side = lambda x: pairs.select("job_id", F.col(f"doc_{x}").alias("doc_id")).join(chunks, "doc_id")
    return align.index_pairs(side("a"), side("b"))


def _matched_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Index pairs with both sides: those of a job stand in one row, so nothing is joined by index. Dealt to all tasks, as
    they take much work for their bytes, by which a join's partitions are merged."""
    texts = lambda x: F.transform(segment.fixed_chunks(F.col(x)), lambda s: s["text"]).alias(x)
    jobs = _pair_texts(spark, d).select("job_id", texts("ta"), texts("tb"))
    least = F.least(F.size("ta"), F.size("tb"))
    rows = jobs.select("job_id", F.posexplode(F.arrays_zip(*[F.slice(x, 1, least).alias(x) for x in ("ta", "tb")])).alias("index", "c"))
    rows = rows.select("job_id", "index", F.col("c.ta").alias("text_a"), F.col("c.tb").alias("text_b"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "job_id", "index")


@query(f"WITH {_PAIRS} SELECT job_id, doc_a, doc_b FROM pairs")
def doc_pairs(spark, d):
    return compare.candidate_pairs(_t(spark, d, "documents"))


@query("SELECT concat(doc_a, '-', doc_id) AS job_id, doc_a, doc_id AS doc_b FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY substr(text, 1, 60) ORDER BY doc_id) AS doc_a FROM documents WHERE trim(text, E' \\t\\n\\r') <> '') WHERE doc_a IS NOT NULL")
def alike_doc_pairs(spark, d):
    """Documents that begin alike."""
    return compare.alike_pairs(_t(spark, d, "documents"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def ingest_canonical_text(spark, d):
    return layout.canonical_text(layout.text_blocks(_t(spark, d, "documents")))


_BLOCKS = "lines AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i], E' \\t\\r') AS line FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)), kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM lines WHERE line <> '')"
_LIST = "regexp_matches(trim(text, E' \\t\\n\\r'), '(?i)^(?:[\\-–—•▪◦·●○■□]+|(?:\\(?\\d+(?:\\.\\d+)*[\\)\\.]|[a-z]\\)|[ivxlcdm]+[\\)\\.]))\\s+')"


@query(f"WITH {_BLOCKS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, line AS text, 'line' AS block_type FROM kept UNION ALL SELECT doc_id, 0, trim(text, E' \\t\\n\\r'), CASE WHEN {_LIST} THEN 'list_item' ELSE 'paragraph' END FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''")
def layout_blocks_txt(spark, d):
    return layout.text_blocks(_t(spark, d, "documents")).select("doc_id", "seq", "text", "block_type")


_SIGNALS = f"""{_BLOCKS}, c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n, {_LIST} AS li FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
m AS (SELECT doc_id, count(*) AS lines FROM kept GROUP BY doc_id),
q AS (SELECT c.doc_id, 1 + lines AS block_count, length(n) AS chars, len(string_split(n, ' ')) AS words, CASE WHEN li THEN 1 ELSE 0 END AS li,
 CASE WHEN length(n) <= 24 THEN 0.35 ELSE 0 END + CASE WHEN length(regexp_replace(n, '[^\\p{{L}}]', '', 'g')) / CAST(length(n) AS DOUBLE) < 0.55 THEN 0.1 ELSE 0 END AS noise FROM c JOIN m USING (doc_id))"""


@query(f"WITH {_SIGNALS} SELECT doc_id, block_count, CAST(1 AS BIGINT) AS canonical_block_count, CAST(chars AS DOUBLE) AS avg_line_length, CAST(words AS DOUBLE) AS avg_words_per_block, round(CAST(li AS DOUBLE) / block_count, 4) AS list_item_density, CAST(0 AS DOUBLE) AS duplicate_block_ratio, round(CAST(noise AS DOUBLE), 4) AS layout_noise_score, round(1 - CAST(noise AS DOUBLE) * 0.18, 4) AS quality_score FROM q")
def quality_signals(spark, d):
    signals = layout.quality_signals(layout.text_blocks(_t(spark, d, "documents")))
    return layout.quality_scores(signals, F.lit(1.0)).select("doc_id", "block_count", "canonical_block_count", "avg_line_length", "avg_words_per_block", "list_item_density", "duplicate_block_ratio", "layout_noise_score", "quality_score")


@query("SELECT doc_id, block_type, count(*) AS n FROM (SELECT doc_id, 'line' AS block_type FROM (WITH " + _BLOCKS + f" SELECT doc_id FROM kept) UNION ALL SELECT doc_id, CASE WHEN {_LIST} THEN 'list_item' ELSE 'paragraph' END FROM documents WHERE trim(text, E' \\t\\n\\r') <> '') GROUP BY ALL")
def block_type_counts(spark, d):
    return layout.block_type_counts(layout.text_blocks(_t(spark, d, "documents")))


@query("""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
y AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^(?:[-–—•●◦▪■□]+|\\(?\\d+(?:\\.\\d+)*[\\)\\.]|[a-z]\\)|[ivxlcdm]+[\\)\\.])\\s+', ''), '(?i)^(?:page|página|pagina|hoja)\\s+\\d+$', '') AS t FROM x),
z AS (SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^(?:[ivxlcdm]+[\\)\\.]|\\(?\\d+(?:\\.\\d+)*[\\)\\.]|[a-z]\\))$') OR regexp_matches(t, '^[^\\p{L}\\p{N}_]{3,}$') OR regexp_matches(t, '^[\\s\\-_.,=~*]{3,}$') THEN '' ELSE t END AS t FROM y)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[–—]{2,}', '-', 'g'), ',+', ',', 'g'), '\\.+', '.', 'g'), ';+', ';', 'g'), ':+', ':', 'g'), '\\s+([,.;:])', '\\1', 'g')) AS clean_text FROM z""")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize_text(text.collapse(F.col("text"))).alias("clean_text"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '') AS ls FROM documents),
r AS (SELECT doc_id, ls, list_filter(list_concat(ls[1:12], ls[-12:]), lambda x: length(x) > 3) AS e FROM l)
SELECT doc_id, array_to_string(CASE WHEN len(ls) < 12 THEN ls ELSE list_filter(ls, lambda x: len(list_filter(e, lambda y: y = x)) < 2) END, chr(10)) AS kept FROM r""")
def edge_line_drop(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    return _t(spark, d, "documents").select("doc_id", F.array_join(text.drop_edge_lines(lines), "\n").alias("kept"))


@query("""WITH x AS (SELECT doc_id, trim(text, E' \\t\\n\\r') AS t, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents), w AS (SELECT doc_id, t, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS words FROM x)
SELECT doc_id, words, CASE WHEN t = '' THEN 0 ELSE greatest(1, CAST(round_even(length(t) / 4, 0) AS INTEGER), CAST(round_even(words * CAST(1.35 AS DOUBLE), 0) AS INTEGER)) END AS tokens FROM w""")
def word_and_token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"), text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / CAST(length(text) AS DOUBLE), 6) AS alpha, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS canonical FROM documents WHERE length(text) > 0")
def canonical_texts(spark, d):
    docs = _t(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.round(text.alpha_ratio(F.col("text")), 6).alias("alpha"), text.canonical(F.col("text")).alias("canonical"))


@query(f"""WITH {_PAIR_TEXTS}, s AS (SELECT job_id, trim(ta, E' \\t\\n\\r') AS a, trim(tb, E' \\t\\n\\r') AS b, list_distinct(regexp_extract_all(lower(ta), '[\\p{{L}}\\p{{N}}_]+')) AS wa, list_distinct(regexp_extract_all(lower(tb), '[\\p{{L}}\\p{{N}}_]+')) AS wb FROM t)
SELECT job_id, round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE CAST(len(list_intersect(wa, wb)) AS DOUBLE) / len(list_distinct(list_concat(wa, wb))) END, 6) AS jaccard, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE least(length(a), length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS length_score FROM s""")
def token_jaccard(spark, d):
    a, b = F.col("ta"), F.col("tb")
    return _pair_texts(spark, d).select("job_id", F.round(text.token_jaccard(a, b), 6).alias("jaccard"), F.round(text.length_score(a, b), 6).alias("length_score"))


@query(f"""WITH {_CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunk GROUP BY doc_id), {_PAIRS}, x AS (SELECT job_id, CAST(c.idx AS INTEGER) AS i, CAST((c.idx * 7) % nb.n AS INTEGER) AS j, na.n AS n, nb.n AS m FROM pairs JOIN chunk c ON c.doc_id = doc_a JOIN n na ON na.doc_id = doc_a JOIN n nb ON nb.doc_id = doc_b)
SELECT job_id, i, j, round(CASE WHEN n <= 1 AND m <= 1 THEN 1 ELSE greatest(0, 1 - abs(CASE WHEN n <= 1 THEN 0 ELSE i / CAST(n - 1 AS DOUBLE) END - CASE WHEN m <= 1 THEN 0 ELSE j / CAST(m - 1 AS DOUBLE) END)) END, 6) AS position_score FROM x""")
def position_scores(spark, d):
    """Each chunk of the one document at its place against a chunk of the other: the seven-fold place, counted round."""
    docs = _t(spark, d, "documents").select("doc_id", F.size(segment.fixed_chunks(F.col("text"))).alias("n")).where("n > 0")
    side = lambda x, n: docs.select(F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(n))
    rows = compare.candidate_pairs(_t(spark, d, "documents")).join(side("a", "n"), "doc_a").join(side("b", "m"), "doc_b")
    rows = rows.select("job_id", "n", "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("j", (F.col("i") * 7 % F.col("m")).cast("int"))
    return rows.select("job_id", "i", "j", F.round(text.position_score(F.col("i"), F.col("n"), F.col("j"), F.col("m")), 6).alias("position_score"))


@query()
def text_ratio(spark, d):
    """Word-level and character-level similarity of the chunks at one place of each pair of documents."""
    both = _matched_chunks(spark, d)
    return both.select("job_id", "index", F.round(similarity.text_ratio("text_a", "text_b"), 6).alias("ratio"), F.round(text.token_jaccard(F.col("text_a"), F.col("text_b")), 6).alias("jaccard"))


# Units by list functions: a sentence end becomes chr(1); short units stay open for the next piece, done ones end with chr(2).
_NUMBERING = "regexp_matches({}, '(?i)^(?:[ivxlcdm]+[\\)\\.]|\\(?\\d+(?:\\.\\d+)*[\\)\\.]|[a-z]\\))$')"
_HEADING = "regexp_matches({}, '^(?:\\d+(?:\\.\\d+){{0,3}}\\s+)?[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ0-9 ,:;()/-]{{4,}}$')"
_BARE = "trim({}, E' \\t\\n\\r')"
_UNITS = f"""p AS (SELECT doc_id, unnest(regexp_split_to_array({_BARE.format("text")}, '\\n{{2,}}')) AS chunk, generate_subscripts(regexp_split_to_array({_BARE.format("text")}, '\\n{{2,}}'), 1) AS c FROM documents),
l AS (SELECT doc_id, c, list_filter(list_transform(regexp_split_to_array(chunk, '\\n+'), lambda x: {_BARE.format("x")}), lambda x: x <> '' AND NOT {_NUMBERING.format("x")}) AS ls FROM p),
w AS (SELECT doc_id, c, list_filter(flatten(list_transform(ls, lambda x: CASE WHEN {_HEADING.format("x")} THEN [x] ELSE list_transform(string_split(regexp_replace(x, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {_BARE.format("y")}) END)), lambda x: x <> '' AND NOT {_NUMBERING.format("x")}) AS ws FROM l),
g AS (SELECT doc_id, c, list_reduce(ws, lambda a, x: a || CASE WHEN length(string_split(a, chr(2))[-1]) <= 10 THEN ' ' ELSE chr(2) END || x) AS a FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, c, CASE WHEN contains(a, chr(2)) AND length(string_split(a, chr(2))[-1]) <= 10 THEN regexp_replace(a, chr(2) || '([^' || chr(2) || ']*)$', ' \\1') ELSE a END AS a FROM g),
u AS (SELECT doc_id, flatten(list(string_split(a, chr(2)) ORDER BY c)) AS us FROM e GROUP BY doc_id)"""


@query(f"WITH {_UNITS} SELECT doc_id, CAST(generate_subscripts(us, 1) - 1 AS INTEGER) AS unit, unnest(us) AS text FROM u")
def sentence_units(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.posexplode(segment.sentence_units(F.col("text"))).alias("unit", "text"))
    return docs


@query()
def segment_blocks(spark, d):
    return compare.prepared(_t(spark, d, "documents")).select("doc_id", F.inline("segments"))


@query(f"WITH {_CHUNKS} SELECT doc_id, idx AS index, piece AS text, CAST(idx * 250 AS INTEGER) AS start_char, CAST(idx * 250 + length(piece) AS INTEGER) AS end_char FROM chunk")
def fixed_chunks(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(segment.fixed_chunks(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query(f"WITH {_INDEX} SELECT job_id, idx AS index, pair_type, CASE pair_type WHEN 'orphan_b' THEN 'index_gap_a' WHEN 'orphan_a' THEN 'index_gap_b' ELSE 'index_1:1' END AS match_reason FROM ip")
def index_pairs(spark, d):
    return _index_pairs(spark, d).drop("text_a", "text_b")


@query(f"WITH {_INDEX} SELECT job_id, count(*) AS pairs, count(*) FILTER (pair_type = 'matched') AS matched, count(*) FILTER (pair_type = 'orphan_a') AS orphan_a, count(*) FILTER (pair_type = 'orphan_b') AS orphan_b, CASE WHEN count(*) FILTER (pa IS DISTINCT FROM pb) = 0 THEN 'done' WHEN count(*) FILTER (pair_type <> 'matched') >= count(*) * 0.5 THEN 'error' ELSE 'done_with_warnings' END AS status FROM ip GROUP BY job_id")
def pairing_counts(spark, d):
    """Counts of index pairs; unmatched ones count as failed and differing ones as answered by the fallback."""
    pairs = _index_pairs(spark, d)
    differ = pairs.groupBy("job_id").agg(F.count_if(~F.col("text_a").eqNullSafe(F.col("text_b"))).alias("differ"))
    out = metrics.pairing_counts(pairs).join(differ, "job_id")
    status = metrics.result_status(F.col("pairs"), F.col("orphan_a") + F.col("orphan_b"), F.col("differ"))
    return out.select("job_id", "pairs", "matched", "orphan_a", "orphan_b", status.alias("status"))


@query(f"WITH {_INDEX} SELECT job_id, round(least(1, sum(CASE WHEN pair_type = 'matched' THEN length(pa) ELSE 0 END) / CAST(sum(length(pa)) AS DOUBLE)), 4) AS coverage_a FROM ip GROUP BY job_id HAVING sum(length(pa)) > 0")
def alignment_coverage(spark, d):
    both = F.when(F.col("pair_type") == "matched", F.length("text_a")).otherwise(0)
    rows = _index_pairs(spark, d).groupBy("job_id").agg(F.sum(both).alias("aligned"), F.sum(F.length("text_a")).alias("chars")).where("chars > 0")
    return rows.select("job_id", metrics.coverage(F.col("aligned"), F.col("chars")).alias("coverage_a"))


@query("""WITH p AS (SELECT user_id AS job_id, event_id AS i, CASE WHEN event_type = 'error' THEN NULL ELSE event_id // 3 END AS a, CASE WHEN event_type = 'signup' THEN NULL ELSE event_id // 2 END AS b FROM events),
m AS (SELECT *, lag(a) OVER (PARTITION BY job_id ORDER BY i) AS la, lag(b) OVER (PARTITION BY job_id ORDER BY i) AS lb FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT p.job_id, p.i AS pair_index, CASE WHEN p.a IS NULL THEN 'orphan_b' WHEN p.b IS NULL THEN 'orphan_a' WHEN m.a <> coalesce(la + 1, 0) OR m.b <> coalesce(lb + 1, 0) THEN 'reanchored' ELSE 'matched' END AS pair_type FROM p LEFT JOIN m ON m.job_id = p.job_id AND m.i = p.i""")
def pair_labels(spark, d):
    e = _t(spark, d, "events")
    side = lambda n, off: F.when(F.col("event_type") == off, F.array().cast("array<int>")).otherwise(F.array(F.floor(F.col("event_id") / n).cast("int")))
    pairs = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pair_index"), side(3, "error").alias("a_indices"), side(2, "signup").alias("b_indices"), F.lit(1.0).alias("alignment_score"))
    return align.labelled(pairs).select("job_id", "pair_index", "pair_type")


@query(f"WITH {_INDEX} SELECT job_id, idx AS index, CASE pair_type WHEN 'orphan_b' THEN 'añadido' ELSE 'eliminado' END AS change_type, coalesce(trim(pa, E' \\t\\n\\r'), '') AS source_a, coalesce(trim(pb, E' \\t\\n\\r'), '') AS source_b FROM ip WHERE pair_type <> 'matched' AND coalesce(nullif(trim(pa, E' \\t\\n\\r'), ''), nullif(trim(pb, E' \\t\\n\\r'), '')) IS NOT NULL")
def heuristic_orphans(spark, d):
    pairs = _index_pairs(spark, d).where("pair_type != 'matched'")
    index = lambda x: F.when(F.col(f"text_{x}").isNotNull(), F.col("index")).alias(f"{x}_index")
    side = lambda x: F.coalesce(text.strip(F.col(f"text_{x}")), F.lit("")).alias(f"text_{x}")
    found = decide.heuristics(pairs.select("job_id", "index", index("a"), index("b"), side("a"), side("b")))
    return found.select("job_id", "index", F.explode("changes").alias("c")).select("job_id", "index", "c.change_type", "c.source_a", "c.source_b")


def _involved(spark: SparkSession, d: str) -> DataFrame:
    """All prepared documents, made once in the same way."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return stored(("involved",), docs, lambda: compare.involved(docs, compare.candidate_pairs(docs)), "documents")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """The aligned pairs of all documents with their next ones: made once for the queries that read them."""
    docs = _t(spark, d, "documents").select("doc_id", "text")

    def make() -> DataFrame:
        pairs = compare.candidate_pairs(docs)
        return compare.paired(pairs, _involved(spark, d))

    return stored(("aligned",), docs, make, "pairs")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Their decisions, the same way."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return stored(("decided",), docs, lambda: decide.decided(_aligned(spark, d)), "decided")


@query()
def align_blocks(spark, d):
    rows = _aligned(spark, d)
    return rows.select("job_id", "pair_index", "a_indices", "b_indices", F.round("alignment_score", 6).alias("alignment_score"), "match_reason", "pair_type", "match_confidence")


@query()
def display_segments(spark, d):
    """Word diffs of the index pairs; equal and delete give one side back, equal and insert the other."""
    rows = _matched_chunks(spark, d)
    return rows.withColumn("diff", similarity.diff_segments("text_a", "text_b")).select("job_id", "index", F.col("diff.a").alias("segments_a"), F.col("diff.b").alias("segments_b"))


@query()
def noise_equivalent(spark, d):
    rows = _matched_chunks(spark, d)
    rows = rows.select("job_id", "index", *[text.normalize_text(F.col(f"text_{x}")).alias(f"normal_{x}") for x in ("a", "b")])
    return rows.select("job_id", "index", "normal_a", "normal_b", similarity.is_noise_equivalent("normal_a", "normal_b").alias("equivalent"))


@query()
def change_rows(spark, d):
    return compare.change_rows(_compared(spark, d))


@query()
def job_results(spark, d):
    """Counts, coverage and status of each job."""
    decided = _compared(spark, d)
    return compare.job_meta(decided, compare.change_rows(decided, only=compare.COUNTED), compare.candidate_pairs(_t(spark, d, "documents").select("doc_id", "text")))


@query()
def job_payloads(spark, d):
    """The result of each job without its rows."""
    docs, decided = _t(spark, d, "documents").select("doc_id", "text"), _compared(spark, d)
    pairs = compare.candidate_pairs(docs)
    return compare.job_payloads(decided, compare.change_rows(decided, only=compare.COUNTED), pairs, _involved(spark, d))


@query(f"WITH {_ROWS}, k AS (SELECT *, lower(trim(regexp_replace(text_a, '\\s+', ' ', 'g'))) AS ka, lower(trim(regexp_replace(text_b, '\\s+', ' ', 'g'))) AS kb FROM rows), r AS (SELECT *, min(block_id) OVER (PARTITION BY job_id, change_type, ka, kb) AS first_id, row_number() OVER (PARTITION BY job_id, change_type, ka, kb ORDER BY length(summary) DESC, block_id) AS rank FROM k) SELECT job_id, first_id AS block_id, change_type, summary, text_a, text_b FROM r WHERE rank = 1")
def dedupe_exact(spark, d):
    rows = _rows(spark, d).withColumns({"display_text_a": F.col("text_a"), "display_text_b": F.col("text_b")})
    return postprocess.dedupe_exact(rows).select("job_id", "block_id", "change_type", "summary", "text_a", "text_b")


_HELD = "(k.a <> '' OR k.b <> '') AND ((contains(k.a, o.ka) AND contains(k.b, o.kb)) OR (contains(o.ka, k.a) AND contains(o.kb, k.b)))"


@query(f"""WITH RECURSIVE {_ROWS}, k AS (SELECT *, lower(trim(regexp_replace(text_a, '\\s+', ' ', 'g'))) AS ka, lower(trim(regexp_replace(text_b, '\\s+', ' ', 'g'))) AS kb FROM rows),
x AS (SELECT *, min(block_id) OVER (PARTITION BY job_id, change_type, ka, kb) AS first_id, row_number() OVER (PARTITION BY job_id, change_type, ka, kb ORDER BY length(summary) DESC, block_id) AS rank FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, change_type ORDER BY first_id) AS i FROM x WHERE rank = 1),
r AS (SELECT DISTINCT job_id, change_type, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(a VARCHAR, b VARCHAR, id BIGINT)[]) AS kept FROM n
 UNION ALL SELECT o.job_id, o.change_type, o.i, CASE WHEN len(list_filter(kept, lambda k: {_HELD})) > 0 THEN kept ELSE list_append(kept, {{'a': o.ka, 'b': o.kb, 'id': o.first_id}}) END FROM r JOIN n o ON o.job_id = r.job_id AND o.change_type = r.change_type AND o.i = r.i + 1),
z AS (SELECT job_id, change_type, unnest(arg_max(kept, i)).id AS id FROM r GROUP BY job_id, change_type)
SELECT n.job_id, first_id AS block_id, n.change_type, text_a, text_b FROM n JOIN z ON z.job_id = n.job_id AND z.change_type = n.change_type AND z.id = first_id""")
def dedupe_nested(spark, d):
    rows = _rows(spark, d).withColumns({"display_text_a": F.col("text_a"), "display_text_b": F.col("text_b")})
    return postprocess.deduplicated(rows).select("job_id", "block_id", "change_type", "text_a", "text_b")


@query(f"WITH {_ROWS} SELECT block_id, severity, change_type FROM rows WHERE severity = 'alta' AND change_type IN ('añadido', 'insertado')")
def view_filter(spark, d):
    return view.filtered(_rows(spark, d), severity="alta", change_type="insertado").select("block_id", "severity", "change_type")


@query(f"WITH {_ROWS} SELECT block_id, summary FROM rows WHERE contains(lower(concat_ws(' ', change_type, severity, summary, text_a, text_b)), 'resumen 7')")
def view_search(spark, d):
    return view.filtered(_rows(spark, d), query="  Resumen 7 ").select("block_id", "summary")


@query(f"WITH {_ROWS} SELECT block_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critica' THEN 4 WHEN 'alta' THEN 3 WHEN 'media' THEN 2 WHEN 'baja' THEN 1 ELSE 0 END DESC, block_id) AS place FROM rows QUALIFY place > 20 AND place <= 60")
def view_page(spark, d):
    """Rows 21 to 60 by severity, with their places."""
    rows = view.page(_rows(spark, d), offset=20, limit=40, by="severity_desc").select("block_id", "severity")
    from pyspark.sql import Window

    rank = F.create_map(*[F.lit(x) for p in view.SEVERITY_RANK.items() for x in p])
    order = Window.orderBy(F.coalesce(F.element_at(rank, F.col("severity")), F.lit(0)).desc(), "block_id")  # 40 rows
    return rows.withColumn("place", (F.row_number().over(order) + 20).cast("long"))


@query(f"WITH {_ROWS} SELECT count(*) AS total, least(40, count(*) - 20) AS returned, count(*) > 60 AS has_more, CASE WHEN count(*) > 60 THEN CAST(60 AS BIGINT) END AS next_offset, count(*) > least(40, count(*) - 20) AS truncated FROM rows")
def view_pagination(spark, d):
    return view.pagination(_rows(spark, d), offset=20, limit=40)


@query(f"WITH {_ROWS} SELECT block_id, coalesce(nullif(severity, ''), 'baja') AS severity, CASE change_type WHEN 'añadido' THEN 'insert' WHEN 'eliminado' THEN 'delete' WHEN 'modificado' THEN 'replace' ELSE 'pending' END AS row_status FROM rows")
def view_defaults(spark, d):
    return view.row_status(view.with_defaults(_rows(spark, d))).select("block_id", "severity", "row_status")


@query("""WITH l AS (SELECT source, doc_id, i, line FROM (SELECT source, doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT ls[i] AS line)),
k AS (SELECT source, doc_id, i, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '\\d+', '#', 'g') AS key, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
SELECT source, key, count(DISTINCT doc_id) AS pages, count(*) FILTER ((i - 1) / CAST(n AS DOUBLE) <= 0.12) AS top, count(*) FILTER (i / CAST(n AS DOUBLE) >= 0.88) AS bottom FROM k WHERE length(key) >= 3 GROUP BY ALL HAVING pages >= 2 AND (top >= 2 OR bottom >= 2)""")
def repeated_headers(spark, d):
    """Lines that stand near the top or bottom of several documents of a source."""
    docs = _t(spark, d, "documents").select("source", "doc_id", F.split("text", "\n").alias("ls"))
    rows = docs.select("source", "doc_id", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "line")).withColumn("key", text.repetition_key(F.col("line"))).where("key != ''")
    out = rows.groupBy("source", "key").agg(F.count_distinct("doc_id").alias("pages"), F.count_if(F.col("i") / F.col("n") <= layout.REPEAT_TOP).alias("top"), F.count_if((F.col("i") + 1) / F.col("n") >= layout.REPEAT_BOTTOM).alias("bottom"))
    return out.where("pages >= 2 and (top >= 2 or bottom >= 2)")


_FOLD = "SELECT user_id AS sid, event_type AS field, arg_max(value, (ts, event_id)) AS value, count(*) AS updates FROM events GROUP BY ALL"


@query(_FOLD)
def job_state_fold(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("field"), "value", "ts", "event_id")
    return jobs.fold(events, order=["ts", "event_id"])


@query(_FOLD)
def job_state_stream(spark, d):
    source = _t(spark, d, "events")
    # A stream reads folders: a table of one file is read from a folder that lists only that file.
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet" if len(source.inputFiles()) > 1 else "events.parquet").parquet(f"{d}/events.parquet" if len(source.inputFiles()) > 1 else d)
    rows = stream.select(F.col("user_id").alias("sid"), F.col("event_type").alias("field"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    where = shared_dir(spark, "job_state")
    name = where.rpartition("/")[2].replace("-", "_")
    jobs.to_table(jobs.fold_stream(rows, "ts", tie="event_id"), name, where).start().awaitTermination()
    return spark.table(name)


@query("SELECT user_id AS sid, count(*) AS done, least(99, 20 + CAST(floor(count(*) / CAST(max(count(*)) OVER () AS DOUBLE) * 75) AS INTEGER)) AS percent FROM events GROUP BY user_id")
def job_progress_pct(spark, d):
    done = _t(spark, d, "events").groupBy(F.col("user_id").alias("sid")).agg(F.count("*").alias("done"))
    return done.withColumn("total", done.agg(F.max("done")).scalar()).select("sid", "done", metrics.progress_percent(F.col("done"), F.col("total")).alias("percent"))


_TURNS = "SELECT conv_id, turn, role, text FROM conversations"


@query("""WITH r AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS lr, lag(text) OVER w AS lt FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, E' \\t\\n\\r') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, lt AS query, text AS answer FROM r WHERE role = 'assistant' AND lr = 'user'), n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, query, answer FROM p)
SELECT conv_id, CAST(pair AS INTEGER) AS pair, query, answer FROM n WHERE back <= 6""")
def chat_pairs(spark, d):
    return chat.question_answer_pairs(_t(spark, d, "conversations"))


@query("WITH g AS (SELECT conv_id, string_agg(concat('### ', role, chr(10), text), chr(10) || chr(10) ORDER BY turn) AS c FROM conversations WHERE trim(text, E' \\t\\n\\r') <> '' GROUP BY conv_id) SELECT conv_id, CASE WHEN length(c) > 15000 THEN concat(substr(c, 1, 15000), chr(10), '[contexto truncado]') ELSE c END AS context FROM g")
def context_block(spark, d):
    return chat.context_block(_t(spark, d, "conversations"), "conv_id", "role", "text", "turn")


@query("WITH m AS (SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn, min(turn) AS first FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS place FROM m) SELECT conv_id, role, turn, text, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def merge_by_name(spark, d):
    return chat.merge_by_name(_t(spark, d, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "turn", "text", "place")


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.role = 'system' AND s.conv_id = c.conv_id AND s.text = c.text)")
def unseen_messages(spark, d):
    turns = _t(spark, d, "conversations")
    return chat.unseen(turns, turns.where("role = 'system'"), ["conv_id", "text"]).select("conv_id", "turn")


@query("SELECT conv_id, string_agg(concat('[', turn, '] ', role, ': ', coalesce(text, '')), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript(spark, d):
    return chat.transcript(_t(spark, d, "conversations"))


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine FROM embeddings, q WHERE vec_id <> 0) SELECT vec_id, cosine FROM s ORDER BY cosine DESC, vec_id LIMIT 5")
def vector_topk(spark, d):
    return view.top_similar(_t(spark, d, "embeddings"), 0)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(c.v, q.v), 6) AS cosine FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_search(spark, d):
    """Every vector whose id is divisible by 20 against all."""
    vectors = _t(spark, d, "embeddings")
    return view.top_similar_each(vectors, vectors.where("vec_id % 20 = 0"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'añadido' WHEN 'view' THEN 'eliminado' ELSE NULL END AS change_type, CASE user_id % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'media' END AS confidence, CASE user_id % 3 WHEN 0 THEN 'critica' WHEN 1 THEN 'baja' ELSE 'media' END AS severity FROM events")
def level_synonyms(spark, d):
    e, u = F.col("event_type"), F.col("user_id") % 3
    word = F.when(e == "click", " New").when(e == "view", "DELETED").otherwise(e)
    sure, weight = F.when(u == 0, "HIGH").when(u == 1, "medium"), F.when(u == 0, "crítica").when(u == 1, "low").otherwise("?")
    return _t(spark, d, "events").select("event_id", text.change_type(word).alias("change_type"), text.confidence(sure).alias("confidence"), text.severity(weight).alias("severity"))


@query("SELECT doc_id, CASE WHEN length(trim(text, E' \\t\\n\\r')) > 1000 THEN concat(rtrim(substr(trim(text, E' \\t\\n\\r'), 1, 484), E' \\t\\n\\r'), chr(10), '[...texto truncado...]', chr(10), ltrim(right(trim(text, E' \\t\\n\\r'), 484), E' \\t\\n\\r')) ELSE trim(text, E' \\t\\n\\r') END AS excerpt, length(trim(text, E' \\t\\n\\r')) > 1000 AS truncated FROM documents")
def prompt_excerpts(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), 1000).alias("e")).select("doc_id", F.col("e.text").alias("excerpt"), "e.truncated")


@query("SELECT user_id AS sid, date_trunc('hour', ts) AS start, event_type AS field, count(*) AS n FROM events GROUP BY ALL")
def activity_windows(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("sid"), F.date_trunc("hour", "ts").alias("start"), F.col("event_type").alias("field"))
    return e.groupBy("sid", "start", "field").agg(F.count("*").alias("n"))


@query("SELECT r.r_name AS department, n.n_name AS role, count(*) AS users, round(sum(c.c_acctbal), 2) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL")
def relationship_joins(spark, d):
    """Foreign-key joins as the declared relations have them; nation and region are small and of fixed size."""
    c, n, r = (_t(spark, d, x) for x in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy(F.col("r_name").alias("department"), F.col("n_name").alias("role")).agg(F.count("*").alias("users"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
