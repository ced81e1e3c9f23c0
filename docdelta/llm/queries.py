"""The operators over the test tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm import byte_bpe, decontamination, divergence, fill_middle, html_template, jaccard_join, line_dedup, masked_lm, pieces, pii, topk, toxicity, warc
from docdelta.llm.common import table

CATEGORIES = ("low_quality", "toxic")


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")
    return toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, CATEGORIES)


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the probability of each category, is_toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.classify(docs, toxicity_chain(spark, sf_dir), CATEGORIES)
    return out.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index, archives = warc.archive(spark, pages)
    return warc.read_back(pages.select(warc.surt(F.col("url")).alias("surt"), F.col("page_id").cast("long").alias("page_id")), index, archives)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the ids of the best segmentation, the scores of the best four, whether it decodes to the text."""
    return pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text").select("doc_id", "n_pieces", "ids", "scores", "decodes")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, log_likelihood (the sum over its tokens) and their mean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score(docs, *masked_lm.fit(docs), kept=["doc_id"]).select("doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kinds: F.filter("found", lambda x: x["kind"].isin(list(kinds)))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(join(of(pii.BASE)), 256).alias("base_sha256"), join(F.col("found")).alias("spans"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), digest("output"), digest("restored"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN, blanks_begin=True, decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_chain, op2_warc_index, op3_jaccard_join, op4_piece_lattice, op5_line_dedup, op6_html_template, op7_decontamination, op8_masked_lm, op9_pii, op10_exact_topk,
        op11_fill_in_middle, op12_byte_bpe, op13_source_divergence,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"
_KEY = _LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

#: DuckDB SQL for the queries that SQL can express. The others train models, search lattices or parse
#: pages; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_index": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to FROM l""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
            FROM (SELECT * FROM w WHERE len(ws) > 0), LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(other) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    "op5_line_dedup": f"""
        WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
            FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)),
        k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        j AS (SELECT doc_id, i, line, first IS NOT NULL AND first <> doc_id AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op7_decontamination": f"""
        WITH w AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
            FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM w WHERE len(ws) > 0), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i)),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
            FROM d, (SELECT DISTINCT n FROM iw), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i)),
        m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON iw.win = dw.win AND iw.n = dw.n),
        c AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id),
        h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM m, LATERAL (SELECT unnest(range(i, i + n)) AS place) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)""",
    "op10_exact_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM d),
        n AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM l),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM p""",
    "op13_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v, k.n AS lang_n, l.n AS lang_total
            FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT lang, source, term, n, CAST(1 + 1000000000 * CAST(n + 1 AS HUGEINT) // (total + v) AS HUGEINT) AS p, CAST(1 + 1000000000 * (lang_n + 1) // (lang_total + v) AS HUGEINT) AS q FROM a),
        pair AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
            ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
