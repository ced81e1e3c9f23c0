import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docdelta import schemas
from docdelta.operators import chat, layout, view
from docdelta.sources import files
from docdelta.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def folder(tmp_path):
    def archive(name, parts):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, text in parts.items():
                z.writestr(path, text)

    p = lambda text, extra="": f"<w:p>{extra}<w:r><w:t>{text}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('A')}</w:tc><w:tc>{p('B')}</w:tc></w:tr></w:tbl>"
    archive("a.docx", {"word/document.xml": f'<w:document {W}><w:body>{p("Titel", "<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>")}{p("Text")}{p("- Punkt")}<w:p><w:r><w:br w:type="page"/></w:r></w:p>{table}</w:body></w:document>'})
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    archive("b.xlsx", {
        "xl/workbook.xml": f'<workbook {S} {r}><sheets><sheet name="Hoja" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>uno</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c/><c><v>2.5</v></c></row></sheetData></worksheet>',
    })
    archive("c.pptx", {"ppt/slides/slide1.xml": '<s xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Folie</a:t></a:r></a:p></s>'})
    (tmp_path / "d.docx").write_bytes(b"kein Archiv")
    (tmp_path / "e.txt").write_bytes("Ebene é".encode())
    (tmp_path / "f.txt").write_bytes(b"caf\xe9 \x81")
    (tmp_path / "g.txt").write_bytes(b"")
    return tmp_path


def test_files(spark, folder):
    found = files.read_files(spark, f"file://{folder}")
    assert found.count() == 6
    texts = {r.name: r.text for r in files.read_text(found.where("extension = '.txt'")).collect()}
    assert texts == {"e.txt": "Ebene é", "f.txt": "café \x81"}
    blocks = files.read_office(found).withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name", "seq").collect()
    kept = [(r.name, r.block_type, r.text) for r in blocks if not r.drop_in_canonical]
    assert kept == [("a.docx", "header", "Titel"), ("a.docx", "paragraph", "Text"), ("a.docx", "list_item", "- Punkt"), ("a.docx", "page_break", ""), ("a.docx", "table_row", "A | B"), ("b.xlsx", "header", "Hoja"), ("b.xlsx", "table_row", "uno | 2.5"), ("c.pptx", "paragraph", "Folie")]
    assert files.validate("X.TXT") == ".txt" and ".txt" in files.capabilities()["extensions"]
    for bad in (("x.exe", "auto"), ("x", "auto"), ("x.txt", "other")):
        with pytest.raises(files.UnsupportedFormat):
            files.validate(*bad)
    sizes = spark.createDataFrame([("a/x.txt", 0), ("a/y.TXT", 9), ("a/z.txt", 7), ("a/w", 1)], "path string, length long")
    assert [r.reason for r in view.valid_files(sizes, (".txt",), 7).collect()] == ["empty", "too_large", None, "unsupported"]


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "b")], "sid string, block_id int, summary string")
    path = f"file://{tmp_path}/results"
    files.write_results(rows, path)
    files.write_results(rows.where("sid = 's1'").withColumn("summary", F.lit("neu")), path)
    assert [r.summary for r in files.read_results(spark, path, "s1").collect()] == ["neu"] and files.read_results(spark, path, "s2").count() == 1
    files.export_json(rows, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([("s", i, f"f{i % 3}", str(i), f"2024-01-0{1 + i % 5} 00:00:00") for i in range(30)], "sid string, seq long, field string, value string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    jobs.to_table(jobs.fold_stream(stream, "ts"), "folded", f"{tmp_path}/checkpoint").start().awaitTermination()
    want = sorted(map(tuple, jobs.fold(events, order=["ts", "seq"]).collect()))
    assert sorted(map(tuple, spark.table("folded").collect())) == want and len(want) == 3
    appended = events.withColumn("pair_index", F.col("seq"))
    appended.write.parquet(f"file://{tmp_path}/pairs")
    jobs.append_pairs(spark.readStream.schema(appended.schema).parquet(f"file://{tmp_path}/pairs"), f"file://{tmp_path}/out", f"{tmp_path}/c2").start().awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 30


def test_stream_table_is_in_files(spark, tmp_path):
    """The folded table is read from the shared folder, not from the driver, and goes on over later files."""
    events = spark.range(40).select(F.lit("s").alias("sid"), F.col("id").alias("seq"), F.concat(F.lit("f"), F.col("id") % 3).alias("field"), F.col("id").cast("string").alias("value"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts"))
    for part in ("seq < 20", "seq >= 20"):
        events.where(part).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
        jobs.to_table(jobs.fold_stream(stream, "ts"), "in_files", f"{tmp_path}/checkpoint").start().awaitTermination()
        got = spark.table("in_files")
        assert got.inputFiles() and sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.fold(events.where("seq < 20 or " + part), order=["ts", "seq"]).collect()))


def test_state_values(spark):
    got = spark.createDataFrame([("True",), ("None",), ("5",), ('{"a": 1}',)], "v string").select(F.to_json(jobs.decoded(F.col("v")))).collect()
    assert [json.loads(r[0]) for r in got] == ["True", "None", 5, {"a": 1}]


def test_chat(spark):
    turns = [(1, i, role, text) for i, (role, text) in enumerate([("user", "a"), ("user", "b"), ("system", "s"), ("assistant", "c"), ("assistant", "d"), ("user", " "), ("user", "e"), ("assistant", "f")])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert [(r.query, r.answer) for r in chat.question_answer_pairs(df).orderBy("pair").collect()] == [("b", "c"), ("e", "f")]
    assert [r.query for r in chat.question_answer_pairs(df, last=1).collect()] == ["e"]
    nested = spark.createDataFrame([([[1, 0, None], None, [2]],)], "ids array<array<int>>")
    assert nested.select(chat.flattened_ids(F.col("ids"))).head()[0] == [1, 2]
    fragments = spark.createDataFrame([([(2, 1), (None, None), (1, 3)],)], "f array<struct<page: int, fragment: int>>")
    assert [tuple(x) for x in fragments.select(chat.sorted_fragments(F.col("f"))).head()[0]] == [(1, 3), (None, None), (2, 1)]
    level = chat.level_meter(spark.range(8000).select(F.col("id").alias("seq"), F.when(F.col("id") < 4000, 0).otherwise(255).alias("value"))).orderBy("chunk").collect()
    assert [(r.n, r.decibel, r.speaking) for r in level] == [(4000, -60.0, False), (4000, 0.0, True)]


def test_declared_tables(spark):
    for name, ddl in schemas.RELATIONAL.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_vector_search_asks_for_every_twentieth(spark, monkeypatch):
    monkeypatch.setattr(view, "BLOCK", 90)
    d = "/root/testdata/sf0.01"
    got = {}
    for r in entry.queries()["vector_search"](spark, d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.cosine))
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    assert set(got) == {r.vec_id for r in vectors.where("vec_id % 20 = 0").collect()}
    for query in sorted(got)[:3]:
        assert [x[1:] for x in sorted(got[query])] == [tuple(r) for r in view.top_similar(vectors, query).collect()]


def test_vector_search_meets_every_block_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(view, "BLOCK", 90)
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
        got = {}
        for r in view.top_similar_each(vectors, vectors.where("vec_id % 20 = 0")).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.cosine))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows = vectors.toPandas()
    v = np.array(rows.embedding.tolist(), float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    ids = rows.vec_id.to_numpy()
    for i in np.flatnonzero(ids % 20 == 0):
        cosine = np.round(v @ v[i], 6)
        order = [j for j in np.lexsort((ids, -cosine)) if ids[j] != ids[i]][:5]
        assert [x[1] for x in sorted(got[ids[i]])] == ids[order].tolist()


def test_search_index_holds_a_row_for_each_block_not_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(view, "BLOCK_ROWS", 40)
    rows = spark.range(300).select(
        "id", F.lit("k").alias("sub"), F.concat(F.lit("Añejo \U0001f600 "), (F.col("id") % 13).cast("string")).alias("text_a"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("x\0"), "id")).alias("text_b"), F.array(F.struct(F.lit("equal").alias("type"), F.lit("").alias("text"))).alias("display_segments_a"),
    )
    index = view.search_index(rows, ["id", "sub"])
    assert index.where("gram = 'ñej'").count() == index.select("blocks").head()[0] == 8 and index.where("gram = 'ñej'").agg(F.sum("n")).head()[0] == 300
    queries = ["ñEJO", "\U0001f600 1", "o", "x\0", "x\0" + "21", "12 x", "ab", "nada de esto", "  ", "12", None, "añejo \U0001f600 12"]
    got = {}
    for r in view.searched(rows, index, spark.createDataFrame([(q,) for q in queries], "query string"), ["id", "sub"]).collect():
        got.setdefault(r.query, []).append(r.id)
    want = {q.strip().lower(): sorted(r.id for r in view.filtered(rows, query=q).collect()) for q in queries if q and q.strip()}
    assert {q: sorted(ids) for q, ids in got.items()} == {q: ids for q, ids in want.items() if ids}


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 40
    assert entry.entry(spark).count() > 0
    assert layout.block_type_counts(layout.text_blocks(spark.createDataFrame([(1, "a\n\n- b")], "doc_id long, text string"))).count() == 3


def test_files_are_read_by_suffix(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("Uno.\nDos.\n\n- Tres.")
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.exe").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r for r in files.extracted(files.read_files(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"a.TXT", "b.docx"}
    a, b = got["a.TXT"], got["b.docx"]
    assert (a.source_format, a.engine_used, a.text, a.blocks) == ("txt", "text", "Uno. Dos.\n\n- Tres.", {"line": 3, "list_item": 1, "paragraph": 1})
    assert (b.source_format, b.engine_used, b.text, b.blocks, b.block_count) == ("docx", "docx", "", {}, None) and 0 < a.quality_score <= 1
    assert files.text_facade(files.read_files(spark, f"file://{tmp_path}")).columns == ["path", "text", "quality_score"]


def test_absent_results_are_none(spark, tmp_path):
    assert files.read_results(spark, f"file://{tmp_path}/none", "s") is None
    files.write_results(spark.createDataFrame([("s", "x")], "sid string, summary string"), f"file://{tmp_path}/rows")
    assert files.read_results(spark, f"file://{tmp_path}/rows", "t") is None and files.read_results(spark, f"file://{tmp_path}/rows", "s").count() == 1
