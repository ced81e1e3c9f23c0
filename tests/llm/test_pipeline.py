import corpus_pipeline
from pyspark.sql import functions as F

from docdelta.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "pieces"]
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] * 0.7 and docs.where("not decodes").count() == 0


def test_stages_take_odd_and_no_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "de", "s", 0), (None, "ein zwei drei", "de", "s", 13), (3, "ein zwei drei", "de", "s", 13), (3, "ein zwei drei", "de", "s", 13)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.withColumns({x: F.lit("x") for x in ("kept", "kept_id", "is_toxic", "clean", "n_hit", "ids", "a.b")})
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert docs.count() <= len(data) and (not data or docs.count() >= 3)


def test_every_operator_has_its_query(spark):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
