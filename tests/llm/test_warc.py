import base64
import hashlib

from pyspark.sql import functions as F

from docdelta.llm import warc
from docdelta.llm.common import shared_dir


def test_archives_come_back_through_the_index(spark):
    urls = ["https://www.Example.com/a?b#c", "http://example.com", None, "", "x\ny z", "https://www.example.com/a?b#c"]
    rows = [(i, urls[i % 6], None if i % 7 == 0 else f"<p>{'é' * (i % 5)}</p>\r\n\r\n") for i in range(60)] + [(None, "u", "allein"), (3, urls[3], "<p>ééé</p>\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives, index = shared_dir(spark, "warc"), shared_dir(spark, "cdx")
    warc.write_index(warc.write_archives(pages, archives), index, block_lines=4)
    assert spark.read.parquet(f"{index}/directory").count() >= 15
    got = warc.read_back(pages.select(warc.surt(F.col("url")).alias("surt"), "page_id"), index, archives, with_payload=True).collect()
    last = {}
    for page_id, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), page_id if page_id is not None else -1)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = last[html or ""] not in (page_id, -1)
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[html or ""] if again else None, None if again else data))
    assert sorted(((*r[:5], r[5] and bytes(r[5])) if r[5] != b"" else tuple(r) for r in map(tuple, got)) , key=repr) == sorted(want, key=repr)
    assert warc.read_back(pages.select(F.lit("com,nowhere)/").alias("surt"), "page_id"), index, archives).count() == 0


def test_short_payloads_are_responses_all(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    archives, index = shared_dir(spark, "warc"), shared_dir(spark, "cdx")
    warc.write_index(warc.write_archives(pages, archives, min_bytes=3), index)
    got = {r.page_id: r.record_type for r in warc.read_back(pages.select(warc.surt(F.col("url")).alias("surt"), "page_id"), index, archives).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index, archives = warc.archive(spark, pages)
    assert warc.read_back(pages.select(F.lit("").alias("surt"), "page_id"), index, archives).count() == 0


def test_keys_have_the_host_reversed(spark):
    got = spark.sql("SELECT 'https://a.B.example.com:80/x/Y?z' AS u").select(warc.surt(F.col("u"))).head()[0]
    assert got == "com:80,example,b,a)/x/Y?z"
