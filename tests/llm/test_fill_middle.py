import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docdelta.llm import fill_middle

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "runs": r"[\x20\x09-\x0D]+|[A-Za-z0-9_\x80-\U0010ffff]+|[\x00-\x08\x0E-\x1F!-/:-@\[-^`{-\x7F]+", "chars": r"(?s)."}


def brute(doc, text, seed=7, rate=100, spm_rate=50, units=UNITS["lines"], marks=("<P>", "<S>", "<M>")):
    text = text or ""
    cut = re.findall(units, text)
    n, h = len(cut), hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (cut[:a], cut[a:b], cut[b:]))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", prefix, middle, suffix, s + suffix + p + prefix + m + middle
    return n, "psm", prefix, middle, suffix, p + prefix + s + suffix + m + middle


def texts():
    rnd = random.Random(3)
    own = ["", "\n", "\n\n", "a", "a\n", "\na", "a\nb\nc", "x <P> y\nz", "<S>", "<M>\n", "a<\nP>\n<", "<P\n>S>\nM>", "😀\n😀😀\n", "é ü\t.\r\n z", "  ", "<<\n<S\n", "\x00\x1f_`\x7f~"]
    return own + ["".join(rnd.choice("ab \n<>PSM😀é.,") for _ in range(rnd.randrange(60))) for _ in range(150)] + ["langer Text\n" * 20_000]


@pytest.mark.parametrize("grammar", list(UNITS))
@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 100), (70, 0)])
def test_equals_brute_force_and_comes_back(spark, grammar, rate, spm_rate):
    rows = list(enumerate(texts()[:-1] if grammar != "lines" else texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, rate=rate, spm_rate=spm_rate, grammar=fill_middle.GRAMMARS[grammar])
    out = out.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    got = {r.doc_id: r for r in out.collect()}
    for doc, text in rows:
        r = got[doc]
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == brute(doc, text, rate=rate, spm_rate=spm_rate, units=UNITS[grammar])
        assert r.restored == text


def test_units_put_together_are_the_text(spark):
    docs = spark.createDataFrame([(t,) for t in texts()[:-1]], "text string")
    for grammar in fill_middle.GRAMMARS.values():
        assert docs.where(F.array_join(fill_middle.units(F.col("text"), grammar), "") != F.col("text")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    out = fill_middle.fill_in_middle(odd_docs)
    assert out.count() == odd_docs.count()
    for r in out.collect():
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == brute(r.doc_id, r.text)
    assert fill_middle.fill_in_middle(no_docs).count() == 0
    again = fill_middle.fill_in_middle(fill_middle.fill_in_middle(odd_docs))
    assert {"form", "form_input", "output_input"} <= set(again.columns)


def test_other_sentinels(spark):
    marks = fill_middle.Marks("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(k, "eins\nzwei\n[pr" * k) for k in range(20)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, marks=marks).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"), marks))
    assert all(r.restored == r.text for r in out.collect())
    for bad in (("", "a", "b"), ("a", "a", "b"), ("ab", "b", "c"), ("ab", "ca", "d"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fill_middle.Marks(*bad)


def test_nothing_is_shuffled(spark):
    plan = fill_middle.fill_in_middle(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
