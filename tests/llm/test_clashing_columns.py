"""Columns with names that the operators use, dots, backticks or nested fields come through unchanged."""

import pytest

from docdelta.llm import decontamination, line_dedup, masked_lm, pieces, pii, toxicity
from docdelta.llm.common import names_beside


def chain():
    import numpy as np

    return toxicity.Chain(np.array([1, 2]), [np.ones(2), np.ones(3)], [0.0, 0.0], 0.5)


def lm(docs):
    return masked_lm.score(docs, *masked_lm.fit(docs.select("doc_id", "text")))


RUN = {
    "pii": lambda docs, spark: pii.find_pii(docs),
    "lines": lambda docs, spark: line_dedup.dedup_lines(docs),
    "scan": lambda docs, spark: decontamination.scan(docs, spark.createDataFrame([(1, "one two three"), (None, "a")], "item_id long, text string")),
    "shards": lambda docs, spark: decontamination.scan(docs, spark.createDataFrame([(1, "one two three"), (None, "a")], "item_id long, text string"), most_words=2),
    "pieces": lambda docs, spark: pieces.encode_texts(docs),
    "toxic": lambda docs, spark: toxicity.classify(docs, chain(), ("low_quality", "toxic")),
    "untrained": lambda docs, spark: toxicity.classify(docs, None, ("low_quality", "toxic")),
    "lm": lambda docs, spark: lm(docs),
}


@pytest.mark.parametrize("name", RUN)
def test_other_columns_come_through(odd_docs, spark, name):
    out = RUN[name](odd_docs, spark)
    new = out.columns[: -len(odd_docs.columns)]
    own = names_beside(new, odd_docs.columns)
    assert out.columns == [*new, *own] and len({x.lower() for x in out.columns}) == len(out.columns)
    place = lambda rows, n: sorted((repr(tuple(r)[n:]) for r in rows))
    assert place(out.collect(), len(new)) == place(odd_docs.collect(), 0)


def test_decontaminated_documents_have_the_columns_of_docs(odd_docs, spark):
    out = decontamination.decontaminate(odd_docs, spark.createDataFrame([(1, "nothing of it")], "item_id long, text string"))
    assert out.columns == odd_docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd_docs.collect()))


def test_names_beside():
    assert names_beside(["kept"], ["Kept", "kept_input", "x"]) == ["Kept_input_input", "kept_input", "x"]
