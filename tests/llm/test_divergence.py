import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docdelta.llm import divergence


def brute(rows, min_docs=3, top=200):
    """rows (lang, source, text) to the rows of the audit, from all terms and pairs."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in c or ""))) for a, b, c in rows]
    df, n, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        v = len(kept)

        def shares(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept) + v
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // total for t in kept}

        p = {s: shares(n[lang, s]) for s in own}
        q = shares(sum((n[lang, s] for s in own), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -x, k) for k, (x, _, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, -x, k) for k, (x, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "é", "Ünder", "x1y", "日本", "zz_top", "a", "delta", "ÀÉ", "rare"]
    text = lambda: rnd.choice([None, "", "123", " ".join(rnd.choices(words, range(len(words), 0, -1), k=rnd.randrange(20)))])
    return [(rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s0", "s1", "ß", "Z", None]), text()) for _ in range(n)]


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_other_bounds(spark, monkeypatch):
    rows = corpus(9, 300)
    assert got(spark, rows, min_docs=20, top=3) == brute(rows, 20, 3)


def test_no_kept_terms_single_sources_and_ties(spark):
    rows = [("en", "a", "one two"), ("en", "b", "three"), ("en", "c", None), ("fr", "only", "un un un"), *[("de", s, "eins zwei") for s in "xyzx"]]
    assert got(spark, rows) == brute(rows)
    assert [r[3:] for r in got(spark, rows) if r[:3] == ("en", "a", "pair")] == [("b", 0, 1), ("c", 0, 2)]


def test_repeated_rows_and_long_texts(spark):
    rows = [("en", "a", "same words here")] * 5 + [("en", "b", "same " * 50_000 + "here")] * 2 + [("en", "c", "here")]
    assert got(spark, rows) == brute(rows)


def test_small_pieces(spark, monkeypatch):
    """Runs that go on over batches and tasks, and sums handed on early, change nothing."""
    rows = corpus(4, 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(divergence, "small_batches", lambda spark: None)
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_brackets_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [("l", f"t{t}", f"s{s}", int(rng.integers(1, 10**9)), int(s + 1)) for t in range(12) for s in range(t % 5 + 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(5)], ["lang", "term", "source", "p", "o"])

    def sums(pieces):
        total = Counter()
        for x in divergence._brackets(iter(pieces)):
            for r in x.to_pylist():
                total[r["source"], r["item"]] += int(r["value"])
        return {k: x for k, x in total.items()}

    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for _, t, s, p, o in rows:
        for _, t2, s2, p2, o2 in rows:
            if t == t2 and s != s2:
                want[s, s2] += f(p, p2) - f(p, o2) - f(o, p2) + f(o, o2)
    assert sums([batch]) == want
    monkeypatch.setattr(divergence, "PAIRS", 5)
    monkeypatch.setattr(divergence, "SUMS", 2)
    assert sums([batch.slice(k, 4) for k in range(0, len(rows), 4)]) == want


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("node", "lang").withColumnRenamed("kept", "source")
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute(rows)
    assert divergence.audit(no_docs.withColumnRenamed("node", "lang").withColumnRenamed("kept", "source")).count() == 0
