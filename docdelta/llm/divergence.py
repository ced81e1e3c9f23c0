r"""Source divergence audit: how far the words of each source are from those of other sources and of the language.

Sort-based streaming. A task counts the terms of the documents it reads, some megabytes at a time, so one
row (lang, term, source, document, docs, n) stands for a run of documents that were read one after
another; document is the first of them. The rows are dealt by language, term and source, sorted by document within
those, and one pass over the sorted rows sums each run of equal (lang, term, source) to its document
frequency and count. However common a word and however large a source is, its run has a row for each few megabytes of
the input. Kept terms are sorted again, so that the sources of a term are one run, which yields that term's part
of the sums of all pairs; a task adds up what its runs yield before it hands it on.

A pair's sum goes over all kept terms, but most terms are in few sources. So the sum is taken apart. Let
p(i) be a term's share in source i, o(i) the share of a term that i doesn't have, and f(p, q) a value. Then
f(p(i), p(j)) = [f(p(i), p(j)) - f(p(i), o(j)) - f(o(i), p(j)) + f(o(i), o(j))] + f(p(i), o(j)) + f(o(i), p(j)) - f(o(i), o(j)).
The bracket is 0 unless both sources have the term, and comes from the term's run. The other parts need
only how many terms have each share in a source, a small table.

All arithmetic is exact: 64-bit integers, and decimals of 38 digits for products and sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.llm.common import quoted, small_batches, together, utf8, written

MIN_DOCS = 3
TOP = 200
#: Shares are counted in such fractions.
SCALE = 1_000_000_000
#: Bytes of documents whose terms are counted together.
HOLD_BYTES = 16 << 20
#: Pairs of sources that are computed together, and sums of pairs that a task holds before it hands them on.
PAIRS, SUMS = 500_000, 500_000
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, doc, text) to a row for each term of a source among the documents read together."""
    for batch in together(batches, HOLD_BYTES):
        lang, source, doc = (batch.column(k).to_pylist() for k in range(3))
        groups: dict[tuple[str, str], tuple[int, Counter, Counter]] = {}
        for place, text in enumerate(utf8(batch.column(3))):
            terms = _TERM.findall(text.lower())  # of bytes, lower() changes A-Z alone
            if terms:
                _, n, docs = groups.setdefault((lang[place], source[place]), (doc[place], Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
        for (a, b), (first, n, docs) in groups.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(a, k), pa.array(n, pa.binary()).cast(pa.string()), pa.repeat(b, k), pa.repeat(first, k), pa.array(map(docs.__getitem__, n), pa.int64()), pa.array(n.values(), pa.int64())],
                ["lang", "term", "source", "doc", "docs", "n"],
            )


def _starts(*columns: pa.Array) -> np.ndarray:
    """The places where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one for each run of (lang, term, source). The last run of a batch waits: it may go on in the next one."""
    names, key, docs, n = ["lang", "term", "source", "docs", "n"], None, 0, 0

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in key), pa.array([docs], pa.int64()), pa.array([n], pa.int64())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(*batch.columns[:3])
        keys = [c.take(pa.array(starts)) for c in batch.columns[:3]]
        own_docs, own_n = (np.add.reduceat(batch.column(k).to_numpy(), starts) for k in (4, 5))
        if key is not None:
            if key == tuple(c[0].as_py() for c in keys):
                own_docs[0] += docs
                own_n[0] += n
            else:
                yield ended()
        key, docs, n = tuple(c[-1].as_py() for c in keys), int(own_docs[-1]), int(own_n[-1])
        yield pa.RecordBatch.from_arrays([*(c.slice(0, len(starts) - 1) for c in keys), pa.array(own_docs[:-1]), pa.array(own_n[:-1])], names)
    if key is not None:
        yield ended()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n) of docs (lang, source, text): in how many documents of a source a term is, and how often."""
    small_batches(docs.sparkSession)
    rows = docs.select("lang", "source", F.monotonically_increasing_id().alias("doc"), "text")
    each = rows.mapInArrow(_counted, "lang string, term string, source string, doc long, docs long, n long")
    dealt = each.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "doc")
    return dealt.mapInArrow(_runs, "lang string, term string, source string, docs long, n long")


def _value(p, q):
    return (p - q) * (p - q) // q


def _brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, o) sorted by lang and term to partial sums (lang, source, item, value) of brackets."""
    sums: dict[int, int] = {}
    numbers: dict[tuple[str, str], int] = {}
    left: pa.Table | None = None

    def add(codes: np.ndarray, p: np.ndarray, o: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(np.append(starts, len(codes)))
        size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)  # of each row's run
        done = np.concatenate(([0], np.cumsum(size)))
        at = 0
        while at < len(codes):  # as many rows as make PAIRS pairs
            end = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(at, end), size[at:end])
            j = np.repeat(start[at:end], size[at:end]) + np.arange(len(i)) - np.repeat(done[at:end] - done[at], size[at:end])
            i, j = i[i != j], j[i != j]
            at = end
            if not len(i):
                continue
            bracket = _value(p[i], p[j]) - _value(p[i], o[j]) - _value(o[i], p[j]) + _value(o[i], o[j])
            pair = (codes[i] << 32) | codes[j]
            order = np.argsort(pair, kind="stable")
            pair, bracket = pair[order], bracket[order]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            # Halves are summed apart, so that no sum leaves 64 bits.
            high, low = (np.add.reduceat(x, first).tolist() for x in (bracket >> 32, bracket & 0xFFFFFFFF))
            for k, a, b in zip(pair[first].tolist(), high, low, strict=True):
                sums[k] = sums.get(k, 0) + (a << 32) + b

    def out() -> pa.RecordBatch:
        names = list(numbers)
        a, b = [names[k >> 32] for k in sums], [names[k & 0xFFFFFFFF][1] for k in sums]
        columns = [pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array(b, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(map(Decimal, sums.values()), pa.decimal128(38, 0))], ["lang", "source", "item", "value"])

    def work(table: pa.Table) -> None:
        table = table.combine_chunks()
        lang, term, source, p, o = (c.chunk(0) for c in table.columns)
        codes = np.array([numbers.setdefault(x, len(numbers)) for x in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
        add(codes, p.to_numpy(), o.to_numpy(), _starts(lang, term))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]) if left is not None else table
        last = int(_starts(*(table.column(k).combine_chunks() for k in range(2)))[-1])
        if last:
            work(table.slice(0, last))
        left = table.slice(last)
        if len(sums) > SUMS:
            yield out()
            sums.clear()
    if left is not None:
        work(left)
    if sums:
        yield out()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any 64-bit numbers; null for a total of 0."""
    product = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(total > 0, F.call_function("div", product, total.cast("decimal(20,0)")) + 1)


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of docs; part is pair or term.

    Terms are runs of ASCII letters and characters beyond ASCII, with A-Z alone lower-cased; each
    language keeps those in at least min_docs of its documents. Part pair gives each source of a language how far it is
    from each other source of it, part term the first `top` kept terms that a source has more of than its
    language. Higher values come first, of equal ones the item whose UTF-8 is smaller.

    Each row of docs is a document, repeated rows and null ids too. Null texts, languages and sources
    count as empty ones. A source without terms has pairs but no terms; a language without kept terms has pairs
    with value 0; one with a single source has no pairs. No rows give no rows. Other columns take no part.
    """
    text_of = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    docs = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    of_term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).select("lang", "term", "source", "n", F.sum("docs").over(of_term).alias("df"), F.sum("n").over(of_term).alias("all"))
    kept = written(kept.where(F.col("df") >= min_docs).drop("df"), "kept")

    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = groups.withColumn("total", F.col("n") + F.col("v"))
    # One row for each source of a language; o is the share of a term that the source lacks.
    groups = written(groups.select("lang", "source", "v", "total", (F.col("lang_n") + F.col("v")).alias("lang_total"), _share(F.lit(0).cast("long"), F.col("total")).alias("o")), "groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", _share(F.col("n"), F.col("total")).alias("p"), "o", _share(F.col("all"), F.col("lang_total")).alias("q"))
    shares = written(shares, "shares")

    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    exact = lambda c: c.cast("decimal(38,0)")
    brackets = shares.select("lang", "term", "source", "p", "o").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_brackets, "lang string, source string, item string, value decimal(38,0)")
    left, right = groups.select("lang", "source", "o", "v"), groups.select("lang", F.col("source").alias("item"), F.col("o").alias("o2"))
    both = left.join(right, "lang").where("source != item")
    base = both.select("lang", "source", "item", F.when(F.col("v") > 0, exact(F.col("v")) * exact(_f("o", "o2"))).otherwise(0).cast("decimal(38,0)").alias("value"))
    # How many terms of a source have each share; a source's own ones against each other source's missing ones, and the reverse.
    hist = shares.groupBy("lang", "source", "p", "o").agg(F.count("*").alias("m"))
    own = hist.join(right, "lang").where("source != item").select("lang", "source", "item", (exact(F.col("m")) * exact(_f("p", "o2") - _f("o", "o2"))).cast("decimal(38,0)").alias("value"))
    other = hist.withColumnsRenamed({"source": "item", "o": "o2"}).join(left.drop("v"), "lang").where("source != item")
    other = other.select("lang", "source", "item", (exact(F.col("m")) * exact(_f("o", "p") - _f("o", "o2"))).cast("decimal(38,0)").alias("value"))
    sums = base.unionByName(own).unionByName(other).unionByName(brackets).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
