r"""Fill-in-middle transformation by lookaround splitting.

A text is cut into units (lines, words, runs of a class, characters) and rearranged so that a model
learns to fill the middle between a prefix and a suffix. A unit grammar is a list of pairs of
character classes: a unit ends between two characters where the first is of a pair's left class and
the second of its right one. Each grammar becomes one zero-width regex of lookbehinds and
lookaheads; Spark's split at it takes no character away, so the pieces put together are the text.
An empty text has no units, which split would not say (it gives one empty piece).

Everything is a column expression of the row; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.llm.common import names_beside, quoted

#: Any character; half a surrogate pair never starts or ends a unit.
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Grammar:
    r"""Where units end: between a character of a left class and one of the right class beside it, in `[...]` form."""

    borders: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """The zero-width regex of the borders. Both sides must be there, so none matches at a text's ends."""
        return "|".join(f"(?<={left})(?={right})" for left, right in self.borders)


def runs(*classes: str) -> Grammar:
    """Units that are runs of one of the classes, which must not overlap: a unit ends where the class changes."""
    return Grammar(tuple((x, y) for x in classes for y in classes if x != y))


# Grammars by name. lines is `[^\n]*\n|[^\n]+`; words is a run of white space with the run of other characters behind it.
GRAMMARS: dict[str, Grammar] = {
    "lines": Grammar(((r"[\n]", ANY),)),
    "words": Grammar(((r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"),)),
    "runs": runs(r"[\x20\x09-\x0D]", r"[A-Za-z0-9_\x{80}-\x{10FFFF}]", r"[\x00-\x08\x0E-\x1F!-/:-@\[-^`{-\x7F]"),
    "chars": Grammar(((ANY, ANY),)),
}


@dataclass(frozen=True)
class Marks:
    """Sentinels of the rearranged text. None is empty, and none begins with what another (or itself) ends with, so each is found where it was put."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(x != y and x in y for x in marks for y in marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must differ, not be empty and not hold each other")
        if any(x.endswith(y[:k]) for x in marks for y in marks for k in range(1, len(y))):
            raise ValueError("no sentinel may begin with the end of another or of itself")


def units(text: Column, grammar: Grammar = GRAMMARS["lines"]) -> Column:
    """The units of a text in order, an array; none for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n 8-digit groups of the hex sha256 of `seed:key` as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def rearranged(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column, marks: Marks) -> Column:
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output of that form was made of: its parts are found again by the sentinels alone."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind first, behind second, and behind the middle's sentinel, each up to the next one."""
        tail = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(tail, second, 1)
        rest = F.substr(tail, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, marks.middle, 1)
        return one, two, F.substr(rest, F.length(two) + len(marks.middle) + 1)

    prefix, suffix, middle = between(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(marks.suffix, marks.prefix)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, grammar: Grammar = GRAMMARS["lines"], marks: Marks = Marks(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of docs with n (units), form, prefix, middle, suffix and output before its own columns.

    The draws of a row depend on seed and its id alone: h1 and h2 choose the two cuts among the n + 1
    places between units, h3 % 100 < rate whether the text is rearranged, h4 % 100 < spm_rate the
    suffix first form. The smaller cut ends the prefix, the larger one the middle; equal cuts leave the
    middle empty. Empty texts and those that hold a sentinel stay plain: their output is the text and
    their parts are null. A null text counts as empty, a null id as an empty one; rows with one id and
    text get one result. A column named like a new one gets `_input` behind its name.
    """
    new = ["n", "form", "prefix", "middle", "suffix", "output"]
    own = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[quoted(x).alias(y) for x, y in zip(docs.columns, own, strict=True)], F.coalesce(quoted(text_col), F.lit("")).alias("text"), *[x.alias(f"h{k}") for k, x in enumerate(draws(quoted(id_col), seed), 1)])
    rows = rows.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("long"))
    rows = rows.withColumn("x", F.col("h1") % (F.col("n") + 1)).withColumn("y", F.col("h2") % (F.col("n") + 1))
    rows = rows.withColumn("first", F.least("x", "y").cast("int")).withColumn("last", F.greatest("x", "y").cast("int"))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate)
    for mark in (marks.prefix, marks.suffix, marks.middle):
        plain = plain | F.contains("text", F.lit(mark))
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, size), ""))
    rows = rows.withColumns({
        "prefix": part(F.lit(1), F.col("first")),
        "middle": part(F.col("first") + 1, F.col("last") - F.col("first")),
        "suffix": part(F.col("last") + 1, F.size("units")),
    })
    rows = rows.withColumn("output", rearranged(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text"), marks))
    return rows.select(*new, *own).toDF(*new, *names_beside(new, docs.columns))
