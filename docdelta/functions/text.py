"""Text operators as Column expressions.

Java patterns carry (?U) for Unicode classes and (?d) so that only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the engine strips it, and the patterns of the normaliser in its order.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PARAGRAPH = "\ue000PARA\ue000"
HYPHEN_BREAK = r"(?U)(\w)-\n(\w)"
PARAGRAPH_BREAK = r"\n{2,}"
NUMBERING_LINE = r"(?imdU)^\s*(?:[ivxlcdm]+[\)\.]|\(?\d+(?:\.\d+)*[\)\.]|[a-z]\))\s*$"
BULLET = r"(?mdU)^\s*(?:[-–—•●◦▪■□]+|\(?\d+(?:\.\d+)*[\)\.]|[a-z]\)|[ivxlcdm]+[\)\.])\s+"
PAGE_LABEL = r"(?imdU)^\s*(?:page|página|pagina|hoja)\s+\d+\s*$"
NOISE_LINE = r"(?mdU)^[^\w\n]{3,}$"
ARTEFACT_LINE = r"(?mdU)^[\s\-_.,=~*]{3,}$"
BLANKS = r"[\t\r\f\x0B ]+"
WORD_LINE_WORD = r"(?U)(?<=\w)\n(?=\w)"
DASHES = r"[–—]{2,}"
REPEATED_PUNCTUATION = r"([,.;:])\1+"
SPACE_BEFORE_PUNCTUATION = r"(?U)\s+([,.;:])"
# What a text must have for the normaliser to change it, but for a page label: a character beside letters, digits and blanks, or blanks at the ends or side by side.
UNEVEN = r"[^\p{L}\p{Nd} ]|  |\A | \z"
LIST_PREFIX = r"(?iU)^(?:[\-–—•▪◦·●○■□]+|(?:\(?\d+(?:\.\d+)*[\)\.]|[a-z]\)|[ivxlcdm]+[\)\.]))\s+"
SPACES = r"(?U)[\s\x1c-\x1f]+"
EDGE_LINES, EDGE_CHARS = 12, 3
MAX_EXCERPT = 35_200
CONTEXT_CHARS = 15_000

# Words that stand for a change type, a confidence and a severity.
CHANGE_TYPES = {
    "añadido": "añadido", "adicionado": "añadido", "agregado": "añadido", "insertado": "añadido", "added": "añadido", "addition": "añadido", "new": "añadido",
    "eliminado": "eliminado", "borrado": "eliminado", "removido": "eliminado", "deleted": "eliminado", "removed": "eliminado", "deletion": "eliminado",
    "modificado": "modificado", "cambiado": "modificado", "actualizado": "modificado", "updated": "modificado", "changed": "modificado", "modified": "modificado",
}
CONFIDENCES = {"baja": "baja", "low": "baja", "media": "media", "medium": "media", "alta": "alta", "high": "alta"}
SEVERITIES = {**CONFIDENCES, "critica": "critica", "crítica": "critica", "critical": "critica"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once."""
    return F.transform(F.array(value), then).getItem(0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def drop_edge_lines(lines: Column, corrected: bool = False) -> Column:
    """Without the lines that stand twice in the first and last twelve of twelve lines or more.

    The two windows overlap below 24 lines, and lines of up to three characters are never counted.
    corrected counts a line once there and leaves paragraph marks alone.
    """

    def repeated(x: Column) -> Column:
        tail = F.slice(x, -EDGE_LINES, EDGE_LINES)
        if corrected:
            tail = F.slice(x, F.greatest(F.lit(EDGE_LINES), F.size(x) - EDGE_LINES) + 1, EDGE_LINES)
        edges = F.filter(F.concat(F.slice(x, 1, EDGE_LINES), tail), lambda y: F.length(y) > EDGE_CHARS)
        if corrected:
            edges = F.filter(edges, lambda y: y != PARAGRAPH)
        counted = F.aggregate(edges, F.struct(F.array().cast("array<string>").alias("once"), F.array().cast("array<string>").alias("more")), lambda acc, y: F.struct(
            F.array_append(acc["once"], y).alias("once"),
            F.when(F.array_contains(acc["once"], y), F.array_append(acc["more"], y)).otherwise(acc["more"]).alias("more"),
        ))
        return counted["more"]

    return let(lines, lambda x: F.when(F.size(x) < EDGE_LINES, x).otherwise(let(repeated(x), lambda r: F.filter(x, lambda y: ~F.array_contains(r, y)))))


def normalize_text(c: Column, corrected: bool = False) -> Column:
    """The normal form of a text: breaks, hyphens, numbering, bullets, labels, noise, edges, punctuation."""
    text = F.coalesce(c, F.lit(""))
    t = F.replace(F.replace(F.translate(text, "\u2028\u2029\u0085", "\n\n\n"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.translate(t, "\x0c\xad", "\n")
    t = F.regexp_replace(t, HYPHEN_BREAK, "$1$2")
    t = F.regexp_replace(t, PARAGRAPH_BREAK, f"\n{PARAGRAPH}\n")
    for pattern in (NUMBERING_LINE, BULLET, PAGE_LABEL, NOISE_LINE, ARTEFACT_LINE):
        t = F.regexp_replace(t, pattern, "")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    t = F.array_join(drop_edge_lines(lines, corrected), "\n")
    t = F.translate(F.regexp_replace(F.regexp_replace(t, BLANKS, " "), WORD_LINE_WORD, " "), "\n", " ")
    t = F.replace(t, F.lit(PARAGRAPH), F.lit("\n\n"))
    t = F.regexp_replace(F.regexp_replace(t, DASHES, "-"), REPEATED_PUNCTUATION, "$1")
    t = F.regexp_replace(F.regexp_replace(t, SPACE_BEFORE_PUNCTUATION, "$1"), r"[ \t]{2,}", " ")
    t = strip(F.regexp_replace(t, r"[ \t]*\n\n[ \t]*", "\n\n"))
    return F.when(F.rlike(text, F.lit(UNEVEN)) | F.rlike(text, F.lit(PAGE_LABEL)), t).otherwise(text)


def canonical(c: Column) -> Column:
    """Stripped, lower-cased, white space collapsed."""
    return F.lower(collapse(c))


def repetition_key(c: Column) -> Column:
    """Lower-cased with digits as #; empty below three characters."""
    return let(F.regexp_replace(canonical(c), r"(?U)\d+", "#"), lambda x: F.when(F.length(x) >= 3, x).otherwise(""))


def alpha_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)).otherwise(0.0)


def word_count(c: Column) -> Column:
    return F.when(collapse(c) == "", 0).otherwise(F.size(F.split(collapse(c), " ")))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of words; 0 where either is empty."""
    both = F.struct(token_set(F.coalesce(a, F.lit(""))).alias("a"), token_set(F.coalesce(b, F.lit(""))).alias("b"))
    return let(both, lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"]))))


def length_score(a: Column, b: Column) -> Column:
    return let(F.struct(F.length(strip(a)).alias("a"), F.length(strip(b)).alias("b")), lambda x: F.when((x["a"] > 0) & (x["b"] > 0), F.least(x["a"], x["b"]) / F.greatest(x["a"], x["b"])).otherwise(0.0))


def position_score(i: Column, n: Column, j: Column, m: Column) -> Column:
    at = lambda k, of: F.when(of <= 1, 0.0).otherwise(k / (of - 1))
    return F.when((n <= 1) & (m <= 1), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(at(i, n) - at(j, m))))


def block_similarity(jaccard: Column, ratio: Column, length: Column, position: Column) -> Column:
    return jaccard * 0.45 + ratio * 0.35 + length * 0.10 + position * 0.10


def joined_texts(texts: Column) -> Column:
    """Stripped texts that are not blank, joined by blanks."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda x: x != ""), " ")


def excerpt(c: Column, limit: int = MAX_EXCERPT) -> Column:
    """struct(text, truncated): head and tail around a mark where the stripped text is longer than the limit."""
    head = max(1, limit // 2 - 16)
    tail = max(1, limit - head - 32)
    cut = lambda x: F.concat(F.rtrim(F.substring(x, 1, head), F.lit(WHITE)), F.lit("\n[...texto truncado...]\n"), F.ltrim(F.right(x, F.lit(tail)), F.lit(WHITE)))
    return let(strip(F.coalesce(c, F.lit(""))), lambda x: F.struct(F.when(F.length(x) <= limit, x).otherwise(cut(x)).alias("text"), (F.length(x) > limit).alias("truncated")))


def estimate_tokens(c: Column) -> Column:
    """The larger of a quarter of the characters and 1.35 times the words, rounded half to even; 0 for blanks."""
    return let(strip(F.coalesce(c, F.lit(""))), lambda x: F.when(x == "", 0).otherwise(
        F.greatest(F.lit(1), F.bround(F.length(x) / 4).cast("int"), F.bround(word_count(x) * 1.35).cast("int"))
    ))


def estimate_message_tokens(contents: Column) -> Column:
    return F.aggregate(contents, F.lit(0), lambda acc, x: acc + estimate_tokens(x) + 12)


def adjusted_quality(base: Column, noise: Column, tables: Column, repeated_headers: Column) -> Column:
    penalty = F.least(F.lit(0.18), noise * 0.18) + F.least(F.lit(0.1), tables * 0.1) + F.when(repeated_headers, 0.03).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)), 4)


def reliable(score_a: Column, score_b: Column) -> Column:
    return F.least(score_a, score_b) >= 0.5


def scan_like(engine: Column, avg_line_length: Column, noise: Column) -> Column:
    return (engine == "rapidocr") | ((engine == "pdf") & ((F.coalesce(avg_line_length, F.lit(0.0)) <= 22) | (F.coalesce(noise, F.lit(0.0)) >= 0.55)))


def _lookup(values: dict[str, str], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(table, F.lower(strip(F.coalesce(c, F.lit("")))))


def change_type(c: Column) -> Column:
    """Null where the word is unknown."""
    return _lookup(CHANGE_TYPES, c)


def confidence(c: Column) -> Column:
    return F.coalesce(_lookup(CONFIDENCES, c), F.lit("media"))


def severity(c: Column) -> Column:
    return F.coalesce(_lookup(SEVERITIES, c), F.lit("media"))


def optional_int(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c).try_cast("int")


def first_text(*candidates: Column) -> Column:
    """The first candidate that is not blank, stripped; empty without one."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit(""))


def file_extension(c: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"\.([^.]*)$", 1))


def clamp_context(c: Column, limit: int = CONTEXT_CHARS, mark: str = "\n[contexto truncado]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def password_classes(c: Column, symbols: str = r"[^A-Za-z0-9]") -> Column:
    """struct(lower, upper, digit, symbol): which classes of characters occur."""
    return F.struct(*[c.rlike(p).alias(n) for n, p in (("lower", "[a-z]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("symbol", symbols))])


def merged_segments(segments: Column) -> Column:
    """Adjacent segments of one type become one; unknown types count as equal, empty texts go."""
    kind = lambda x: F.when(x["type"].isin("equal", "insert", "delete", "replace"), x["type"]).otherwise("equal")
    clean = F.filter(F.transform(segments, lambda x: F.struct(kind(x).alias("type"), F.coalesce(x["text"], F.lit("")).alias("text"))), lambda x: x["text"] != "")

    def runs(own: Column) -> Column:
        """Each run from its first place to the next run's first place."""
        n = F.size(own)
        first = lambda i: (i == 1) | (F.element_at(own, i)["type"] != F.element_at(own, F.greatest(i - 1, F.lit(1)))["type"])
        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), first))
        joined = lambda i, after: F.array_join(F.transform(F.slice(own, i, after - i), lambda x: x["text"]), "")
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.element_at(own, i)["type"].alias("type"), joined(i, F.coalesce(F.get(at, k + 1), n + 1)).alias("text"))))

    return let(clean, runs)
