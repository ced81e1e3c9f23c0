import pytest

LONG = "lang wort " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves or that need quoting."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "x", 1), (1, "one two three four five six seven eight nine ten", "x", 1),
        (2, None, None, None), (3, "", "", 0), (None, "one two three four five six seven eight nine ten", "y", 2), (4, LONG, "z", 3), (5, "\n\n \n", "w", 4), (6, "a", None, 5),
    ]
    names = "node count found kept ids clean is_toxic n_words n_hit n_lines n_tokens __text Kept total others i0 c0 r0".split()
    docs = spark.createDataFrame([(*r, *[r[2]] * (len(names) - 2), [r[3]], (r[3], r[2])) for r in rows], f"doc_id long, text string, node string, count int, {', '.join(f'`{x}` string' for x in names[2:] if x != 'Kept')}, `Kept2` string, `a.b` array<int>, `c``d` struct<`e f`: int, g: string>".replace("`Kept2`", "`KEPT_input`"))
    return docs.cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
