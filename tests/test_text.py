import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docdelta.columns import slices
from docdelta.functions import similarity as sim
from docdelta.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).head()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("foo-\nbar", "foobar"), ("1) Hola mundo", "Hola mundo"), ("mil. Hola", "Hola"), ("fin,, ya", "fin, ya"), ("a – — b", "a – — b"), ("a ——— b", "a - b"),
        ("uno\x0cdos", "uno dos"), ("co\xadche", "coche"), ("Página 3\nTexto", "Texto"), ("----\nTexto", "Texto"), ("x ; y", "x; y"), (None, ""), (" \n ", ""), ("a b", "a b"), ("(2.1)\nB", "B"),
    ],
)
def test_normal_form(spark, raw, want):
    assert one(spark, raw, t.normalize_text) == want


def paragraphs(n):
    return "\n\n".join(f"Absatz Nummer {i} hier" for i in range(n))


@pytest.mark.parametrize(("n", "kept"), [(6, range(6)), (7, (0, 6)), (11, [i for i in range(11) if i != 5]), (12, range(12))])
def test_edge_windows_overlap_and_marks_count_as_lines(spark, n, kept):
    got = one(spark, paragraphs(n), t.normalize_text)
    assert got == ("\n\n" if n == 6 else " ").join(f"Absatz Nummer {i} hier" for i in kept)


def test_corrected_edges_count_a_line_once(spark):
    assert one(spark, paragraphs(7), lambda c: t.normalize_text(c, corrected=True)) == paragraphs(7)
    lines = "\n".join(["Kopf der Seite", *(f"Zeile {i}" for i in range(12)), "Kopf der Seite"])
    assert "Kopf" not in one(spark, lines, lambda c: t.normalize_text(c, corrected=True))


def test_scores(spark):
    df = spark.createDataFrame([("hola mundo", "Hola", ""), ("", "", "x")], "a string, b string, c string")
    got = df.select(t.token_jaccard(F.col("a"), F.col("b")), t.length_score(F.col("a"), F.col("b")), sim.text_ratio("a", "b")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.4, 2 * 4 / 14), (0.0, 0.0, 1.0)]
    assert (sim.similarity("tide", "diet"), sim.similarity("diet", "tide")) == (0.25, 0.5)
    at = spark.range(1).select(t.position_score(F.lit(1), F.lit(3), F.lit(0), F.lit(1)), t.position_score(F.lit(0), F.lit(1), F.lit(0), F.lit(1)))
    assert tuple(at.head()) == (0.5, 1.0)


def test_small_functions(spark):
    assert one(spark, "Seite 12 von 30", t.repetition_key) == "seite # von #" and one(spark, " 7 ", t.repetition_key) == ""
    assert one(spark, "ab1 ", t.alpha_ratio) == 0.5
    assert one(spark, "hallo welt", t.estimate_tokens) == 3 and one(spark, "  ", t.estimate_tokens) == 0
    assert one(spark, ["ab", None, "x y z"], t.estimate_message_tokens, "array<string>") == 1 + 12 + 12 + 4 + 12
    assert one(spark, "x" * 100, lambda c: t.excerpt(c, 60)).asDict() == {"text": "x" * 14 + "\n[...texto truncado...]\n" + "x" * 14, "truncated": True}
    assert one(spark, "INSERTADO ", t.change_type) == "añadido" and one(spark, "?", t.change_type) is None
    assert one(spark, "huh", t.severity) == "media" and one(spark, "CRÍTICA", t.severity) == "critica"
    assert one(spark, "12", t.optional_int) == 12 and one(spark, "", t.optional_int) is None and one(spark, "x", t.optional_int) is None
    assert one(spark, "a.b.TXT", t.file_extension) == "txt" and one(spark, "ohne", t.file_extension) == ""
    assert one(spark, "aB1", t.password_classes).asDict() == {"lower": True, "upper": True, "digit": True, "symbol": False}
    assert sim.folded("Ébène,  x_1!") == "ebene x_1"


def test_segments_merge(spark):
    parts = [("equal", "a"), ("equal", "b"), ("insert", ""), ("odd", "c"), ("delete", "d"), ("delete", "e")]
    got = one(spark, parts, t.merged_segments, "array<struct<type: string, text: string>>")
    assert [tuple(x) for x in got] == [("equal", "abc"), ("delete", "de")]


def test_word_diff_gives_both_sides_back():
    a, b = sim.word_diff("a b c", "a x c")
    assert [(x["type"], x["text"]) for x in a] == [("equal", "a "), ("delete", "b"), ("equal", " c")]
    assert [(x["type"], x["text"]) for x in b] == [("equal", "a "), ("insert", "x"), ("equal", " c")]
    assert sim.word_diff("", "neu") == ([], [{"type": "insert", "text": "neu"}]) and sim.word_diff(None, None) == ([], [])


def test_noise_equivalence():
    assert sim.noise_equivalent("Él  dijo: sí", "el dijo si") and not sim.noise_equivalent("a", "") and sim.noise_equivalent("--", "..")
    assert not sim.noise_equivalent("der hund ist gross", "die katze ist klein")


def test_python_steps_take_few_rows_at_a_time():
    texts = [str(k) * (300_000 if k == 70 else 40_000 if k > 70 else 1) for k in range(150)]
    got = list(slices(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])])))
    assert [x for batch in got for x in batch.column(0).to_pylist()] == texts
    assert all(b.num_rows <= 64 and (b.num_rows == 1 or b.nbytes <= 1 << 20) for b in got) and len(got) < 20


def test_fixed_chunks_take_time_in_proportion_to_the_text(spark):
    import time

    from docdelta.operators import segment

    text = "aä😀\n" * 1_000_000 + "z"
    rows = spark.createDataFrame([(text,), ("",), (None,), ("x" * 250,)], "t string").select(segment.fixed_chunks(F.col("t")).alias("s"))
    began = time.monotonic()
    found = [[(x["index"], x["text"], x["start_char"], x["end_char"]) for x in r.s] for r in rows.collect()]
    assert time.monotonic() - began < 12
    assert found == [[(i, x[s : s + 250], s, min(s + 250, len(x))) for i, s in enumerate(range(0, len(x), 250))] for x in (text, "", "", "x" * 250)]


def test_plain_texts_keep_the_full_normal_form(spark, monkeypatch):
    texts = ["", " ", "a", "una frase sin más", " a", "a ", "a  b", "a-b", "page 3", "Página 12", "HOJA ٣", "page 3 de 4", "1 2 3", "1. uno", "a) uno", "iv", "año\u00a0nuevo", "e\u0301", "x\ny", "x\n", "日本 語", "\U00020000 x", "---", "x_y", "\u2028", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    quick = {x.i: x.n for x in rows.select("i", t.normalize_text(F.col("t")).alias("n")).collect()}
    monkeypatch.setattr(t, "UNEVEN", "")  # no text is plain then
    assert quick == {x.i: x.n for x in rows.select("i", t.normalize_text(F.col("t")).alias("n")).collect()}
