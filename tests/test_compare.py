import json
import random

import pytest
from pyspark.sql import functions as F

from docdelta.operators import align, decide, layout, metrics, postprocess, segment, view
from docdelta.plans import compare


def units(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(segment.sentence_units(F.col("t"))).head()[0]


def test_units(spark):
    assert units(spark, "Uno. Dos.\n\nTres cuatro cinco.") == ["Uno. Dos.", "Tres cuatro cinco."]
    assert units(spark, "1.\nTITULO GRANDE\nEs una frase. Otra frase larga: si; no.") == ["TITULO GRANDE", "Es una frase.", "Otra frase larga: si; no."]
    assert units(spark, "Una frase bastante larga. Fin.") == ["Una frase bastante larga. Fin."] and units(spark, None) == [] and units(spark, "Hola.") == ["Hola."]


def test_windows_go_back_and_end_in_a_staircase():
    found = segment.windows("aa. bb. cc.", ["aa.", "bb.", "cc."])
    assert [x["text"] for x in found] == ["aa. bb. cc.", "bb. cc.", "cc."] and [(x["start_char"], x["end_char"]) for x in found] == [(0, 11), (4, 11), (8, 11)]
    pieces = [" ".join(f"w{i}.{j}" for j in range(20)) + "." for i in range(20)]
    found = segment.windows(" ".join(pieces), pieces)
    assert all(110 <= len(x["text"].split()) <= 138 for x in found[:3]) and found[-1]["text"] == pieces[-1]
    assert [segment.word_budget(x) for x in (550, 250, 1200)] == [(110, 138), (50, 62), (120, 120)]
    assert segment.windows("", []) == [] and len(segment.windows("a b", ["a", "b"], overlap_chars=0)) == 1


def test_prepared_documents(spark):
    docs = spark.createDataFrame([(1, "Uno.\nDos.\n\nTres."), (2, None), (3, "x" * 600)], "doc_id long, text string")
    got = {r.doc_id: (r.clean_text, [(s.text, s.start_char, s.end_char) for s in r.segments]) for r in compare.prepared(docs).collect()}
    assert got[1] == ("Uno. Dos.\n\nTres.", [("Uno. Dos. Tres.", 0, 16), ("Tres.", 11, 16)]) and got[2] == ("", []) and len(got[3][1]) == 1


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice("uno dos tres cuatro cinco seis siete ocho nueve diez once doce".split()) for _ in range(r.randrange(3, 14))) for _ in range(n)]


def tiled(a, b, tile=3):
    """The alignment by tiles, as tasks make it."""
    align.TILE, before = tile, align.TILE
    try:
        moves = [x for i in range(0, len(a), tile) for j in range(0, len(b), tile) for x in align.tile_gains(a[i : i + tile + 1], b[j : j + tile + 1], i, j, len(a), len(b))]
        return align.align_settled(len(a), len(b), moves)
    finally:
        align.TILE = before


@pytest.mark.parametrize("seed", range(25))
def test_lazy_alignment_equals_full_evaluation(seed):
    r = random.Random(seed)
    a = texts(seed, r.randrange(1, 8))
    b = [x if r.random() < 0.6 else texts(seed + 100, 1)[0] for x in a for _ in range(r.choice((1, 1, 0)))]
    if len(b) > 2:
        b[0:2] = [f"{b[0]} {b[1]}"]
    b += texts(seed + 200, r.randrange(2))
    lazy, full = align.align_lazily(a, b), align.align_fully(a, b)
    assert lazy == full == tiled(a, b)
    for side, n in (("a_indices", len(a)), ("b_indices", len(b))):
        assert [i for p in lazy for i in p[side]] == list(range(n))


def test_alignment_edges():
    assert align.align_lazily(["x"], ["x"]) == [{"a_indices": [0], "b_indices": [0], "alignment_score": 1.0, "match_reason": "1:1"}]
    assert [p["match_reason"] for p in align.align_lazily(["x"], [])] == ["gap_b"] and [p["match_reason"] for p in align.align_lazily([], ["x"])] == ["gap_a"]
    assert align.align_lazily([], []) == []
    long = "el contrato entra en vigor el primer dia del mes siguiente", "y termina cuando ambas partes lo decidan por escrito"
    assert [p["match_reason"] for p in align.align_lazily(list(long), [" ".join(long)])] == ["2:1_merge_a"]


def test_orphans_swap():
    pair = lambda a, b: {"a_indices": a, "b_indices": b}
    assert align.swap_orphans([pair([], [0]), pair([0], [1]), pair([1], [2])], ["x", "x", "y"]) == [pair([0], [1]), pair([], [0]), pair([1], [2])]


def test_labels(spark):
    rows = [("j", 1, [0], [0], 1.0), ("j", 2, [1, 2], [1], 0.7), ("j", 3, [], [2], 0.0), ("j", 4, [3], [2], 0.9), ("k", 1, [0], [], 0.0)]
    pairs = spark.createDataFrame(rows, "job_id string, pair_index int, a_indices array<int>, b_indices array<int>, alignment_score double")
    got = [(r.job_id, r.pair_type, r.reanchored, r.match_confidence) for r in align.labelled(pairs).orderBy("job_id", "pair_index").collect()]
    assert got == [("j", "matched", False, "alta"), ("j", "reanchored", True, "media"), ("j", "orphan_b", False, "alta"), ("j", "matched", False, "alta"), ("k", "orphan_a", False, "alta")]


BASE = "El contrato de arrendamiento entra en vigor el primer dia del mes. Las partes firman dos copias iguales del documento. El pago se realiza cada trimestre sin demora."


def test_the_whole_chain(spark):
    docs = spark.createDataFrame([(1, BASE), (2, BASE), (3, BASE.replace("dos copias", "nueve ejemplares completos y sellados")), (4, ""), (5, "Otro texto."), (6, BASE.upper())], "doc_id long, text string")
    pairs = spark.createDataFrame([("same", 1, 2), ("edit", 1, 3), ("gone", 5, 4), ("none", 4, 4), ("case", 1, 6)], "job_id string, doc_a long, doc_b long")
    decided = compare.compared(docs, pairs)
    rows = compare.change_rows(decided)
    got = {(r.job_id, r.change_type, r.result_origin, r.text_a, r.text_b) for r in rows.collect()}
    assert ("gone", "eliminado", "heuristic", "Otro texto.", "") in got and {x[0] for x in got} == {"edit", "gone"}
    assert any(x[1] == "modificado" and x[2] == "fallback" and "nueve" in x[4] for x in got)
    status = {r.job_id: (r.status, r.rows > 0) for r in compare.job_meta(decided, rows, pairs).collect()}
    assert status == {"same": ("done", False), "edit": ("done_with_warnings", True), "gone": ("done", True), "none": ("done", False), "case": ("done", False)}


def test_model_answers_and_cache(spark):
    docs = spark.createDataFrame([(1, "Primera frase con numero 111 aqui dentro."), (2, "Primera frase distinta que cambia mucho, ciento.")], "doc_id long, text string")
    pairs = spark.createDataFrame([("j", 1, 2)], "job_id string, doc_a long, doc_b long")
    answer = '{"choices": [{"message": {"content": "<think>x</think> ```json\\n{\\"diffs\\": [{\\"type\\": \\"changed\\", \\"before\\": \\"111\\", \\"severity\\": \\"high\\"},{\\"type\\": \\"??\\"}]}\\n```"}}]}'

    def client():
        return lambda prompt: answer if prompt[0]["role"] == "system" else None

    found = compare.compared(docs, pairs, model=client).where("decided is null").select("row_source", F.explode("changes").alias("c")).collect()
    assert {(r.row_source, r.c.change_type, r.c.source_a, r.c.severity, r.c.confidence) for r in found} <= {("llm", "modificado", "111", "alta", "media")}


def test_json_cascade():
    one = [{"change_type": "añadido", "source_a": "", "source_b": "b", "summary": "", "evidence": "", "confidence": "media", "severity": "media", "anchor_a": None, "anchor_b": 2}]
    wrap = lambda c: '{"choices": [{"message": %s}]}' % c  # noqa: E731, UP031
    for message in ('{"content": {"changes": [{"kind": "new", "after": "b", "anchor_a": 0, "index_b": "2"}]}}', '{"content": null, "reasoning_content": "{\'rows\': [{\'action\': \'added\', \'b\': \'b\', \'anchor_b\': 2}],}"}',
                    '{"tool_calls": [{"function": {"arguments": "{\\"items\\": [{\\"change\\": \\"addition\\", \\"text_b\\": \\"b\\", \\"anchor_b\\": 2},]}"}}]}'):
        assert decide.response_changes(wrap(message)) == one
    assert decide.response_changes(wrap('{"content": "nada"}')) is None and decide.response_changes(None) is None and decide.response_changes(wrap('{"content": {}}')) == []


def rows_of(spark, rows):
    names = "job_id string, block_id int, change_type string, text_a string, text_b string, summary string"
    return spark.createDataFrame(rows, names).withColumns({"display_text_a": F.lit("zeige"), "display_text_b": F.lit(""), **{c: F.lit("x") for c in ("confidence", "severity", "llm_comment", "pair_id")}})


def test_deduplication(spark):
    got = postprocess.deduplicated(rows_of(spark, [("j", 1, "mod", "A  b", "x", "s"), ("j", 2, "mod", "a b", "x", "longer"), ("j", 3, "mod", "zz a b cc", "xy", "t"), ("j", 4, "new", "a b", "x", "u"), ("k", 1, "mod", "a b", "x", "s"), ("j", 5, "mod", "", "", "v")]))
    assert sorted((r.job_id, r.block_id, r.summary) for r in got.collect()) == [("j", 1, "longer"), ("j", 4, "u"), ("j", 5, "v"), ("k", 1, "s")]
    again = postprocess.deduplicated(got)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_reconciliation(spark):
    rows = rows_of(spark, [("j", 4, "mod", "a", "b", "s")])
    changes = spark.createDataFrame([("j", 1, "mod", " zeige ", "", "dup", "m", "m", "e"), ("j", 2, "new", "neu", "q", "n", "m", "m", "e")], "job_id string, ord int, change_type string, source_a string, source_b string, summary string, confidence string, severity string, evidence string")
    got = postprocess.reconciled(rows, changes).collect()
    assert sorted((r.block_id, r.pair_id) for r in got) == [(4, "x"), (5, "reconcile-5")]


def test_pages_and_states(spark):
    rows = spark.range(10).select(F.col("id").cast("int").alias("block_id"), F.lit("alta").alias("severity"))
    assert tuple(view.pagination(rows, 8, 5).head()) == (10, 2, False, None, True) and tuple(view.pagination(rows).head()) == (10, 10, False, None, False)
    assert [r.block_id for r in view.page(rows, 8, 5).collect()] == [8, 9]
    status = lambda p, f, w: spark.range(1).select(metrics.result_status(F.lit(p), F.lit(f), F.lit(w))).head()[0]
    assert [status(0, 0, 0), status(3, 0, 1), status(2, 1, 0), status(9, 1, 0)] == ["done", "done_with_warnings", "error", "done_with_warnings"]
    assert [spark.range(1).select(metrics.progress_percent(F.lit(x), F.lit(3))).head()[0] for x in (1, 3)] == [45, 95]
    failed = spark.createDataFrame([("j", i, i in (1, 2, 3)) for i in range(1, 5)], "job_id string, pair_index int, failed boolean")
    assert metrics.until_failed(failed).count() == 0 and metrics.until_failed(failed, 0.9).count() == 1


def test_layout(spark):
    rows = [(1, 0, "Kopf", 1, "header"), (1, 1, "Eins  zwei", 1, "paragraph"), (1, 2, "", 1, "page_break"), (1, 3, "Zeile", 2, "line"), (1, 4, "Zeile", 2, "line"), (2, 0, "nur dies", None, "line")]
    blocks = spark.createDataFrame(rows, "doc_id long, seq int, text string, page int, block_type string").withColumns({"drop_in_canonical": F.col("doc_id") == 2, "is_repeated_header": F.lit(False), "is_repeated_footer": F.lit(False)})
    got = {r.doc_id: r.text for r in layout.canonical_text(blocks).collect()}
    assert got == {1: "Kopf\n\nEins zwei\n\nZeile\nZeile", 2: "nur dies"}
    q = layout.quality_signals(blocks).where("doc_id = 1").head()
    assert (q.block_count, q.canonical_block_count, q.duplicate_block_ratio, q.header_footer_density) == (5, 4, 0.25, 0.25)


def test_repeated_headers_of_pages(spark):
    box = lambda y0, y1: (0.0, y0, 10.0, y1)
    rows = [(1, p * 3 + i, t, p, "paragraph", "pdf", box(*y), False, False, False) for p in (1, 2, 3) for i, (t, y) in enumerate([(f"Informe {p}", (5.0, 10.0)), ("Texto propio" + "!" * p, (40.0, 50.0)), (f"pie {p}", (92.0, 96.0))])]
    from docdelta.schemas import LAYOUT

    heights = spark.createDataFrame([(1, p, 100.0) for p in (1, 2, 3)], "doc_id long, page int, height double")
    got = layout.mark_repeated(spark.createDataFrame(rows, LAYOUT), heights).orderBy("seq").collect()
    assert [r.block_type for r in got] == ["header", "paragraph", "footer"] * 3 and [r.drop_in_canonical for r in got] == [True, False, True] * 3


def test_page_lines_and_groups(spark):
    span = "doc_id long, page int, block int, line int, span int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>"
    rows = [(1, 1, 0, 0, i, t, (x, 40.0, x + 5, 45.0)) for i, (t, x) in enumerate([("a", 0.0), ("b", 40.0), ("c", 80.0)])] + [(1, 1, 1, 0, 0, "- punto", (0.0, 50.0, 9.0, 55.0)), (1, 1, 2, 0, 0, "Titulo", (0.0, 2.0, 9.0, 8.0))]
    lines = layout.page_lines(spark.createDataFrame(rows, span))
    groups = layout.page_groups(lines, spark.createDataFrame([(1, 1, 100.0)], "doc_id long, page int, height double"))
    assert {r.text: r.block_type for r in groups.collect()} == {"a b c": "table_row", "- punto": "list_item", "Titulo": "header"}


def test_patient_model():
    """Failed calls are tried again, unusable answers asked for without JSON mode, long prompts not sent."""
    good = json.dumps({"choices": [{"message": {"content": '{"changes": []}'}}]})
    prompt = [{"role": "user", "content": "uno dos tres"}]

    def run(answers, **options):
        bodies, pauses, left = [], [], list(answers)

        def post(body):
            bodies.append(body)
            if isinstance(x := left.pop(0), Exception):
                raise x
            return x

        try:
            got = decide.patient(post, "m", sleep=pauses.append, **options)(prompt)
        except Exception as e:
            got = type(e)
        return got, ["response_format" in b for b in bodies], pauses

    assert run([good]) == (good, [True], [])
    assert run([OSError(), OSError(), good]) == (good, [True] * 3, [0.7, 1.4])
    assert run([OSError()] * 4, attempts=4) == (decide.ResponseError, [True] * 4, [0.7, 1.4, 2.0])
    assert run([KeyError("x"), good]) == (good, [True] * 2, [0.7])
    assert run(["nothing of use", good]) == (good, [True, False], [])
    assert run(["nothing", OSError(), "nothing"]) == (decide.ResponseError, [True, False, False], [0.7])
    assert run([good], window=1800) == (decide.PromptTooLong, [], [])
    assert decide.prompt_tokens([{"content": "uno dos tres"}, {"content": " "}]) == 28 and decide.request_body(prompt, "m", False)["max_tokens"] == 1800


@pytest.mark.parametrize("seed", range(6))
def test_nested_rows_by_index(seed):
    """The index finds what a look at every kept pair finds."""
    r = random.Random(seed)
    words = "uno dos tres x yy zzz contrato".split()
    text = lambda: r.choice(["", "", r.choice(words), " ".join(r.choices(words, k=r.randrange(1, 7))), "".join(r.choices("ab", k=r.randrange(9)))])
    index, kept = postprocess.Kept(), []
    for _ in range(600):
        x, y = text(), text()
        want = any((p or q) and ((x in p and y in q) or (p in x and q in y)) for p, q in kept)
        assert index.nested(x, y) == want
        if not want:
            kept.append((x, y))
            index.add(x, y)
    assert len(kept) > 20


def test_a_large_job_takes_time_in_proportion():
    import time

    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    vocabulary = [word() for _ in range(3000)]
    rows = [(" ".join(r.choices(vocabulary, k=15)), " ".join(r.choices(vocabulary, k=15))) for _ in range(8000)]

    def seconds(n):
        began, index = time.process_time(), postprocess.Kept()
        for x, y in rows[:n]:
            if not index.nested(x, y):
                index.add(x, y)
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 4 * 2.5 * max(seconds(2000), 0.05)


def test_nested_rows_with_odd_columns(spark):
    rows = rows_of(spark, [("j", 1, "mod", "abc def", "x", "s"), ("j", 2, "mod", "abc", "x", "t"), (None, 1, "mod", "abc", None, "t"), ("j", 3, None, "abc", "x", "t")])
    rows = rows.withColumn("a.b", F.lit(1)).withColumn("c`d", F.array(F.lit("x"))).withColumn("i0", F.lit("own")).withColumn("__a", F.lit(2))
    got = postprocess.dedupe_nested(rows)
    assert got.columns == rows.columns and sorted((str(r.job_id), r.block_id, str(r.change_type)) for r in got.collect()) == [("None", 1, "mod"), ("j", 1, "mod"), ("j", 3, "None")]
    assert postprocess.dedupe_nested(rows.limit(0)).count() == 0


def test_segments_beside_odd_columns(spark):
    docs = spark.createDataFrame([(1, "Uno dos. Tres cuatro cinco seis.", "x", 1, (2,)), (2, None, None, None, None), (3, "", "y", 3, (4,))], "doc_id long, clean_text string, segments string, `__text` int, `c``d` struct<`e f`: int>").withColumn("a.b", F.lit(1))
    got = segment.segmented(docs)
    assert got.columns == ["doc_id", "clean_text", "segments_input", "__text", "c`d", "a.b", "segments"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows[1].segments) == 1 and rows[1].segments_input == "x" and rows[2].segments == [] and rows[3]["c`d"] == (4,)
    assert segment.segmented(docs.limit(0)).count() == 0


def test_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 5.0]), (4, None), (5, [None, 1.0]), (6, []), (7, [float("nan"), 1.0]), (8, [1.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.cosine) for r in view.top_similar_each(vectors, vectors.where("vec_id < 3"), k=2).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (8, 0.995037), (2, 1): (1, 1.0), (2, 2): (8, 0.995037)}
    assert view.top_similar_each(vectors.limit(0), vectors, k=2).count() == 0
