"""PDF and RTF files made here, read back."""

import zlib

import pytest
from pyspark.sql import functions as F

from docdelta.sources import files, pdf, rtf


def pdf_file(contents, font="/Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding", more=(), packed=True, objects_packed=False, trailer=""):
    """A file with a page for each content stream (text operators)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< %s >>" % font.encode()}
    streams, kids = {}, []
    for k, content in enumerate(contents):
        page, body = 10 + 2 * k, 11 + 2 * k
        kids.append(f"{page} 0 R")
        objects[page] = f"<< /Type /Page /Parent 2 0 R /Contents {body} 0 R >>".encode()
        data = content.encode("latin-1")
        streams[body] = (b"/Filter /FlateDecode", zlib.compress(data)) if packed else (b"", data)
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    objects |= dict(more)
    out = b"%PDF-1.5\n%\xe2\xe3\n"
    if objects_packed:
        texts, heads, at = [], [], 0
        for n, text in objects.items():
            heads.append(f"{n} {at}")
            texts.append(text + b" ")
            at += len(text) + 1
        head = " ".join(heads).encode() + b" "
        data = zlib.compress(head + b"".join(texts))
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(texts), len(head), len(data)) + data + b"\nendstream endobj\n"
    else:
        for n, text in objects.items():
            out += b"%d 0 obj\n" % n + text + b"\nendobj\n"
    for n, (extra, data) in streams.items():
        out += b"%d 0 obj << %s /Length %d >>\nstream\n" % (n, extra, len(data)) + data + b"\nendstream\nendobj\n"
    return out + f"trailer << /Root 1 0 R {trailer} >>\n%%EOF".encode()


def line(x, y, text, size=10):
    return f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n"


def texts(data):
    return [(r["page"], r["block"], r["line"], r["span"], r["text"]) for r in pdf.spans(data)]


PAGE = line(50, 700, "Erste Zeile") + line(50, 688, "zweite Zeile") + line(50, 600, "Neuer Absatz")


@pytest.mark.parametrize(("packed", "objects_packed"), [(True, True), (True, False), (False, False)])
def test_lines_and_blocks(packed, objects_packed):
    assert texts(pdf_file([PAGE, line(50, 700, "Seite zwei")], packed=packed, objects_packed=objects_packed)) == [(1, 0, 0, 0, "Erste Zeile"), (1, 0, 1, 0, "zweite Zeile"), (1, 1, 0, 0, "Neuer Absatz"), (2, 0, 0, 0, "Seite zwei")]


def test_operators_and_boxes():
    content = r"BT /F1 10 Tf 12 TL 1 0 0 1 50 700 Tm (a\(b\)\\ \351\)) Tj T* [(Wo) -20 (rt) -300 (zwei)] TJ (next) ' ET q 2 0 0 2 0 0 cm BT /F1 10 Tf 25 300 Td <48 69> Tj ET Q BI /W 1 ID \x00\x01 EI BT /F1 10 Tf 300 700 Td (rechts) Tj ET"
    got = [(r["text"], round(r["bbox"]["x0"]), round(r["bbox"]["y0"]), round(r["bbox"]["y1"])) for r in pdf.spans(pdf_file([content]))]
    assert got == [("a(b)\\ é)", 50, 92, 102), ("Wort zwei", 50, 104, 114), ("next", 50, 116, 126), ("Hi", 50, 184, 204), ("rechts", 300, 92, 102)]


def test_fonts():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> <0010> <0011> [<00660069> <D83DDE00>] endbfrange"
    more = {4: b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [1 [250 300] 3 4 700] >>", 5: b"<< /Length %d >> stream\n" % len(cmap) + cmap + b"\nendstream"}
    font = "/Type /Font /Subtype /Type0 /DescendantFonts [4 0 R] /ToUnicode 5 0 R"
    (got,) = pdf.spans(pdf_file(["BT /F1 10 Tf 0 0 Td <0001000200030010001100FF> Tj ET"], font, more))
    assert got["text"] == "Abcfi😀" and got["bbox"]["x1"] == pytest.approx(10 * (0.25 + 0.3 + 0.7 + 0.5 + 0.5 + 0.5))
    font = "/Type /Font /Subtype /Type1 /FirstChar 65 /Widths [1000 200] /Encoding << /Differences [65 /bullet /uni00E9 /x] >>"
    (got,) = pdf.spans(pdf_file(["BT /F1 10 Tf 5 0 Td (ABC) Tj ET"], font))
    assert got["text"] == "•éx" and got["bbox"]["x1"] == pytest.approx(5 + 10 + 2 + 5)


def test_forms_and_predictors():
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 0] /Length 40 /Resources << /Font << /F1 3 0 R >> >> >> stream\nBT /F1 10 Tf 5 700 Td (im Formular) Tj ET\nendstream"
    page = {10: b"<< /Type /Page /Parent 2 0 R /Contents 11 0 R /Resources << /XObject << /X 6 0 R >> >> >>", 6: form}
    (got,) = pdf.spans(pdf_file(["/X Do"], more=page))
    assert got["text"] == "im Formular" and got["bbox"]["x0"] == 15
    rows = [[1, 2, 3, 4], [1, 3, 3, 9], [7, 7, 7, 7], [0, 255, 1, 2], [5, 5, 6, 6]]
    packed, before = b"", [0] * 4
    for kind, row in enumerate(rows):
        around = lambda k, row=row, before=before: (row[k - 1] if k else 0, before[k], before[k - 1] if k else 0)
        paeth = lambda a, b, c: min((abs(a + b - c - x), n, x) for n, x in enumerate((a, b, c)))[2]
        guess = [(0, a, b, (a + b) // 2, paeth(a, b, c))[kind] for a, b, c in map(around, range(4))]
        packed += bytes([kind, *((x - g) % 256 for x, g in zip(row, guess, strict=True))])
        before = row
    assert pdf._unpredicted(packed, {"Predictor": 15, "Columns": 4}) == bytes(x for r in rows for x in r)


@pytest.mark.parametrize(("data", "reason"), [(b"kein PDF", "not a PDF"), (b"%PDF-1.4\n", "no catalog"), (pdf_file([PAGE], trailer="/Encrypt 9 0 R"), "encrypted"), (pdf_file([PAGE]).replace(b"FlateDecode", b"LZWDecode"), "filter LZWDecode"), (b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", "no pages")])
def test_reasons(spark, data, reason):
    rows = files.pdf_spans(spark.createDataFrame([("x.pdf", ".pdf", data)], "path string, extension string, content binary")).collect()
    assert [(r.path, r.page, r.reason) for r in rows] == [("x.pdf", None, reason)]


def test_any_bytes_give_a_reason_or_rows(spark):
    import random

    r, good = random.Random(1), pdf_file([PAGE] * 2, objects_packed=True)
    rows = []
    for k in range(150):
        data = bytearray(good)
        for _ in range(r.randrange(1, 30)):
            data[r.randrange(8, len(data))] = r.randrange(256)
        rows.append((f"{k}.pdf", ".pdf", bytes(data[: r.randrange(8, len(data) + 1)])))
    got = files.pdf_spans(spark.createDataFrame(rows, "path string, extension string, content binary"))
    assert got.select("path").distinct().count() == 150


RTF = rb"""{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}{\info{\author y}}\pard Uno \b dos\b0\par - Punkt {\i caf\'e9}\par
\uc1 Zahl \u8364?, \u-10179?\u-8704?\line neue Zeile\par\page\trowd\cellx100\cellx200 A\cell B \par b\cell\row\trowd C\cell\cell\row\pard Ende \{x\} \\ \~z}"""


def test_rtf_paragraphs():
    assert list(rtf.paragraphs(RTF)) == [("paragraph", "Uno dos"), ("paragraph", "- Punkt café"), ("paragraph", "Zahl €, 😀\nneue Zeile"), ("page_break", ""), ("table_row", "A | B  b"), ("table_row", "C"), ("paragraph", "Ende {x} \\  z")]
    assert list(rtf.paragraphs(rb"{\rtf1\ansicpg1251 \'cf\'f0}")) == [("paragraph", "Пр")] and list(rtf.paragraphs(b"{\\rtf1}")) == []
    with pytest.raises(rtf.NotRtf):
        list(rtf.paragraphs(b"x"))


def test_layout_of_files(spark, tmp_path):
    head = lambda k: line(50, 780, f"Informe {k}")
    row = "".join(line(x, 500, t) for x, t in ((50, "a"), (150, "b"), (250, "c")))
    (tmp_path / "a.pdf").write_bytes(pdf_file([head(1) + PAGE + row, head(2) + line(50, 400, "- Punkt"), ""]))
    (tmp_path / "b.rtf").write_bytes(RTF)
    (tmp_path / "c.pdf").write_bytes(b"kein PDF")
    found = files.read_files(spark, f"file://{tmp_path}")
    blocks = files.read_layout(found).withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name", "seq").collect()
    assert [(r.block_type, r.text, r.page) for r in blocks if r.name == "a.pdf" and not r.drop_in_canonical] == [("paragraph", "Erste Zeile zweite Zeile", 1), ("paragraph", "Neuer Absatz", 1), ("table_row", "a b c", 1), ("list_item", "- Punkt", 2)]
    assert [(r.text, r.is_repeated_header) for r in blocks if r.name == "a.pdf" and r.block_type == "header"] == [("Informe 1", True)] * 2 + [("Informe 2", True)] * 2
    assert sum(r.block_type == "page" for r in blocks) == 3
    assert [(r.block_type, r.text) for r in blocks if r.name == "b.rtf" and not r.drop_in_canonical][:2] == [("paragraph", "Uno dos"), ("list_item", "- Punkt café")]
    out = {r.path.rpartition("/")[2]: r for r in files.extracted(found).collect()}
    assert out["a.pdf"].text.startswith("Erste Zeile zweite Zeile") and (out["a.pdf"].engine_used, out["b.rtf"].engine_used, out["c.pdf"].text) == ("pdf", "docx", "")
    assert files.validate("x.pdf") == ".pdf" and files.validate("y.RTF") == ".rtf"


def test_values_are_read_by_runs():
    import time

    from docdelta.sources import pdf

    reader = pdf.Reader(b"% note\n 1 0 R 12 -.5 1e2 true null/N#41me(a(b)\\051\\n)<4>[1 /X]>> Tj % end")
    found = []
    while (x := reader.value()) != b"":
        found.append((type(x).__name__, x))
    assert found == [
        ("Ref", 1), ("int", 12), ("float", -0.5), ("int", 100), ("bool", True), ("NoneType", None), ("Name", "NAme"), ("bytes", b"a(b))\n"), ("bytes", b"@"), ("list", [1, "X"]), ("Keyword", b">>"), ("Keyword", b"Tj"),
    ]
    began = time.process_time()
    assert len(pdf.Reader(b" " * 4_000_000 + b"(" + b"x" * 4_000_000 + b")").value()) == 4_000_000
    assert time.process_time() - began < 0.5
