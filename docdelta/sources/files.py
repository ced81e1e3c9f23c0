"""Files as documents and layout blocks, and results as files."""

from __future__ import annotations

import importlib.util
import io
import itertools
import re
import shutil
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docdelta.functions.text import LIST_PREFIX
from docdelta.checkpoint import written
from docdelta.columns import slices
from docdelta.operators import layout
from docdelta.schemas import LAYOUT
from docdelta.sources import pdf, rtf

# Suffixes by kind, engines, and the quality that each format starts from.
ALWAYS = (".txt", ".pdf", ".docx", ".xlsx", ".pptx")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
LEGACY = (".doc", ".xls", ".rtf")
ENGINES = ("auto", "builtin", "docling")
BASE_QUALITY = {"text": 1.0, "docx": 0.98, "xlsx": 0.96, "pptx": 0.95, "pdf": 0.93, "docling": 0.94, "rapidocr": 0.75, "tesseract": 0.68}
MAX_BYTES = 40 << 20
#: Blocks that a reader hands on at a time.
HANDED_ON = 2000

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_LIST = re.compile(LIST_PREFIX.replace("(?iU)", ""), re.I)


class UnsupportedFormat(ValueError):
    """The suffix or the engine can't be read."""


def capabilities() -> dict:
    """What this installation reads: suffixes, engines, and which optional parts are there."""
    have = lambda name: importlib.util.find_spec(name) is not None
    ocr = "rapidocr" if have("rapidocr_onnxruntime") else "tesseract" if have("pytesseract") and shutil.which("tesseract") else None
    office = shutil.which("soffice") is not None
    extensions = [*ALWAYS, ".rtf", *(IMAGES if ocr else ()), *(x for x in LEGACY if office and x != ".rtf")]
    return {"extensions": sorted(extensions), "engines": [x for x in ENGINES if x != "docling" or have("docling")], "ocr": ocr, "soffice": office, "pdf": True}


def validate(name: str, engine: str = "auto") -> str:
    """The suffix of a file that can be read, else UnsupportedFormat."""
    suffix = f".{name.rpartition('.')[2].lower()}" if "." in name else ""
    able = capabilities()
    if engine not in ENGINES or engine not in able["engines"]:
        raise UnsupportedFormat(f"engine {engine} is not available")
    if engine == "docling" and suffix != ".pdf":
        raise UnsupportedFormat("docling reads .pdf alone")
    if suffix not in able["extensions"]:
        raise UnsupportedFormat(f"{suffix or name} can't be read here")
    return suffix


def read_files(spark: SparkSession, path: str, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, name, extension, length, content) of the files under path that are neither empty nor too large."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), "length", "content")


@F.pandas_udf(T.StringType())
def _western(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8: cp1252, or latin-1 for bytes that it leaves open."""

    def one(data: bytes) -> str:
        try:
            return bytes(data).decode("cp1252")
        except UnicodeDecodeError:
            return bytes(data).decode("latin-1")

    return content.map(one)


def read_text(files: DataFrame) -> DataFrame:
    """files with text instead of content. A byte-order mark stays; bytes that are not UTF-8 are western."""
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(utf8).withColumn("text", F.decode("content", "UTF-8"))
    return good.unionByName(files.where(~utf8).withColumn("text", _western("content"))).drop("content")


def _block(text: str, kind: str, engine: str, drop: bool = False) -> dict:
    return {"text": text, "block_type": kind, "source_engine": engine, "drop_in_canonical": drop}


def _docx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = E.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in E.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                names[s.get(f"{_W}styleId")] = (s.find(f"{_W}name").get(f"{_W}val") or "").lower() if s.find(f"{_W}name") is not None else ""

    def text_of(p: E.Element) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()).strip()

    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = [" ".join(t for p in cell.iter(f"{_W}p") if (t := text_of(p))) for cell in row.iter(f"{_W}tc")]
                if text := " | ".join(x for x in cells if x):
                    yield _block(text, "table_row", "docx")
        elif node.tag == f"{_W}p":
            if any(x.get(f"{_W}type") == "page" for x in node.iter(f"{_W}br")):
                yield _block("", "page_break", "docx")
            text, properties = text_of(node), node.find(f"{_W}pPr")
            style = properties.find(f"{_W}pStyle") if properties is not None else None
            style = names.get(style.get(f"{_W}val"), style.get(f"{_W}val").lower()) if style is not None else ""
            if text:
                numbered = properties is not None and properties.find(f"{_W}numPr") is not None
                listed = numbered or any(x in style for x in ("list", "bullet", "number")) or _LIST.match(text)
                yield _block(text, "header" if style.startswith(("heading", "title")) else "list_item" if listed else "paragraph", "docx")
                yield from (_block(x, "line", "docx", True) for line in text.splitlines() if (x := line.strip()))
            if properties is not None and properties.find(f"{_W}sectPr") is not None:
                yield _block("", "section_break", "docx")


def _xlsx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in E.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            yield _block(sheet.get("name"), "header", "xlsx")
            target = targets[sheet.get(f"{_R}id")]
            for row in E.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
                cells = []
                for cell in row.iter(f"{_S}c"):
                    value = cell.find(f"{_S}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                    cells.append(shared[int(text)] if cell.get("t") == "s" and text else {"1": "True", "0": "False"}.get(text, text) if cell.get("t") == "b" else text)
                if text := " | ".join(x.strip() for x in cells if x.strip()):
                    yield _block(text, "table_row", "xlsx")


def _pptx(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=lambda x: int(re.findall(r"\d+", x)[-1]))
        for n, slide in enumerate(slides, 1):
            yield _block("", "page", "pptx", True) | {"page": n}
            for p in E.fromstring(z.read(slide)).iter(f"{_A}p"):
                if text := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip():
                    yield _block(text, "paragraph", "pptx") | {"page": n}


def _rtf(data: bytes) -> Iterator[dict]:
    """As a text document reads after conversion: paragraphs with their lines, table rows, breaks."""
    for kind, text in rtf.paragraphs(data):
        listed = kind == "paragraph" and _LIST.match(text)
        yield _block(text, "list_item" if listed else kind, "docx")
        if kind == "paragraph":
            yield from (_block(x, "line", "docx", True) for line in text.splitlines() if (x := line.strip()))


_READERS = {".docx": _docx, ".xlsx": _xlsx, ".pptx": _pptx, ".rtf": _rtf}


def read_office(files: DataFrame) -> DataFrame:
    """Layout blocks (schemas.LAYOUT, with path for doc_id) of .docx, .xlsx and .pptx files.

    A file that is no such archive has no blocks.
    """
    box = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
    kinds = {"path": pa.string(), "seq": pa.int32(), "text": pa.string(), "page": pa.int32(), "block_type": pa.string(), "source_engine": pa.string(), "bbox": box, "drop_in_canonical": pa.bool_(), "is_repeated_header": pa.bool_(), "is_repeated_footer": pa.bool_()}

    def blocks(extension: str, data: bytes) -> list[dict]:
        try:
            return list(_READERS[extension](data))
        except (zipfile.BadZipFile, E.ParseError, KeyError, rtf.NotRtf):
            return []  # whole or not at all, so a file's blocks are listed before any is handed on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = ({"path": path, "seq": k, "is_repeated_header": False, "is_repeated_footer": False} | b for path, extension, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, b in enumerate(blocks(extension, data)))
            while rows := list(itertools.islice(found, HANDED_ON)):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], list(kinds))

    return files.where(F.col("extension").isin(*_READERS)).select("path", "extension", "content").mapInArrow(run, LAYOUT.replace("doc_id long", "path string", 1))


_SPAN = "path string, page int, height double, block int, line int, span int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>, reason string"


#: Spans that a task holds before it hands them on.
SPANS_AT_A_TIME = 1000


def pdf_spans(files: DataFrame) -> DataFrame:
    """Spans of .pdf files: path, page, height, block, line, span, text, bbox, reason.

    A page without text has one row with a null text. A file that can't be read has one row with the reason:
    encrypted, broken, or packed in a way that isn't known here. A file is read by one task.
    """
    box = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
    kinds = {"path": pa.string(), "page": pa.int32(), "height": pa.float64(), "block": pa.int32(), "line": pa.int32(), "span": pa.int32(), "text": pa.string(), "bbox": box, "reason": pa.string()}

    def rows(path: str, data: bytes) -> list[dict]:
        try:
            return [{"path": path} | x for x in pdf.spans(data)] or [{"path": path, "reason": "no pages"}]
        except Exception as e:  # whatever is wrong with a file, it is that file's reason
            return [{"path": path, "reason": str(e) if isinstance(e, pdf.Unreadable) else f"broken: {type(e).__name__}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in found], t) for k, t in kinds.items()], list(kinds))
        found: list[dict] = []
        for batch in batches:
            for path, data in ((x.as_py(), y.as_py()) for x, y in zip(*batch.columns, strict=True)):
                found += rows(path, data)
                if len(found) >= SPANS_AT_A_TIME:
                    yield out()
                    found = []
        if found:
            yield out()

    return files.where(F.col("extension") == ".pdf").select("path", "content").mapInArrow(run, _SPAN)


def pdf_layout(spans: DataFrame, drop_headers: bool = True) -> DataFrame:
    """Layout blocks of pdf_spans: each page's mark, its paragraphs and their lines, repeated headers and footers marked."""
    spans = written(spans.where("page is not null").withColumnRenamed("path", "doc_id"), "spans")
    heights = spans.select("doc_id", "page", "height").distinct()
    own = lambda kind, drop: {"source_engine": F.lit("pdf"), "drop_in_canonical": F.lit(drop)} | ({"block_type": F.lit(kind)} if kind else {})
    lines = written(layout.page_lines(spans.where("text is not null").drop("height", "reason")), "lines")
    groups = layout.page_groups(lines, heights).drop("lines").withColumn("line", F.lit(-1)).withColumns(own(None, False))
    lines = lines.withColumns(own(None, True))
    marks = heights.select("doc_id", "page", F.lit(-1).alias("block"), F.lit(-1).alias("line"), F.concat(F.lit("Page "), "page").alias("text"), F.lit(None).cast(spans.schema["bbox"].dataType).alias("bbox")).withColumns(own("page", True))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block", "line")) - 1
    blocks = marks.unionByName(groups).unionByName(lines).withColumns({"seq": seq.cast("int"), "is_repeated_header": F.lit(False), "is_repeated_footer": F.lit(False)})
    names = [x.split()[0] for x in re.sub(r"<.*?>", "", LAYOUT).split(", ")]
    return layout.mark_repeated(blocks.select(*names), heights, drop_headers).withColumnRenamed("doc_id", "path")


def read_layout(files: DataFrame) -> DataFrame:
    """Layout blocks with path for doc_id of all files, each read by what its suffix says. Files of other kinds have none."""
    texts = layout.text_blocks(read_text(files.where(F.col("extension") == ".txt")), "path")
    return texts.withColumnRenamed("doc_id", "path").unionByName(read_office(files)).unionByName(pdf_layout(pdf_spans(files)))


def extracted(files: DataFrame) -> DataFrame:
    """One row for each file that can be read: path, source_format, engine_used, text, blocks (a count by type), quality signals and score.

    A file without text has an empty one, no blocks and null signals. Use validate or view.valid_files to
    tell why a file is missing.
    """
    able = files.where(F.col("extension").isin(".txt", ".pdf", *_READERS)).select("path", F.substring("extension", 2, 10).alias("source_format"))
    engine = F.when(F.col("source_format") == "txt", "text").when(F.col("source_format") == "rtf", "docx").otherwise(F.col("source_format"))
    base = F.create_map(*[F.lit(x) for p in BASE_QUALITY.items() for x in p])
    blocks = written(read_layout(files).withColumnRenamed("path", "doc_id"), "layout")
    counts = layout.block_type_counts(blocks).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("blocks"))
    out = able.withColumn("engine_used", engine)
    for part in (layout.canonical_text(blocks), counts, layout.quality_signals(blocks)):
        out = out.join(part.withColumnRenamed("doc_id", "path"), "path", "left")
    out = layout.quality_scores(out, F.element_at(base, F.col("engine_used")))
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "blocks": F.coalesce("blocks", F.create_map().cast("map<string, bigint>"))})


def text_facade(files: DataFrame) -> DataFrame:
    """(path, text, quality_score) alone."""
    return extracted(files).select("path", "text", "quality_score")


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows by job. Only the jobs of rows are replaced; a job appears whole or not at all."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sid").parquet(path)


def read_results(spark: SparkSession, path: str, sid: str) -> DataFrame | None:
    """The rows of one job, None where nothing was written for it; the other jobs' folders are not listed."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    rows = rows.where(F.col("sid") == sid)
    return rows if rows.head(1) else None


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_block_diffs(rows: DataFrame, path: str) -> None:
    """The word diffs of the rows as JSON lines."""
    rows.select("sid", "block_id", "pair_id", "change_type", "display_segments_a", "display_segments_b").write.mode("overwrite").json(path)
