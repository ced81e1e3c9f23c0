"""WARC archives with a two-level capture index.

Records are gzip members of their own in one archive file a task. Captures are sorted by reversed
host key (`com,example,www)/path`) and page id, cut into blocks of BLOCK_LINES lines that are
compressed one by one, and a sparse directory keeps the first key of each block. A lookup searches
the directory by halves, reads one block by range, and then the record by range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import shared_dir, small_batches, utf8, written

BLOCK_LINES = 3000
#: The WARC-Date of every record: pages carry no time.
DATE = "1970-01-01T00:00:00Z"
#: Bytes of archives that a task reads back, about.
TASK_BYTES = 64 << 20
_LEVEL = 4
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: Column) -> Column:
    """The sort key of a URL: host parts reversed, then `)` and the rest. Null becomes an empty key."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    plain = F.regexp_replace(plain, r"[\x00-\x20\x7F]", "%20")
    host = F.regexp_extract(plain, r"^([^/?#]*)", 1)
    rest = F.regexp_replace(plain, r"^[^/?#]*", "")
    return F.when(plain == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or with refers_to a revisit of that page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(x if x > "\x20" and x != "\x7f" else f"%{ord(x):02X}" for x in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; payload is None for revisits."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind = fields["WARC-Type"]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or (kind == "response" and len(payload) != size):
        raise ValueError("not a whole WARC record")
    return {
        "id": fields["WARC-Record-ID"][10:-1],
        "url": fields.get("WARC-Target-URI"),
        "type": kind,
        "bytes": size,
        "digest": digest(payload) if kind == "response" else fields["WARC-Payload-Digest"][5:],
        "refers_to": fields["WARC-Refers-To"][10:-1] if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row; returns the captures (surt, page_id, file, offset, length).

    Of rows with equal payloads of at least min_bytes, the one with the largest id becomes a
    response, the others revisit it. A null payload is empty. Rows that repeat the largest id are
    responses all; a null id is below every other, and rows without ids and peers are responses.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count("*").alias("n"), F.count("page_id").alias("ids"))
    last = last.where("n > 1 and (first < last or ids < n)").select("sha1", "last")
    rows = rows.join(last, "sha1", "left")
    refers = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.select(surt(F.col("url")).alias("surt"), "page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None  # a repeated task writes a file of its own
        for batch in batches:
            out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
            offsets, lengths = [], []
            for page_id, url, data, to in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                member = gzip.compress(record(page_id, url, data, to), _LEVEL, mtime=0)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["surt", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    small_batches(pages.sparkSession)
    return written(rows.mapInArrow(write, "surt string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> None:
    """Writes the blocks and, under directory/, their first keys."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{top}/blocks", recursive=True)
        name, at, out, held, first = f"{uuid.uuid4().hex}.cdx.gz", 0, None, [], None

        def block() -> pa.RecordBatch:
            nonlocal at, held
            data = gzip.compress(b"\n".join(held), 6, mtime=0)
            out.write(data)
            row = [[x] for x in (*first, name, at, len(data), len(held))]
            at, held = at + len(data), []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["surt", "page_id", "file", "offset", "length", "lines"])

        for batch in batches:
            out = out or fs.open_output_stream(f"{top}/blocks/{name}", compression=None)
            for key, page_id, file, offset, length in zip(utf8(batch.column(0)), *(x.to_pylist() for x in batch.columns[1:]), strict=True):
                if not held:
                    first = key.decode(), page_id
                held.append(b"%b %b %b %d %d" % (key, b"-" if page_id is None else b"%d" % page_id, file.encode(), offset, length))
                if len(held) == block_lines:
                    yield block()
        if held:
            yield block()
        if out:
            out.close()

    small_batches(captures.sparkSession)
    order = ["surt", "page_id", "file", "offset"]
    rows = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(write, "surt string, page_id long, file string, offset long, length long, lines long").write.parquet(f"{folder}/directory")


class Index:
    """Reads an index and its archives by range; it keeps a few blocks and open files."""

    def __init__(self, index: str, archives: str, blocks: int = 4, files: int = 64):
        self.fs, self.top = pafs.FileSystem.from_uri(index)
        self.archive_fs, self.archive_top = pafs.FileSystem.from_uri(archives)
        self.most_blocks, self.most_files = blocks, files
        parts = [x.path for x in self.fs.get_file_info(pafs.FileSelector(f"{self.top}/directory")) if x.base_name.endswith(".parquet")]
        rows = [r for p in parts for r in pq.read_table(p, filesystem=self.fs).to_pylist()]
        rows.sort(key=lambda r: (self.key(r["surt"].encode(), r["page_id"]), r["file"], r["offset"]))
        self.directory, self.keys = rows, [self.key(r["surt"].encode(), r["page_id"]) for r in rows]
        self.blocks: OrderedDict[int, tuple[list, list]] = OrderedDict()
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()

    @staticmethod
    def key(surt: bytes, page_id: int | None) -> tuple[bytes, bool, int]:
        return surt, page_id is not None, page_id or 0

    def _read(self, fs, path: str, offset: int, length: int) -> bytes:
        if path not in self.files:
            self.files[path] = fs.open_input_file(path)
            if len(self.files) > self.most_files:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(path)
        return self.files[path].read_at(length, offset)

    def _block(self, i: int) -> tuple[list, list]:
        if i not in self.blocks:
            r = self.directory[i]
            lines = [x.split(b" ") for x in zlib.decompress(self._read(self.fs, f"{self.top}/blocks/{r['file']}", r["offset"], r["length"]), 31).split(b"\n")]
            self.blocks[i] = [self.key(x[0], None if x[1] == b"-" else int(x[1])) for x in lines], lines
            if len(self.blocks) > self.most_blocks:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(i)
        return self.blocks[i]

    def find(self, surt: bytes, page_id: int | None) -> Iterator[dict]:
        """The records of that key."""
        key = self.key(surt, page_id)
        i = max(0, bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            keys, lines = self._block(i)
            for j in range(bisect_left(keys, key), len(keys)):
                if keys[j] != key:
                    return
                file, offset, length = lines[j][2].decode(), int(lines[j][3]), int(lines[j][4])
                yield parse(zlib.decompress(self._read(self.archive_fs, f"{self.archive_top}/{file}", offset, length), 31))
            i += 1


def read_back(keys: DataFrame, index: str, archives: str, with_payload: bool = False) -> DataFrame:
    """The record of each capture with a key (surt, page_id) in keys, through the index.

    Keys are sorted first, so a task goes through its blocks once. There are as many tasks as archives,
    more where these have more than TASK_BYTES each. Keys that the index lacks give no row.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            found = found or Index(index, archives)
            rows = [x for key, page_id in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True) for x in found.find(key, page_id)]
            number = lambda x: int(x) if x else None
            columns = [
                pa.array([number(x["id"]) for x in rows], pa.int64()),
                pa.array([x["bytes"] for x in rows], pa.int64()),
                pa.array([x["digest"] for x in rows], pa.string()),
                pa.array([x["type"] for x in rows], pa.string()),
                pa.array([number(x["refers_to"]) for x in rows], pa.int64()),
            ]
            if with_payload:
                columns.append(pa.array([x["payload"] for x in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    small_batches(keys.sparkSession)
    fs, top = pafs.FileSystem.from_uri(archives)
    files = [x.size for x in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if x.is_file]
    tasks = max(1, len(files), -(-sum(files) // TASK_BYTES))
    keys = keys.select("surt", "page_id").distinct().repartitionByRange(tasks, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return keys.mapInArrow(look, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive(spark: SparkSession, pages: DataFrame) -> tuple[str, str]:
    """Writes archives and index of pages to the shared folder; their paths (index, archives)."""
    archives, index = shared_dir(spark, "warc"), shared_dir(spark, "cdx")
    write_index(write_archives(pages, archives), index)
    return index, archives
