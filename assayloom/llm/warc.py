"""WARC archives as a Spark data source, in both directions.

A record is one gzip member whose header names its compressed and full length (the ``sl`` extra field), so a reader that does
not want a record goes to the next one without inflating it; members without that field are inflated and passed over.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from assayloom.llm.common import cut, spread_join

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: The header that carries each column; the payload comes after them.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length", "refers_to": "WARC-Refers-To"}
SPLIT = 64 << 20
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_committed.json"
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format: the kind of a block that is an HTTP message, and the profile of revisits of an equal payload.
HTTP = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").replace("///", "/", 1)
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """One gzip member that says how long it is."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8  # fixed header with the length of the extra field, that field, body, checks
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return MAGIC + b"\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return member(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


class _Members:
    """The members of a byte range: those that start in it."""

    def __init__(self, f, start: int, stop: int, size: int):
        self.f, self.stop, self.size = f, min(stop, size), size
        self.at = start if not start else self._next(start)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _next(self, at: int) -> int:
        """The first place from ``at`` on that inflates to the start of a record."""
        while at < self.stop:
            window = self._read(at, 1 << 16)
            k = window.find(MAGIC)
            while k >= 0:
                try:
                    if zlib.decompressobj(31).decompress(self._read(at + k, 4096), 5) == b"WARC/":
                        return at + k
                except zlib.error:
                    pass
                k = window.find(MAGIC, k + 1)
            at += max(1, len(window) - 2)
        return self.stop

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable]]:
        """Parsed headers, and a function that gives the payload (of an HTTP message its body, else the block); one not asked for is
        not inflated."""
        while self.at < self.stop:
            start, head, buffer = self.at, self._read(self.at, 8192), b""
            if head[:3] != MAGIC:
                raise ValueError(f"no gzip member at byte {start}")
            length = struct.unpack("<I", head[16:20])[0] if head[3] & 4 and head[12:14] == b"sl" else 0
            inflate, fed = zlib.decompressobj(31), len(head)
            buffer = inflate.decompress(head, 1 << 16)
            while b"\r\n\r\n" not in buffer:
                more = inflate.unconsumed_tail or self._read(start + fed, 8192)
                if not inflate.unconsumed_tail:
                    fed += len(more)
                if not more or inflate.eof:
                    raise ValueError(f"a record without the end of its headers at byte {start}")
                buffer += inflate.decompress(more, 1 << 16)
            lines, _, rest = buffer.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in lines.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
            state = {"rest": [rest], "fed": fed}

            def drain(keep: bool, inflate=inflate, state=state, start=start) -> None:
                while not inflate.eof:
                    more = inflate.unconsumed_tail or self._read(start + state["fed"], 1 << 16)
                    if not inflate.unconsumed_tail:
                        state["fed"] += len(more)
                    if not more:
                        raise ValueError(f"a record is cut short at byte {start}")
                    out = inflate.decompress(more, 1 << 20)
                    if keep:
                        state["rest"].append(out)

            def block(headers=headers, state=state, drain=drain) -> bytes:
                drain(True)
                whole = b"".join(state["rest"])[: int(headers["Content-Length"])]
                return whole.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").startswith("application/http") else whole

            yield headers, block
            if length:
                self.at = start + length
            else:
                drain(False)
                self.at = start + state["fed"] - len(inflate.unused_data)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


class WarcReader(DataSourceReader):
    """Plans byte ranges of files; keeps what the predicates on record type and headers let through, before payloads are inflated."""

    def __init__(self, options: dict):
        self.path, self.payload, self.wanted = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_bytes" and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.wanted.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[_Range]:
        fs, root = open_path(self.path)
        info = fs.get_file_info(f"{root}/{MANIFEST}")
        if info.type == pafs.FileType.File:
            with fs.open_input_stream(info.path) as f:
                names = [f"{root}/{x}" for x in json.loads(f.read())]
            found = fs.get_file_info(names) if names else []
        else:
            top = fs.get_file_info(root)
            found = [top] if top.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.base_name.endswith(".warc.gz")]
        return [_Range(x.path, a, a + SPLIT, x.size) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, SPLIT)] or [_Range("", 0, 0, 0)]

    def _passes(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.wanted:
            have = headers.get(HEADERS[column])
            if have is None or kind == "EqualTo" and have != value or kind == "In" and have not in value or kind == "StringStartsWith" and not have.startswith(value):
                return False
        return True

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_path(self.path)
        columns: list[list] = [[] for _ in range(len(HEADERS) + 1)]
        held = 0
        with fs.open_input_file(partition.path) as f:
            for headers, block in _Members(f, partition.start, partition.stop, partition.size):
                if self._passes(headers):
                    values = [headers.get(h) for h in HEADERS.values()]
                    values[5] = int(values[5]) if values[5] is not None else None
                    values.append(block() if self.payload else None)
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                    held += 300 + len(values[-1] or b"")
                    if held >= BATCH_BYTES:
                        yield self._batch(columns)
                        columns, held = [[] for _ in columns], 0
        yield self._batch(columns)

    @staticmethod
    def _batch(columns: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64() if c == "payload_bytes" else pa.string() for c in HEADERS] + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*HEADERS, "payload"])


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceWriter):
    """Files of about FILE_BYTES under names of their own; only those of tasks that ended are listed as committed."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> _Written:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                headers = {h: str(row[c]) for c, h in HEADERS.items() if row[c] is not None}
                payload = bytes(row["payload"] or b"")
                if row["record_type"] == "revisit":
                    data = record({**headers, "WARC-Profile": PROFILE, "Content-Type": HTTP}, b"")
                else:
                    data = record({**headers, "Content-Type": HTTP}, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages) -> None:
        fs, root = open_path(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records of ``pages`` (page_id, url, html) in the columns of SCHEMA.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of ``least`` bytes or more that with the
    largest page_id is the response and the others revisit it, without a payload; all else are responses. Rows repeated with
    the largest id are all responses; so are equal payloads of which no row has an id. A null url gives no target.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "").alias("target_uri"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumns({"payload_bytes": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    narrow = base.filter(F.col("payload_bytes") >= least).select("page_id", "digest")
    heads = narrow.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1 and head is not null")
    again = spread_join(narrow, cut(heads), "digest", "n").filter(~F.col("page_id").eqNullSafe(F.col("head"))).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "head").distinct()
    met = base.join(again, (F.col("digest") == F.col("again_digest")) & F.col("page_id").eqNullSafe(F.col("again_id")), "left")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c), F.lit(">"))
    return met.select(
        F.when(F.col("head").isNull(), "response").otherwise("revisit").alias("record_type"), F.coalesce(name("page_id"), F.lit("<urn:x-page:>")).alias("record_id"), "target_uri", F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), "payload_bytes", name("head").alias("refers_to"), F.when(F.col("head").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """WARC files of ``pages`` under ``path``; an empty table gives an archive without files."""
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path`` in the columns of SCHEMA; without ``payload`` only headers are inflated and it is null."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
