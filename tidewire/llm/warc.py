"""WARC archives as a Spark data source: written with one gzip member a record, read as a sequence.

Writing: payloads are told apart by SHA-1 and length. The record with the smallest page_id of equal payloads is the
response, the others are revisits, which carry its record id and the HTTP header but not the payload. Whose first record is
where comes from an aggregate in two steps, by (payload, salt) and then by payload, so that one payload in a third of all
pages is joined in SALTS parts. Each task writes archives of about archive_bytes; only archives whose task committed are
named in the folder's list of files, so those of failed or repeated attempts are never read.

Reading: one task an archive. It decompresses the members incrementally in steps of STEP bytes, cuts records out by their
content length, and compares every block, and the payload of every response, with the digest in the header. It holds one
record and one step at a time, whatever the archive's size. A broken frame is an error; a digest that differs makes the
record unverified, or with the option strict an error.

Null html is an empty payload. Payloads shorter than least_bytes are all responses. A null page_id comes after all others,
so it is a response only if no page with that payload has an id, and then all of them are. Rows that share the smallest
page_id, payload included, are all responses. An empty table gives an archive folder without records; other columns are
ignored. A very long payload is held by one task, once as bytes and once compressed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewire.llm import stores
from tidewire.llm.common import text_bytes

SALTS, STEP = 64, 1 << 18
RECORD = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary, verified boolean"
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    """Bare and upper-case."""
    return base64.b32encode(digest).decode()


def sha1(data: bytes) -> str:
    return base32(hashlib.sha1(data).digest())


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, first: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed. A revisit's block is the HTTP header alone, with the length that its payload would have."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block += b"" if revisit else payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    fields += [("WARC-Refers-To", record_id(first, digest)), ("WARC-Profile", PROFILE)] if revisit else []
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    fields: dict[str, str]
    payload: bytes
    n_bytes: int
    verified: bool


class Broken(ValueError):
    """An archive whose frames do not hold."""


def _plain(stream: IO[bytes], step: int = STEP) -> Iterator[bytes]:
    """What the members of an archive decompress to, in pieces of bounded size; a stream that ends within a member is an error."""
    rest, inflate = b"", None
    while True:
        if not rest and not (rest := stream.read(step)):
            break
        inflate = inflate or zlib.decompressobj(31)
        piece, rest = inflate.decompress(rest, 4 * step), inflate.unconsumed_tail
        if piece:
            yield piece
        if inflate.eof:
            rest, inflate = inflate.unused_data, None
    if inflate is not None:
        raise Broken("the archive ends within a gzip member")


def records(stream: IO[bytes], step: int = STEP) -> Iterator[Record]:
    """The records of an archive in order."""
    pieces, held = _plain(stream, step), bytearray()

    def filled(n: int) -> bool:
        while len(held) < n:
            if (piece := next(pieces, None)) is None:
                return False
            held.extend(piece)
        return True

    def cut(n: int) -> bytes:
        if not filled(n):
            raise Broken(f"the archive ends {n - len(held)} bytes short of a record's length")
        out = bytes(held[:n])
        del held[:n]
        return out

    while filled(1):
        end = -1
        while (end := held.find(b"\r\n\r\n", max(0, end))) < 0:
            end = max(0, len(held) - 3)
            if not filled(len(held) + 1):
                raise Broken("the archive ends within a header")
        first, *lines = cut(end + 4).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise Broken(f"no record begins with {first[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}
        if not fields.get("content-length", "").isdigit():
            raise Broken("a record without a content length")
        block = cut(int(fields["content-length"]))
        if cut(4) != b"\r\n\r\n":
            raise Broken("a record does not end where its content length says")
        yield _taken_apart(fields, block)


def _taken_apart(fields: dict[str, str], block: bytes) -> Record:
    at = block.find(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else -4
    head, payload = block[: max(0, at)], block[at + 4 :]
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    n_bytes = int(length[1]) if length else len(payload)
    good = lambda name, data: fields.get(name, "sha1:").partition(":")[2].upper() in ("", sha1(data))
    verified = good("warc-block-digest", block) and (fields.get("warc-type") == "revisit" or (good("warc-payload-digest", payload) and n_bytes == len(payload)))
    return Record(fields, payload, n_bytes, verified)


# --- Spark ---------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Takes page_id, url, payload, digest (the bytes of the SHA-1), n_bytes, first, revisit."""

    def __init__(self, path: str, archive_bytes: int, date: str):
        self.path, self.archive_bytes, self.date = path, archive_bytes, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = stores.located(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, held = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "n_bytes", "first", "revisit")]
                for i in range(batch.num_rows):
                    if out is None or held >= self.archive_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, held = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    page_id, url, payload, digest, *rest = (c[i].as_py() for c in columns)
                    data = member(record(page_id, url, payload, base32(digest), *rest, self.date))
                    out.write(data)
                    held += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = stores.located(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m is not None for f in m.files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = stores.located(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{folder}/{f}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, strict: bool):
        self.path, self.payload, self.strict = path, payload, strict

    def partitions(self) -> list[InputPartition]:
        fs, folder = stores.located(self.path)
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
        lists = [n for n in names if n.startswith("_committed-")]
        if lists:
            files = [f for n in lists for f in json.loads(fs.open_input_stream(f"{folder}/{n}").read())]
        else:
            files = [n for n in names if n.endswith((".warc.gz", ".warc"))]
        return [InputPartition(f) for f in sorted(files)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, folder = stores.located(self.path)
        rows, held = [], 0
        with fs.open_input_stream(f"{folder}/{partition.value}", compression=None) as stream:
            try:
                for r in records(stream):
                    if self.strict and not r.verified:
                        raise Broken(f"digests of {r.fields.get('warc-record-id')} differ")
                    f = r.fields.get
                    digest = (f("warc-payload-digest") or "").partition(":")[2] or None
                    rows.append((f("warc-record-id"), f("warc-type"), f("warc-target-uri"), f("warc-date"), digest, f("warc-refers-to"), r.n_bytes, r.payload if self.payload else None, r.verified))
                    held += len(r.payload) if self.payload else 200
                    if held > 2 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            except (Broken, zlib.error) as e:
                raise Broken(f"{partition.value}: {e}") from e
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RECORD.split(", "))])
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class WarcSource(DataSource):
    """Format warc. Options of reading: payload (false leaves payloads out), strict (true); of writing: archive_bytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "true") == "true", self.options.get("strict", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", 256 << 20)), self.options.get("date", "1970-01-01T00:00:00Z"))


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, first (the response's page_id) and revisit of every page."""
    keyed = pages.select("page_id", "url", text_bytes("html").alias("payload"))
    keyed = keyed.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))})
    own = ["sha1", "n_bytes"]
    salted = keyed.filter(F.col("n_bytes") >= least_bytes).groupBy(*own, "salt").agg(F.min("page_id").alias("least"), F.count("*").alias("pages"))
    first = salted.groupBy(*own).agg(F.min("least").alias("first"), F.sum("pages").alias("pages")).filter("pages > 1 and first is not null").drop("pages")
    placed = salted.join(first, own).select(*own, "salt", "first")
    whole = keyed.join(placed.hint("shuffle_hash"), [*own, "salt"], "left")
    return whole.select("page_id", "url", "payload", F.col("sha1").alias("digest"), "n_bytes", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Adds the pages (page_id, url, html) to the archive folder."""
    pages.sparkSession.dataSource.register(WarcSource)
    marked(pages, least_bytes).write.format("warc").option("archive_bytes", archive_bytes).option("date", date).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of an archive folder, with the columns RECORD."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("strict", str(strict).lower()).load(path)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified of every page."""
    spark = pages.sparkSession
    path = stores.fresh(spark)
    write(pages, path, least_bytes)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")
    return read(spark, path, payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "verified")
