"""WARC archives: written with one gzip member a record, read back sequentially.

``write`` puts pages into ``.warc.gz`` files in a folder that all executors share. A task writes files of about
``ARCHIVE_BYTES`` each under names of its own and returns them with their record counts; only files that are in
that list are ever read, so a task that is run twice does no harm. ``read`` goes through each file with
incremental inflation, one member after another, frames the payload by Content-Length and verifies block and
payload digests.

Pages with equal payloads of at least ``REVISIT_BYTES`` are stored once, with the largest page_id; the others become
revisit records that refer to it. A null payload counts as empty. A null page_id refers to nothing and is never
referred to unless all in its group are null; rows that repeat the largest page_id are all responses. An empty table
gives no archive and an empty result; other columns are not looked at. Archives stay in the shared folder until
``_store.clean``, those of failed attempts, which no manifest names, as well.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._store import fresh_shuffles, new_path, read_table, save, ship

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
LEVEL = 4
_CHUNK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class BadArchive(ValueError):
    """A record that breaks the format or does not match its digest."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, full_bytes: int, kind: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has no payload of its own; its headers tell the full payload's digest and length."""
    # A response is named by its page, so that others can refer to it; what nothing refers to by all that it holds.
    name = f"page:{page_id}" if kind == "response" and page_id is not None else f"{kind}:{page_id}:{digest_hex}:{url}"
    ident = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(full_bytes).encode() + b"\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {_REVISIT_PROFILE}")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def members(stream) -> Iterator[bytes]:
    """The contents of each gzip member; ``stream.read(n)`` gives compressed bytes, at most one member is held."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(_CHUNK)
        rest = b""
        if not data:
            if parts or inflate.unconsumed_tail:
                raise BadArchive("the last member is cut off")
            return
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as e:
            raise BadArchive(str(e)) from e
        if inflate.eof:
            yield b"".join(parts)
            rest, parts = inflate.unused_data, []
            inflate = zlib.decompressobj(31)


def _fields(lines: list[str]) -> dict[str, str]:
    return {name: value.strip() for name, _, value in (line.partition(":") for line in lines)}


def read_records(stream) -> Iterator[Record]:
    """Records in order, each framed by its Content-Length and checked against its digests."""
    for member in members(stream):
        head, found, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise BadArchive("no WARC header")
        headers = _fields(lines[1:])
        n = int(headers["Content-Length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise BadArchive("the block is not as long as its header says")
        if headers["WARC-Block-Digest"] != _digest(block):
            raise BadArchive("the block does not match its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != _digest(payload):
            raise BadArchive("the payload does not match its digest")
        yield Record(headers, _fields(http.decode("latin-1").split("\r\n")[1:]), payload)


#: Schemes by which Hadoop's connectors go and the Arrow file systems of the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss", "wasb": "abfs"}


def arrow_uri(path: str) -> str:
    """The URI by which Arrow opens a folder that Spark knows as ``path``."""
    scheme, found, rest = path.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}" if found else path


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """For each page its payload, digest, length, record type and what it refers to.

    Groups of equal payloads are told by digest and length and reduced to their largest page_id before anything is
    joined; what is joined back has one row for each group of two or more, however large a group is.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    page = page.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = page.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("g_digest"), F.col("payload_bytes").alias("g_bytes"))
    groups = groups.agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    joined = page.join(groups, (F.col("payload_digest") == F.col("g_digest")) & (F.col("payload_bytes") == F.col("g_bytes")), "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``plan_records`` made under ``folder``; a table of (path, records, bytes), itself written."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, n = None, "", 0

        def close():
            size = out.tell()
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, full, kind, refers = (batch.column(c)[i].as_py() for c in range(7))
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(make_record(page_id, url, payload.encode() if kind == "response" else b"", digest, full, kind, refers))
                n += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    files = records.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    files = files.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    return save(files.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest``; fails on any that is malformed, misses a record or its digest."""
    spark = manifest.sparkSession
    ship(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def row(r: Record) -> tuple:
        h = r.headers
        algorithm, _, code = h["WARC-Payload-Digest"].partition(":")
        if algorithm != "sha1":
            raise BadArchive("an unknown digest")
        ref = h.get("X-Refers-To-Page-ID")
        ident = h.get("X-Page-ID")
        # A revisit keeps the HTTP header of the full payload.
        full = len(r.payload) if h["WARC-Type"] == "response" else int(r.http["Content-Length"])
        return (None if ident is None else int(ident), h["WARC-Target-URI"], full, base64.b32decode(code).hex(), h["WARC-Type"], None if ref is None else int(ref), r.payload)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with system.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for record in read_records(stream):
                        rows.append(row(record))
                        seen, held = seen + 1, held + len(record.payload) * with_payload
                        if len(rows) == 10_000 or held > 1 << 22:
                            yield _batch(rows, kinds, names)
                            rows, held = [], 0
                if seen != count:
                    raise BadArchive(f"{path} has {seen} records, not {count}")
                if rows:
                    yield _batch(rows, kinds, names)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # One archive a task at most: an archive is read in sequence.
    spread = manifest.select("path", "records").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(run, ddl)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    with fresh_shuffles(spark):
        manifest = write(plan_records(read_table(spark, sf_dir, "pages")), folder)
    return read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
