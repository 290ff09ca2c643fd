"""WARC archives: a writer and a splittable reader.

Writer: each task streams its rows into one archive of gzip members (a member a record) in the shared folder, under a
name no other attempt uses; only archives of attempts that end well are listed in the returned manifest. Of records
with equal payloads (of at least ``least_bytes``) the one with the smallest page_id is the response, others are revisits.

Reader: every archive is cut into byte ranges. A task scans its range for the gzip magic, validates each candidate by
decoding what follows up to a WARC version line, and owns the records that start inside its range; a record may end
beyond it. False magics inside compressed data fail the validation, or lie in a record that has been read already.

Edge cases: null html is an empty payload; a null page_id is written as an empty id and read back as null (it
never is the smallest unless all are null); rows that repeat page_id and payload are all of the same type; an empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import new_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 18
PROBE_BYTES = 512
MOST_TASKS = 50_000


def open_shared(uri: str, write: bool = False):
    """A file of the shared folder: a mounted folder (file:) by the plain file calls, any other store by Arrow's."""
    if uri.startswith(("file:", "/")):
        where = "/" + uri.removeprefix("file:").lstrip("/")
        if write:
            os.makedirs(os.path.dirname(where), exist_ok=True)
        return open(where, "wb" if write else "rb")
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    if not write:
        return store.open_input_file(where)
    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(where, compression=None)


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = "" if page_id is None else str(page_id)
    body = b"" if kind == "revisit" else payload
    uid = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}|{digest}")
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: text/html",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-Id: {name}", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To: {'' if refers_to is None else refers_to}"]
    raw = VERSION + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html plus refers_to (null for responses): digests of fixed size are grouped, never the pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    first = p.select("page_id", "sha1", "bytes").where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = p.join(first, ["sha1", "bytes"], "left")
    same = F.col("first_id").isNull() | F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(~same, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the manifest (path, bytes, records)."""
    spark = pages.sparkSession
    top = new_path(spark, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, n = None, 0, 0
        path = f"{top}/{uuid.uuid4().hex}.warc.gz"
        try:
            for pdf in batches:
                for page_id, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                    if out is None:
                        out = open_shared(path, write=True)
                    payload = html.encode("utf-8")
                    pid = None if pd.isna(page_id) else int(page_id)
                    ref = None if pd.isna(refers) else int(refers)
                    data = record("response" if ref is None else "revisit", pid, " ".join(url.split()), payload, b32(hashlib.sha1(payload).digest()), ref)
                    out.write(data)
                    size, n = size + len(data), n + 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    shape = with_types(pages, least_bytes)
    typed = shape.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    manifest = typed.mapInPandas(run, "path string, bytes long, records long")
    listed = new_path(spark, "warc-manifest")
    manifest.write.parquet(listed)
    out = spark.read.schema(manifest.schema).parquet(listed)
    _drop_unlisted(out, top)
    return out


def _drop_unlisted(manifest: DataFrame, top: str) -> None:
    """Delete what attempts left behind that didn't end well (names of archives only: one a task of the writer)."""
    spark = manifest.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(top)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(folder):
        good = {r.path.rsplit("/", 1)[1] for r in manifest.select("path").toLocalIterator()}
        for f in store.listStatus(folder):
            if f.getPath().getName() not in good:
                store.delete(f.getPath(), False)


class _Source:
    """Buffered reads at any place of an open file."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at = at
            self.file.seek(at)
            self.data = self.file.read(min(max(n, READ_BYTES), self.size - at))
        return self.data[at - self.at : at - self.at + n]


def _probe(src: _Source, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(src.get(at, PROBE_BYTES), len(VERSION)).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(src: _Source, at: int) -> tuple[bytes, int]:
    """The decoded member at ``at`` and where it ends."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        data = src.get(at, READ_BYTES)
        if not data:
            raise zlib.error("truncated member")
        parts.append(z.decompress(data))
        at += len(data)
    return b"".join(parts), at - len(z.unused_data)


def records_in(src: _Source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record that starts in [start, end)."""
    at = start
    while at < end:
        data = src.get(at, READ_BYTES)
        found = data.find(MAGIC)
        if found < 0 or at + found >= end:
            if found >= 0 or at + len(data) >= min(end + len(MAGIC) - 1, src.size) or not data:
                return
            at += len(data) - len(MAGIC) + 1
            continue
        at += found
        if not _probe(src, at):
            at += 1
            continue
        try:
            raw, after = _member(src, at)
        except zlib.error:
            at += 1
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
        yield fields, rest[: int(fields["Content-Length"])]
        at = after


def reading_tasks(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """One task a range, up to MOST_TASKS; beyond that a task reads several ranges, one after another."""
    n = manifest.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("bytes") / range_bytes)))).first()[0] or 1
    return int(min(n, MOST_TASKS))


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits) of all records."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    # a fixed number of partitions: adaptive execution must not merge ranges, which are small rows with much work behind them
    ranges = ranges.repartition(reading_tasks(manifest, range_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"], strict=True):
                rows: list[tuple] = []
                held = 0
                with open_shared(path) as f:
                    for h, body in records_in(_Source(f, int(size)), int(start), min(int(start) + range_bytes, int(size))):
                        full = h["WARC-Type"] == "response"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if full and b32(hashlib.sha1(body).digest()) != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
                        rows.append((h["X-Page-Id"] or None, h.get("WARC-Target-URI", ""), h["WARC-Type"], h.get("X-Refers-To") or None, len(body) if full else int(h["X-Payload-Length"]), digest, body if full else None))
                        held += len(body)
                        if held >= 1 << 22:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    out = ranges.mapInPandas(run, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


COLUMNS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
