"""WARC archives: one gzip member per record, written and read by Spark tasks.

Pages of equal payload share one response record, that of the least page_id;
the others become revisit records, whose block keeps the HTTP headers with
the full payload's length. The reader goes through an archive in order: it
inflates piece by piece with zlib, frames each record by its Content-Length,
and checks the block and payload digests, holding one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, shared_dir

ROLL_BYTES = 64 << 20
PIECE = 1 << 16
#: Payloads smaller than this many bytes are never revisits.
LEAST_REVISIT = 0
#: Payloads of more rows than this, and of more than one in HOT_SHARE rows, are hot.
HOT_ROWS = 1_000
HOT_SHARE = 100_000
MANIFEST = "path string, records long"
RECORD = (
    "archive string, position long, record_type string, record_id string, target_uri string, page_id long, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)
ID_SPACE = uuid.UUID("6f1c0f6e-6a53-5a0c-9d7e-0d7f3f2f5a11")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, str(page_id))}>"


def _clean(value: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def _opener(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "000000-0"
        out: IO | None = None
        path, written, records, number = "", 0, 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path = f"{folder}/part-{name}-{number:04d}.warc.gz"
                    store, inner = _opener(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out, written, records, number = store.open_output_stream(inner, compression=None), 0, 0, number + 1
                payload = (row.html or "").encode("utf-8", "surrogatepass")
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                member = record(None if pd.isna(row.page_id) else int(row.page_id), row.url, payload, refers, bool(row.revisit))
                out.write(member)
                written += len(member)
                records += 1
                if written >= ROLL_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [records]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [records]})

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``.

    Returns the manifest, ``path, records``, itself written there: only files
    of tasks that succeeded are in it. Equal payloads (null counts as empty)
    of at least ``least`` bytes: the least page_id is the response, others,
    rows without a page_id too, revisit it. Rows that repeat the least page_id are all responses; so
    is a payload none of whose rows has a page_id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    counted = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = keep(counted.where("n > 1"), "warc-firsts")
    hot = F.col("n") > F.greatest(F.lit(HOT_ROWS), F.lit(pages.count() // HOT_SHARE))
    # At most HOT_SHARE payloads can be hot, so they are broadcast and their rows are dealt anywhere;
    # the rows of any other payload are few, and meet by digest.
    known = rows.join(F.broadcast(firsts.where(hot).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))), "digest", "left")
    spread = F.when(F.col("hot"), F.concat(F.lit("~"), F.monotonically_increasing_id())).otherwise(F.col("digest"))
    cold = firsts.where(~hot).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    named = known.withColumn("key", spread).join(cold, "key", "left").withColumn("first", F.coalesce("hot_first", "cold_first"))
    named = named.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    ready = named.select("page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("first")).alias("refers_to"))
    return keep(ready.mapInPandas(_write(folder), MANIFEST), "warc-manifest")


class _Inflater:
    """The bytes of a gzip file's members, piece by piece; ``member_ended`` after each member."""

    def __init__(self, source: IO) -> None:
        self.source = source
        self.engine = zlib.decompressobj(31)
        self.left = b""
        self.held = bytearray()
        self.fresh = True

    def more(self) -> bool:
        """Inflate another piece into ``held``; False at the end of the member or of the file."""
        if self.engine.eof:
            return False
        data = self.left or self.source.read(PIECE)
        if not data:
            if not self.fresh:
                raise ValueError("archive ends inside a gzip member")
            return False
        self.fresh = False
        self.held += self.engine.decompress(data, 1 << 20)
        self.left = self.engine.unconsumed_tail or self.engine.unused_data
        return True

    def next_member(self) -> None:
        self.left = self.engine.unused_data
        self.engine = zlib.decompressobj(31)
        self.held.clear()
        self.fresh = True


def _until(inflater: _Inflater, mark: bytes) -> bytes | None:
    begin = 0
    while (at := inflater.held.find(mark, begin)) < 0:
        begin = max(0, len(inflater.held) - len(mark) + 1)
        if not inflater.more():
            return None
    found = bytes(inflater.held[:at])
    del inflater.held[: at + len(mark)]
    return found


def _take(inflater: _Inflater, n: int) -> bytes:
    while len(inflater.held) < n:
        if not inflater.more():
            raise ValueError("record is shorter than its Content-Length")
    found = bytes(inflater.held[:n])
    del inflater.held[:n]
    return found


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(source: IO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in order; raises ValueError where framing or a digest fails."""
    inflater = _Inflater(source)
    while True:
        head = _until(inflater, b"\r\n\r\n")
        if head is None:
            if inflater.held.strip():
                raise ValueError("record without an end of its header")
            return
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head.lstrip())
        block = _take(inflater, int(fields["content-length"]))
        if _take(inflater, 4) != b"\r\n\r\n":
            raise ValueError("record is longer than its Content-Length")
        while not inflater.held and inflater.more():
            pass
        if inflater.held:
            raise ValueError("more than one record in a gzip member")
        if inflater.engine.eof:
            inflater.next_member()
        wanted = fields.get("warc-block-digest", "")
        if wanted.startswith("sha1:") and wanted != f"sha1:{sha1_base32(block)}":
            raise ValueError("block digest differs")
        yield fields, block


def _parsed(path: str, position: int, fields: dict[str, str], block: bytes) -> tuple:
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(_fields(head).get("content-length", len(payload)))
        if kind == "response" and (len(payload) != size or (digest and digest != sha1_base32(payload))):
            raise ValueError("payload length or digest differs")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (
        path, position, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), page and int(page), size,
        digest or sha1_base32(payload), refers and int(refers), payload if kind != "revisit" else None,
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    for batch in batches:
        for path in batch["path"]:
            store, inner = _opener(path)
            rows, held = [], 0
            with store.open_input_stream(inner, compression=None) as source:
                for position, (fields, block) in enumerate(read_records(source)):
                    rows.append(_parsed(path, position, fields, block))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield frame(rows)
                        rows, held = [], 0
            if rows:
                yield frame(rows)


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of the archives in ``paths`` (path): one row each, see ``RECORD``.

    Each archive is read by one task from its start to its end; archives are
    dealt out evenly. A damaged archive raises ValueError.
    """
    parts = max(1, min(paths.count(), paths.sparkSession.sparkContext.defaultParallelism * 4))
    return paths.select("path").repartition(parts).mapInPandas(_read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``
    for each row. A null html is an empty payload. An empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
