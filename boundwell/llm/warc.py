"""WARC archives as a chunked record table, written and read back as a stream.

Payloads are cut in the scan: what is moved, joined or handed to Python is rows (record, chunk number, bytes) of at most CHUNK
bytes. A running SHA-1 goes from chunk to chunk while they are scanned; each row carries the digest up to its end, so that the last
one has the record's digest and a reader can tell at which chunk a stored record was damaged.  A record's type reaches its chunks by
a join on its id and a 64-bit hash of its payload, which only tells payloads of one id apart.  The archive is a table of the very
bytes of its WARC/1.1 records, cut at the same chunks: reading a record's rows in order gives the record, and export_warc
writes them as an ordinary .warc file.  The table is written by Spark to the shared folder, so that a lost task is committed
once or not at all.

Records of equal payloads: the one with the largest id is the response, the others revisit it.  Their payloads are empty in
the archive, and the digest and WARC-Refers-To say what they stand for.

Defined results: null payloads count as empty; null URLs get the URI of the record; repeated rows are records of their own (equal
rows that share the largest id all are responses); a record without an id is the response only if no equal payload has an id;
an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwell.llm.runtime import cut
from boundwell.shared import remove, scratch

CHUNK = 1 << 20
CRLF = b"\r\n"


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records with last_chunk, chunk_no and data instead of payload: its bytes in pieces, in order; an empty payload is one empty piece."""
    rest = [c for c in records.columns if c != "payload"]
    last = F.greatest(F.lit(0), F.ceil(F.length("payload") / chunk) - 1).cast("int")
    pieces = records.withColumn("last_chunk", last).select(*rest, "payload", "last_chunk", F.explode(F.sequence(F.lit(0), F.col("last_chunk"))).alias("chunk_no"))
    return pieces.select(*rest, "last_chunk", "chunk_no", F.col("payload").substr(F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds sha1_so_far and bytes_so_far to chunk rows, of which a payload's stand together in order."""
    state, n = hashlib.sha1(), 0
    for batch in batches:
        digests, sizes = [], []
        for k, data in zip(batch.column("chunk_no").to_pylist(), batch.column("data"), strict=True):
            if k == 0:
                state, n = hashlib.sha1(), 0
            piece = data.as_buffer()
            state.update(piece)
            n += piece.size
            digests.append(state.hexdigest())
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], [*batch.schema.names, "sha1_so_far", "bytes_so_far"])


def classify(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, mark, n_bytes, sha1) of all payloads, to distinct (page_id, mark, n_bytes, sha1, record_type, refers_to)."""
    newest = digests.groupBy("sha1").agg(F.max("page_id").alias("newest")).select(F.concat("sha1", F.lit("")).alias("_sha1"), "newest")  # an exchange of its own, see apart()
    again = (F.col("n_bytes") >= min_bytes) & ~F.col("newest").eqNullSafe(F.col("page_id"))
    return (
        digests.join(newest.hint("shuffle_merge"), F.col("sha1") == F.col("_sha1"))
        .select("page_id", "mark", "n_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("newest")).alias("refers_to"))
        .distinct()
    )


def _uri(page_id: int | None, digest: str) -> bytes:
    return f"<urn:sha1:{digest}:{'' if page_id is None else page_id}>".encode()


def header(page_id: int | None, url: str | None, kind: str, sha1: str, n: int, refers_to: int | None) -> bytes:
    """The WARC header block. X-Payload-Length is the payload's full length, which a revisit's block doesn't have."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = [
        (b"WARC-Type", kind.encode()),
        (b"WARC-Record-ID", _uri(page_id, digest)),
        (b"WARC-Target-URI", " ".join((url or f"urn:sha1:{digest}").split()).encode()),
        (b"WARC-Payload-Digest", b"sha1:" + digest.encode()),
        (b"Content-Type", b"text/html; charset=utf-8"),
        (b"X-Payload-Length", str(n).encode()),
        (b"Content-Length", str(n if kind == "response" else 0).encode()),
    ]
    if page_id is not None:
        fields.append((b"X-Page-ID", str(page_id).encode()))
    if kind == "revisit":
        fields += [(b"WARC-Refers-To", _uri(refers_to, digest)), (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        fields.append((b"X-Refers-To-Page", str(refers_to).encode()))
    return b"WARC/1.1" + CRLF + b"".join(k + b": " + v + CRLF for k, v in fields) + CRLF


ARCHIVE = "record long, last_chunk int, chunk_no int, bytes binary, sha1_so_far string"


def _serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows with the records' metadata, in any order, to rows of the archive."""
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "data"}
        rows = []
        for i, data in enumerate(batch.column("data")):
            r = {c: v[i] for c, v in cols.items()}
            text = header(r["page_id"], r["url"], r["record_type"], r["sha1"], r["n_bytes"], r["refers_to"]) if r["chunk_no"] == 0 else b""
            stored = r["record_type"] == "response"
            last = r["last_chunk"] if stored else 0
            digest = r["sha1_so_far"] if stored else hashlib.sha1().hexdigest()
            rows.append((r["record"], last, r["chunk_no"], text + (data.as_py() if stored else b"") + (2 * CRLF if r["chunk_no"] == last else b""), digest))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], ["record", "last_chunk", "chunk_no", "bytes", "sha1_so_far"])


CHUNKED = "page_id long, mark long, url string, record long, last_chunk int, chunk_no int, data binary, sha1_so_far string, bytes_so_far long"


def chunk_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, chunk: int) -> DataFrame:
    """CHUNKED rows of the pages, made in the scan. mark: a hash of the payload; record: a number that is the record's own within one job."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.xxhash64(F.coalesce(F.col(payload_col), F.lit(""))).alias("mark"),
        F.col(url_col).alias("url"),
        F.monotonically_increasing_id().alias("record"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    )
    return chunked(base, chunk).mapInArrow(_running_digests, CHUNKED)


def archive_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int, chunk: int) -> DataFrame:
    """ARCHIVE rows of the pages. The pages are read twice, first for the digests alone."""
    ends = chunk_rows(pages, id_col, url_col, payload_col, chunk).where("chunk_no = last_chunk")
    digests = cut(ends.select("page_id", "mark", F.col("bytes_so_far").alias("n_bytes"), F.col("sha1_so_far").alias("sha1")))
    types = classify(digests, min_bytes).withColumnsRenamed({"page_id": "_page_id", "mark": "_mark"})
    rows = chunk_rows(pages, id_col, url_col, payload_col, chunk)
    typed = rows.join(types.hint("shuffle_merge"), F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("mark") == F.col("_mark")))
    kept = typed.where("record_type = 'response' or chunk_no = 0")
    return kept.select("record", "page_id", "url", "n_bytes", "sha1", "record_type", "refers_to", "last_chunk", "chunk_no", "sha1_so_far", "data").mapInArrow(_serialize, ARCHIVE)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Write the pages' WARC records to the table at path."""
    archive_rows(pages, id_col, url_col, payload_col, min_bytes, chunk).write.option("compression", "zstd").parquet(path)


class RecordReader:
    """Feed it a record's chunks in order; it keeps the header's fields, a running SHA-1 and a count, never the payload."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.state, self.tail = b"", {}, 0, hashlib.sha1(), b""

    def feed(self, data: bytes) -> None:
        if not self.fields:
            self.head += data
            top, mark, data = self.head.partition(2 * CRLF)
            if not mark:
                return
            lines = top.split(CRLF)
            if lines[0] != b"WARC/1.1":
                raise ValueError("not a WARC/1.1 record")
            self.fields = dict(x.split(b": ", 1) for x in lines[1:])
            self.left = int(self.fields[b"Content-Length"])
        block, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(block)
        self.state.update(block)

    def result(self) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to), checked against what was read."""
        if self.left or self.tail != 2 * CRLF:
            raise ValueError("a record is cut short")
        f = self.fields
        kind, digest = f[b"WARC-Type"].decode(), f[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        if kind == "response" and base32_sha1(self.state) != digest:
            raise ValueError(f"record {f[b'WARC-Record-ID'].decode()}: the payload does not have its digest")
        number = lambda k: int(f[k]) if k in f else None
        return number(b"X-Page-ID"), int(f[b"X-Payload-Length"]), digest, kind, number(b"X-Refers-To-Page")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RESULT_TYPES = dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive rows, a record's chunks together and in order, to a row for each record."""
    reader, expected = RecordReader(), 0
    for batch in batches:
        out = []
        for k, last, data in zip(batch.column("chunk_no").to_pylist(), batch.column("last_chunk").to_pylist(), batch.column("bytes"), strict=True):
            if k == 0:
                reader = RecordReader()
            elif k != expected:
                raise ValueError("a record's chunk is missing")
            reader.feed(data.as_py())
            expected = k + 1
            if k == last:
                out.append(reader.result())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(RESULT_TYPES.values())], list(RESULT_TYPES))


def read_archive(archive: DataFrame) -> DataFrame:
    """Parse the records of an archive table. Only records of several chunks are moved, to bring their chunks together in order."""
    cols = archive.select("record", "last_chunk", "chunk_no", "bytes")
    short = cols.where("last_chunk = 0").mapInArrow(_parse, RESULT)
    long = cols.where("last_chunk > 0").repartition("record").sortWithinPartitions("record", "chunk_no").mapInArrow(_parse, RESULT)
    return short.unionByName(long)


def export_warc(archive: DataFrame, out: BinaryIO) -> int:
    """Write an archive table as one .warc stream, a chunk in memory at a time; the number of bytes."""
    n = 0
    for row in archive.orderBy("record", "chunk_no").select("bytes").toLocalIterator():
        n += out.write(row[0])
    return n


def read_warc(source: BinaryIO, piece: int = 1 << 16) -> Iterator[tuple]:
    """The records of a .warc stream, read piece by piece."""
    source = io.BufferedReader(source) if not hasattr(source, "peek") and isinstance(source, io.RawIOBase) else source
    while line := source.readline():
        reader, head = RecordReader(), line
        while (line := source.readline()) not in (CRLF, b""):
            head += line
        reader.feed(head + CRLF)
        while reader.left:
            if not (data := source.read(min(piece, reader.left))):
                break
            reader.feed(data)
        reader.feed(source.read(4))
        yield reader.result()


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write the pages as archives to the shared folder and read them back: RESULT rows, one per page. The archive is deleted then."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes, chunk)
    found = cut(read_archive(spark.read.schema(ARCHIVE).parquet(path)))
    remove(spark, path)
    return found
