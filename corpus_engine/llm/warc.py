"""WARC archives as chunked record tables.

A record table has one row per chunk: ``record_id, uri, chunk_no, n_chunks, payload_bytes, data``, in order within its
partition and at most ``CHUNK_BYTES`` a row. Digests are carried on from chunk to chunk, the writer compresses chunk
by chunk and the reader hands on what it has decompressed, so no step but the caller's own holds a whole payload.

Archives are sets of files with one gzip member per record. A task writes files under names of its own and hands on
their list; the list, written as a table when all tasks are done, is what the reader goes by. Files of tasks that
were lost or run twice are not on it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 18
DATE = "2000-01-01T00:00:00Z"
DIGESTS = "record_id string, uri string, payload_bytes long, payload_digest string"
FILES = "path string, records long, bytes long"
CHUNKS = (
    "record_id string, uri string, record_type string, refers_to string, chunk_no int, data binary, "
    "digest_so_far string, last boolean, payload_bytes long, payload_digest string, stated_digest string"
)
#: Fixed values of the format.
VERSION = "WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_LIMIT = 1 << 20


def chunk_rows(records: DataFrame, record_id: Column, uri: Column, payload: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of records whose payload (string or binary, null: empty) is one value; an empty one has one chunk."""
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    cut = records.select(record_id.alias("record_id"), uri.alias("uri"), data.alias("payload"))
    size = F.octet_length("payload")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(size / chunk_bytes).cast("int") - 1, F.lit(0)))
    cut = cut.select("record_id", "uri", "payload", F.explode(numbers).alias("chunk_no"))
    return cut.select(
        "record_id",
        "uri",
        "chunk_no",
        F.greatest(F.ceil(size / chunk_bytes).cast("int"), F.lit(1)).alias("n_chunks"),
        size.cast("long").alias("payload_bytes"),
        F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"),
    )


def base32_of(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def payload_digests(chunks: DataFrame) -> DataFrame:
    """``record_id, uri, payload_bytes, payload_digest`` of each record (bare upper-case base32 SHA-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha1()
        for batch in batches:
            rows = []
            ids, uris, no, n, size, data = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                if no[i].as_py() == 0:
                    digest = hashlib.sha1()
                digest.update(memoryview(data[i].as_buffer()))
                if no[i].as_py() == n[i].as_py() - 1:
                    rows.append((ids[i].as_py(), uris[i].as_py(), size[i].as_py(), base32_of(digest)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))],
                    names=["record_id", "uri", "payload_bytes", "payload_digest"],
                )

    return chunks.mapInArrow(run, DIGESTS)


def first_copies(digests: DataFrame, order: Column, least_bytes: int = 0) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``: of records with equal payloads the first by ``order`` is the response.

    Payloads below ``least_bytes`` are all responses. Copies are first counted within tasks, and only digests that
    occur twice are joined back, so a payload that a third of all records share meets one small row.
    """
    keyed = digests.withColumn("_first", F.struct(order.alias("order"), F.col("record_id")))
    firsts = (
        keyed.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("_first").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("first.record_id").alias("_to"))
    )
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    again = F.col("_to").isNotNull() & (F.col("_to") != F.col("record_id"))
    return (
        keyed.join(firsts, same, "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("_to")))
        .drop("_digest", "_bytes", "_to", "_first")
    )


def urn(record_id: str) -> str:
    return f"<urn:record:{quote(record_id, safe='')}>"


def header(row: dict, date: str) -> bytes:
    """The WARC header and the HTTP header of one record."""
    length = len(HTTP) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    lines = [
        VERSION,
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {urn(row['record_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    if row["uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['uri'], safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {urn(row['refers_to'])}", f"WARC-Profile: {REVISIT}", "WARC-Truncated: length"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def write_archives(chunks: DataFrame, decisions: DataFrame, folder: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records to ``folder`` and returns the list of files, which is stored under ``folder/list``.

    ``decisions`` has ``record_id, record_type, refers_to, payload_digest``. Payloads meet them in one shuffle by
    chunks; a file is closed when it has reached ``file_bytes``.
    """
    chosen = decisions.select(F.col("record_id").alias("_id"), "record_type", "refers_to", "payload_digest").dropDuplicates(["_id"])
    rows = (
        chunks.join(chosen, F.col("record_id") == F.col("_id"))
        .filter((F.col("record_type") == "response") | (F.col("chunk_no") == 0))
        .withColumn("data", F.when(F.col("record_type") == "response", F.col("data")))
        .select("record_id", "chunk_no", "n_chunks", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "data")
        .sortWithinPartitions("record_id", "chunk_no")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": pa.array([f"{folder}/{name}"]), "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )

        packer, before = None, None
        for batch in batches:
            heads = batch.select([0, 1, 2, 3, 4, 5, 6, 7]).to_pylist()
            data = batch.column(8)
            for i, row in enumerate(heads):
                if before == (before := (row["record_id"], row["chunk_no"])):
                    continue  # a repeated row
                if row["chunk_no"] == 0:
                    if out is not None and size >= file_bytes:
                        yield done()
                        out = None
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                    size += put(packer.compress(header(row, date)))
                    records += 1
                if data[i].is_valid:
                    size += put(packer.compress(memoryview(data[i].as_buffer())))
                if row["record_type"] == "revisit" or row["chunk_no"] == row["n_chunks"] - 1:
                    size += put(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            yield done()

    rows.mapInArrow(run, FILES).write.parquet(f"{folder}/list")
    return chunks.sparkSession.read.schema(FILES).parquet(f"{folder}/list")


class Unpacked:
    """Bytes of a stream of gzip members (or plain bytes), read on demand with a buffer of bounded size."""

    def __init__(self, stream, read_bytes: int):
        self.stream, self.read_bytes, self.held, self.rest, self.member = stream, read_bytes, bytearray(), b"", None
        self.plain: bool | None = None

    def more(self) -> bool:
        raw = self.rest or self.stream.read(self.read_bytes)
        self.rest = b""
        if not raw:
            return False
        if self.plain is None:
            self.plain = raw[:2] != b"\x1f\x8b"
        if self.plain:
            self.held += raw
            return True
        self.member = self.member or zlib.decompressobj(31)
        self.held += self.member.decompress(raw, self.read_bytes)
        if self.member.eof:
            self.rest, self.member = self.member.unused_data, None
        else:
            self.rest = self.member.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What precedes ``mark``, which is read too; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > HEAD_LIMIT:
                raise ValueError("a record header is longer than the limit")
            if not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def up_to(self, n: int) -> bytes:
        """Between 1 and ``n`` bytes; none at the end."""
        while not self.held and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records_of(stream, chunk_bytes: int, read_bytes: int = READ_BYTES) -> Iterator[dict]:
    """Chunk rows of one archive; an incomplete last record ends without a ``last`` row."""
    source = Unpacked(stream, read_bytes)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if lines == [""]:
            continue  # the end of the record before
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields.get("content-length", 0))
        if left and "application/http" in fields.get("content-type", ""):
            http = source.until(b"\r\n\r\n")
            left -= len(http or b"") + 4
        kind = fields.get("warc-type")
        row = {
            "record_id": named(fields.get("warc-record-id")),
            "uri": fields.get("warc-target-uri"),
            "record_type": kind,
            "refers_to": named(fields.get("warc-refers-to")),
            "stated_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        if kind == "revisit":
            stated = fields.get("x-payload-length")
            yield row | {
                "chunk_no": 0, "data": None, "digest_so_far": None, "last": True,
                "payload_bytes": int(stated) if stated else None, "payload_digest": row["stated_digest"],
            }
            continue
        digest, size, no, complete = hashlib.sha1(), 0, 0, True
        while True:
            part = bytearray()
            while left and len(part) < chunk_bytes and (got := source.up_to(min(left, chunk_bytes - len(part)))):
                part += got
                left -= len(got)
            complete = not left or len(part) == chunk_bytes
            digest.update(part)
            size += len(part)
            last = not left
            yield row | {
                "chunk_no": no, "data": bytes(part), "digest_so_far": base32_of(digest), "last": last,
                "payload_bytes": size, "payload_digest": base32_of(digest) if last else None,
            }
            no += 1
            if last or not complete:
                break


def named(value: str | None) -> str | None:
    if value is None:
        return None
    return unquote(value.strip("<>").removeprefix("urn:record:"))


def read_archives(spark: SparkSession, files: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of the listed archives (``path``), a file being one task's stream.

    ``digest_so_far`` and ``payload_bytes`` run along the chunks of a record; its ``last`` row has the digest of the
    whole payload, to be held against ``stated_digest``. A revisit has one row without data, with the digest and
    length that it states. Without data the rows are light enough to check archives of any size.
    """
    schema = CHUNKS if with_data else CHUNKS.replace("data binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, held = [], 0
                    for row in records_of(stream, chunk_bytes):
                        if with_data or row["last"]:
                            rows.append(row)
                            held += len(row["data"] or b"") if with_data else 0
                        if held > 8 * chunk_bytes or len(rows) >= 4096:
                            yield packed(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield packed(rows, names)

    paths = files.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, schema)


ARROW = {"chunk_no": pa.int32(), "data": pa.binary(), "last": pa.bool_(), "payload_bytes": pa.int64()}


def packed(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], ARROW.get(n, pa.string())) for n in names], names=names)


def archive(records: DataFrame, record_id: Column, order: Column, uri: Column, payload: Column, folder: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes one WARC record per row of ``records`` to ``folder`` and returns the list of files.

    ``record_id`` must tell rows apart: rows equal in it are one record and must have one payload. ``order`` (computed
    from the ``record_id`` column) decides which of several equal payloads is the response. Null payloads are empty;
    a null uri is left out of the header. An empty table gives an empty list.
    """
    chunks = chunk_rows(records, record_id, uri, payload, chunk_bytes)
    decisions = first_copies(payload_digests(chunks), order, least_bytes)
    return write_archives(chunks, decisions, folder)
