"""WARC archives of pages, read back as a table of chunks.

Writing: each task streams its records into compressed WARC files, one gzip
member for each record.  Of records with equal payloads the one with the
smallest page_id holds the payload, the others are revisits that refer to it.

Reading: a file is decompressed as a stream and gives a row for each chunk of
a payload: record identifier, chunk number, the bytes, and the SHA-1 of the
payload so far.  The row of the last chunk thus has the digest of the whole,
and no task ever holds more than one chunk of a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, write_and_reload
from . import words

#: Bytes of payload in a row, and of compressed data after which a file is closed.
CHUNK, FILE_BYTES = 1 << 20, 256 << 20
_HEAD = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FILES = "file string, records long, bytes long"
_CHUNKS = ("file string, record_no long, record_id string, chunk_no long, data binary, payload_bytes long, digest string, last boolean, "
           "type string, stated_digest string, refers_to string")


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder and the path on it."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """(key, refers_to) for each distinct record key of pages: the page that has its payload first, or null.

    Payloads under ``least`` bytes are never revisits.
    """
    # only keys and digests are shuffled, summed up before
    keys = pages.select("page_id", "digest", "size").distinct()
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"))
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return keys.join(first, "digest").select("page_id", "digest", refers.alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return _HEAD + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> list[bytes]:
    """The parts of a WARC record; the payload's part is left out of a revisit."""
    kind = "response" if refers_to is None else "revisit"
    size = len(_HTTP) + (len(payload) if refers_to is None else 0)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
              ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Date", "2000-01-01T00:00:00Z"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(size))]
    if refers_to is not None:
        fields[2:2] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = [payload] if refers_to is None else []
    return [_header(fields), _HTTP, *body, b"\r\n\r\n"]


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to WARC files in ``folder``.

    Returns (file, records, bytes) of the files written; files of lost or
    repeated tasks are not among them.  A null html is an empty payload and a
    null url an empty address.  A null page_id is written as ``None`` and
    revisits like any other, but is never the smallest.  Equal (page_id, html)
    rows are all responses or all revisits; other columns are ignored; an
    empty table has no files.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    source = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"),
                          F.octet_length(html).alias("size"))
    part = roles(source, least)
    keyed = source.alias("s").join(
        part.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"),
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))

    def run(batches):
        out = None

        def close():
            out.close()
            return pa.record_batch([pa.array([x]) for x in (name, records, size)], names=["file", "records", "bytes"])

        name, records, size = "", 0, 0
        for b in words.slices(batches, "payload"):
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    store, root = open_store(folder)
                    store.create_dir(root)
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, payload, digest, refers_to = row
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in record(page_id, url, payload, base32(bytes.fromhex(digest)), refers_to):
                    for i in range(0, len(piece), CHUNK):
                        size += out.write(pack.compress(piece[i:i + CHUNK]))
                size += out.write(pack.flush())
                records += 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write_and_reload(keyed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, _FILES),
                            "warc-files")


def members(stream):
    """The decompressed pieces of a file of gzip members."""
    pack = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            piece = pack.decompress(raw, CHUNK)
            if piece:
                yield piece
            if pack.eof:
                raw, pack = pack.unused_data, zlib.decompressobj(31)
            else:
                raw = pack.unconsumed_tail


class _Reader:
    """Lines and bounded pieces of a stream of byte pieces."""

    def __init__(self, pieces):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def line(self) -> bytes | None:
        while b"\n" not in self.held:
            if not self._more():
                return None
        got, _, self.held = self.held.partition(b"\n")
        return got.rstrip(b"\r")

    def take(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("a WARC record ends early")
        got, self.held = self.held[:most], self.held[most:]
        return got


def chunks(stream, most: int = CHUNK):
    """Rows of a WARC file, in order: the columns of the chunk table after ``file``.

    Sizes and digests are of the payload up to and with the chunk;
    a payload without bytes has one chunk without bytes.
    """
    reader, record_no = _Reader(members(stream)), -1
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        record_no += 1
        fields = {}
        while line := reader.line():
            key, _, value = line.decode().partition(": ")
            fields[key.lower()] = value
        left = int(fields["content-length"])
        while True:  # the HTTP header
            line = reader.line()
            left -= len(line) + 2
            if not line:
                break
        name = lambda v: v and v.removeprefix("<urn:page:").removesuffix(">")
        about = (fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), name(fields.get("warc-refers-to")))
        digest, size, number, data, got = hashlib.sha1(), 0, 0, b"", 0
        while True:
            while left and got < most:
                piece = reader.take(min(left, most - got))
                left, got = left - len(piece), got + len(piece)
                data = data + piece if data else piece
            digest.update(data)
            size += got
            yield (record_no, name(fields["warc-record-id"]), number, data, size, base32(digest.copy().digest()), not left, *about)
            number, data, got = number + 1, b"", 0
            if not left:
                break


def read_chunks(files: DataFrame, folder: str, most: int = CHUNK) -> DataFrame:
    """The chunk table of WARC files: a row for each chunk, of at most ``most`` bytes, of each record (see the module)."""
    columns = [c.split()[0] for c in _CHUNKS.split(", ")]

    def run(batches):
        store, root = open_store(folder)
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for row in chunks(stream, most):
                        rows.append((file, *row))
                        held += len(row[3])
                        if held >= 4 * most or len(rows) >= 5000:
                            yield _batch(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, columns)

    # one file is one task's work: names are dealt evenly, not packed by size
    return files.select("file").repartition(
        max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(run, _CHUNKS)


def _batch(rows, columns) -> pa.RecordBatch:
    kinds = {"record_no": pa.int64(), "chunk_no": pa.int64(), "data": pa.binary(), "payload_bytes": pa.int64(), "last": pa.bool_()}
    return pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(columns, zip(*rows))], names=columns)


def records(chunk_table: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, payload_digest, type, refers_to): a row for each record, of its full payload.

    Sizes are summed from the chunks; the last chunk has the digest, which
    is null where it is not the stated one.  A revisit takes both from the response it refers to.
    """
    own = chunk_table.groupBy("file", "record_no").agg(
        *(F.max(c).alias(c) for c in ("record_id", "type", "stated_digest", "refers_to")),
        F.sum(F.octet_length("data")).alias("size"), F.max_by("digest", "chunk_no").alias("digest"))
    own = write_and_reload(own, "warc-records")  # the files are read once
    responses = own.where("type = 'response'").groupBy(
        F.col("record_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.max("size").alias("of_size"))
    found = own.join(responses, (F.col("refers_to") == F.col("of")) & (F.col("stated_digest") == F.col("of_digest")), "left")
    revisit = F.col("type") == "revisit"
    digest = F.when(revisit, F.col("of_digest")).otherwise(F.col("digest"))
    return found.select("record_id", F.when(revisit, F.col("of_size")).otherwise(F.col("size")).alias("payload_bytes"),
                        F.when(digest == F.col("stated_digest"), digest).alias("payload_digest"), "type", "refers_to")


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
