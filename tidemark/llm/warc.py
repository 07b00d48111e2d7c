"""WARC archives compressed with Zstandard: one frame per record, dictionary in front.

An archive begins with a skippable frame that holds the dictionary.  The reader loads it,
decodes one frame per record, and refuses a record whose header, lengths or digest do not
agree.  Of the pages with equal payloads that of the smallest id is a response, the others
are revisits that refer to it; the digest groups are reduced before pages move.

Archives lie in the folder that the cluster shares, one for each task that wrote.  A task
writes under a name of its own and renames at the end, so a task that is run again or lost
leaves no part of an archive behind.

Defined results: a null html is an empty payload; pages without an id are written as
responses and read back without one; repeated rows are written row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_batches
from tidemark.llm.shared import new_path, written

#: Fixed value of the format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
DATE = b"2024-01-01T00:00:00Z"
#: Pages of the sample on which the dictionary is trained, and the bytes of the dictionary.
SAMPLE_PAGES, DICTIONARY_BYTES = 500, 32_768
#: Bytes that the reader takes from a file at once.
READ_BYTES = 1 << 17
NEEDED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest", b"x-payload-length")


class BadArchive(ValueError):
    """An archive or a record that does not agree with itself."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload of its own."""
    digest = sha1_base32(payload)
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode()), b"WARC-Date: " + DATE]
    head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20]", b"%20", (url or "").encode()))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    head.append(b"X-Payload-Length: %d" % len(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
        block = http
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: list[bytes]) -> dict[bytes, bytes]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"header line without a colon: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def page_of(uri: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d*)>", uri)
    if not m:
        raise BadArchive(f"record id: {uri[:80]!r}")
    return int(m[1]) if m[1] else None


def parsed(data: bytes) -> dict:
    """A validated record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise BadArchive(f"no {VERSION.decode()} header: {data[:40]!r}")
    told = headers(lines)
    if missing := [n.decode() for n in NEEDED if n not in told]:
        raise BadArchive(f"headers are missing: {missing}")
    n = int(told[b"content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {n}, but the frame has {len(rest) - 4} bytes")
    block = rest[:n]
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header in the block")
    length = int(told[b"x-payload-length"])
    if int(headers(lines).get(b"content-length", b"-1")) != length:
        raise BadArchive("the HTTP length is not that of the record")
    kind, digest = told[b"warc-type"].decode(), told[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length or sha1_base32(payload) != digest:
            raise BadArchive("the payload has another length or digest than its header")
    elif kind == "revisit":
        if payload or b"warc-refers-to" not in told:
            raise BadArchive("a revisit with a payload, or without a record that it refers to")
    else:
        raise BadArchive(f"record type {kind}")
    return {"page_id": page_of(told[b"warc-record-id"]), "url": told.get(b"warc-target-uri", b"").decode(), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page_of(told[b"warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of an archive that comes in pieces of any size."""
    held = b""
    while len(held) < 8 and (more := next(chunks, b"")):
        held += more
    if not held:
        return
    magic, n = struct.unpack("<II", held[:8].ljust(8, b"\0"))
    if magic != DICTIONARY_MAGIC:
        raise BadArchive("no dictionary frame in front")
    while len(held) < 8 + n and (more := next(chunks, b"")):
        held += more
    if len(held) < 8 + n:
        raise BadArchive("the dictionary frame is cut off")
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held[8 : 8 + n])) if n else zstandard.ZstdDecompressor()
    held = held[8 + n :]
    while held or (held := next(chunks, b"")):
        frame, out = context.decompressobj(), []
        while True:
            out.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            if not (held := next(chunks, b"")):
                raise BadArchive("the last frame is cut off")
        yield parsed(b"".join(out))


def dictionary(pages: DataFrame, html_col: str, rows: int = SAMPLE_PAGES) -> bytes:
    """Trained on a bounded sample; from few pages their text itself. It changes the size of archives, never what is read back."""
    sample = [record(0, "", (r[0] or "").encode(), None) for r in pages.select(html_col).where(F.octet_length(html_col) < 65_536).limit(rows).collect()]
    if not sample:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, url, html and refers_to.

    Groups of equal payloads are found on digests alone, so a popular payload gathers short rows only, which partial
    aggregates and skewed joins take; the pages themselves meet their own reference by id and digest.
    """
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    bare = keyed.select("page_id", "sha", "n").where((F.col("n") >= least) & F.col("page_id").isNotNull()).distinct()
    firsts = bare.groupBy("sha", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisits = bare.join(firsts, ["sha", "n"]).where("page_id > refers_to")
    return keyed.join(revisits, ["page_id", "sha", "n"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, level: int = 3) -> DataFrame:
    """Writes pages as archives under path; returns their table (archive, n_records). least: bytes from which equal payloads are revisits."""
    trained = dictionary(pages, html_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(path)
        name, n, out = uuid.uuid4().hex, 0, None
        context = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}.part", compression=None)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
                out.write(context.compress(record(page_id, url, html.encode(), refers_to)))
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{top}/{name}.part", f"{top}/{name}.warc.zst")
            yield pa.record_batch([pa.array([f"{path}/{name}.warc.zst"]), pa.array([n], pa.int64())], names=["archive", "n_records"])

    rows = with_revisits(pages, id_col, url_col, html_col, least)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return written(rows.mapInArrow(write, "archive string, n_records long"), "archives")


FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, n_archives: int, payloads: bool = True) -> DataFrame:
    """The records of a table of archives (archive), one task for each; refuses archives that are not in order."""
    fields = FIELDS if payloads else pa.schema(list(FIELDS)[:-1])
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def pieces(path: str) -> Iterator[bytes]:
        fs, at = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(at, compression=None) as f:
            while data := f.read(READ_BYTES):
                yield data

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for found in records(pieces(path)):
                    held.append({n: found[n] for n in fields.names})
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema=fields)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=fields)

    return archives.select("archive").repartition(max(n_archives, 1), "archive").mapInArrow(read, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_archives(archives, archives.count(), payloads=False).drop("url")
