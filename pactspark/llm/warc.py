r"""WARC archives: written record by record, read sequentially.

Each record is a gzip member of its own. The reader feeds small pieces of a file to a
zlib decompressor, frames each record by its Content-Length, never holds more than a
record, checks that nothing follows the frame but its two line breaks, and verifies
block and payload digests. An archive that ends inside a record raises, wherever it was
cut, and so does one that is no gzip file or no WARC file.

Archives of other writers are read too: every record type comes back with its own
``record_type``; record ids of any form stand in ``record_id`` and ``refers_to_id``, while
``page_id`` and ``refers_to`` are set only for ids of our own form; digests are verified
where they are given and their algorithm is known (hexadecimal or base32); a chunked body
is put together, and its digest may be of either form; the payload of a record that holds
no HTTP message is its block; a record marked as truncated may be shorter than its HTTP
length. ``payload_digest`` is the SHA-256 of the payload where there is one, else what the
record states.

Writing: of rows with equal payloads of at least ``MIN_PAYLOAD`` bytes, the one with the
smallest page_id is a response; the others are revisits, which carry the HTTP head (with
the full length) and the payload digest and refer to that response. Digests are grouped
with partial aggregates; rows are not moved unless the table of repeated digests is too
large to be broadcast. Tasks write files of up to ``ARCHIVE_BYTES`` under a name of their
attempt; the list of files is what the finished attempts return, so a task that is lost
leaves nothing that is read. Files lie in the shared folder, opened through Arrow's file
systems by their URI.

Defined cases: null html is empty; a null url leaves out the target header; control
characters in a url are percent-coded; a null page_id is written as an empty id, is always
a response and comes back as null; of equal rows all with the smallest page_id are
responses; an empty table gives one empty list of archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm.common import no_text
from pactspark.session import materialise, scratch_path

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES = 64 * 1024
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # a fixed date: reruns write the same bytes
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(reference: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", reference or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def members(file: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of a file, one after the other, decompressed piece by piece."""
    unpack, parts, rest, begun = zlib.decompressobj(31), [], b"", False
    while piece := rest or file.read(read_bytes):
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as error:
            raise ValueError(f"not a gzip member: {error}") from error
        begun, rest = True, unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a record")


def headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank continues the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "surrogateescape")).split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def count_of(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch("[0-9]+", value) else None


def agrees(stated: str, *contents: bytes) -> bool:
    """Whether a stated digest (``algorithm:value``) is that of one of the contents; an unknown algorithm is taken on trust."""
    algorithm, _, value = stated.partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in hashlib.algorithms_guaranteed or algorithm.startswith("shake"):
        return True
    digests = [hashlib.new(algorithm, c).digest() for c in contents]
    return value.lower() in {d.hex() for d in digests} or value.upper().rstrip("=") in {base64.b32encode(d).decode().rstrip("=") for d in digests}


def unchunked(body: bytes) -> bytes | None:
    """A chunked body put together, or None where its framing is wrong."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;|$)", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), end + 2
        if not n:
            return b"".join(parts)
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        parts.append(body[at:at + n])
        at += n + 2


def parsed(member: bytes) -> dict:
    """A record's fields; raises where framing or a digest is wrong."""
    head, end, rest = member.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not end:
        raise ValueError("not a WARC record")
    fields = headers(head)
    name, length, kind = fields.get("warc-record-id"), count_of(fields.get("content-length")), fields.get("warc-type", "unknown").lower()
    if length is None or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {name}: its length is not {fields.get('content-length')}")
    block = rest[:length]
    if not agrees(fields.get("warc-block-digest", ""), block):
        raise ValueError(f"record {name}: block digest differs")
    http, size, payload, stored = {}, None, block, block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, stored = block.partition(b"\r\n\r\n")
        http, payload = headers(head), stored
        size = count_of(http.get("content-length"))
        if "chunked" in http.get("transfer-encoding", "").lower():
            whole = unchunked(stored)
            payload, size = (stored if whole is None else whole), None
    held = kind != "revisit"
    stated = fields.get("warc-payload-digest")
    if held and "warc-truncated" not in fields:
        if size is not None and kind == "response" and size != len(payload):
            raise ValueError(f"record {name}: payload differs from its length")
        if stated and not agrees(stated, payload, stored):
            raise ValueError(f"record {name}: payload differs from its digest")
    return {"record_id": name, "page_id": page_of(name), "url": fields.get("warc-target-uri"), "payload_bytes": len(payload) if held else size,
            "payload_digest": hashlib.sha256(payload).hexdigest() if held else (stated or "").removeprefix("sha256:") or None, "record_type": kind,
            "refers_to": page_of(fields.get("warc-refers-to")), "refers_to_id": fields.get("warc-refers-to"), "payload": payload if held else None}


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def originals(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(digest, first): payloads that stand on several pages, with the smallest page_id."""
    rows = pages.select("page_id", F.sha2(F.encode(no_text(F.col("html")), "utf-8"), 256).alias("digest")).where(F.octet_length(no_text(F.col("html"))) >= min_payload)
    return rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")


def write(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as archives below ``folder``; returns (path, records, bytes) per archive."""
    repeated = materialise(originals(pages, min_payload), "warc-repeats")
    rows = pages.select("page_id", "url", no_text(F.col("html")).alias("html")).withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    long_enough = F.octet_length("html") >= min_payload
    marked = rows.join(repeated, long_enough & (F.col("digest") == F.col("_digest")), "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        done, out, path, size, count = [], None, "", 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    if out is None:
                        path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(path, compression=None)
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((path, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        columns = zip(*done) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialise(marked.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-list")


def read(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives listed in ``archives`` (path), an archive per task at a time."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
    if not payloads:
        schema = schema.remove(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path, compression=None) as file:
                    held, size = [], 0
                    for member in members(file):
                        held.append(parsed(member))
                        size += len(member) if payloads else 1000
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    out = "record_id string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, refers_to_id string"
    tasks = max(spark.sparkContext.defaultParallelism, archives.count())
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, out + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the pages to the shared folder and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, folder, min_payload), folder, payloads=False)
