"""WARC archives with an index that is written first and steers the reads.

Writing gives, for each record, its file, offset, length, URL and digest as a
table. Reading takes any selection of that table, sorts it by place, joins
neighbouring byte ranges into one read each, and parses what they hold.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import slices
from wakeline.llm.files import Written, new_folder, opened
from wakeline.session import cut_lineage

FILE_BYTES = 64 << 20  # a task starts another file after so many
RUN_BYTES = 4 << 20  # most that one read asks for, unless a single record is longer
STRETCH_BYTES = 4 * RUN_BYTES  # of a file, dealt to one task together
TASK_BYTES = 64 << 20  # about what one task reads
GAP_BYTES = 64 << 10  # ranges no farther apart are read together
LEAST_BYTES = 0  # smaller payloads are never revisits

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # of records whose capture time is not known
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:wakeline:page:{}>"

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(text: str) -> str:
    """A header value: control characters as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _identifier(page_id: int | None) -> str:
    return RECORD_ID.format("" if page_id is None else page_id)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {"WARC-Type": kind, "WARC-Record-ID": _identifier(page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = _line(url)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _identifier(refers_to)}
    else:
        block += payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass")
    return gzip.compress(VERSION + lines + b"\r\n" + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode("latin-1").split("\r\n")[1:])}, payload


def decided(pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, sha1 (hex), first, n: of each different page and payload, the smallest page_id with that payload, and how many there are.

    `first` is null for payloads that are smaller than `least` or that one page
    only has. Payloads themselves are not moved.
    """
    payload = F.coalesce("html", F.lit(""))
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("bytes"))
    ids = cut_lineage(ids.groupBy("page_id", "sha1").agg(F.max("bytes").alias("bytes")))
    shared = ids.filter(F.col("bytes") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Stored, so that both sides of the join are shuffles whose hot digests Spark can split.
    return ids.join(cut_lineage(shared), "sha1", "left").select("page_id", "sha1", "first")


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_BYTES) -> DataFrame:
    """Write a record for each page below `folder`; returns the index (see INDEX).

    Of pages with equal payloads, the one with the smallest page_id is a
    response and the others revisit it; rows that repeat its page_id are
    responses too. A null html is an empty payload; a page without page_id
    comes after all others.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    known = decided(pages, least=least).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "first")
    joined = rows.join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    ordered = joined.select("page_id", "url", "payload", "sha1", "first").sortWithinPartitions(F.col("page_id").asc_nulls_last(), "sha1", "url")
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, out = TaskContext.get().partitionId(), 0, None
        for batch in slices(batches, "payload"):
            found = []
            for page_id, url, data, sha1, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "first"))):
                if out is None or out.size >= FILE_BYTES:
                    if out:
                        out.close()
                    name, n = f"pages-{task:06d}-{n:04d}.warc.gz", n + 1
                    out = Written(folder, name)
                kind = "response" if first is None or first == page_id else "revisit"
                digest = _base32(bytes.fromhex(sha1))
                record = _record(page_id, url, data, digest, kind, first)
                found.append((name, out.size, len(record), page_id, url, digest, kind))
                out.write(record)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names)
        if out:
            out.close()

    return cut_lineage(ordered.mapInArrow(write, INDEX))


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (offset, length) ranges joined where the gap is small, up to RUN_BYTES together: (first, one past the last) of each run."""
    runs: list[tuple[int, int]] = []
    start = end = 0
    first = 0
    for i, (offset, length) in enumerate(ranges):
        if i > first and (offset - end > GAP_BYTES or max(end, offset + length) - start > RUN_BYTES):
            runs.append((first, i))
            first = i
        start = offset if i == first else start
        end = offset + length if i == first else max(end, offset + length)
    if ranges:
        runs.append((first, len(ranges)))
    return runs


def read_archives(selected: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    Rows are dealt by stretches of files and sorted by offset. A response whose payload does
    not have the digest of its header is an error. A revisit has no payload; its
    size is in its HTTP header.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if with_payload:
        schema, kinds = f"{schema}, payload binary", [*kinds, pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def page(identifier: str | None) -> int | None:
        number = (identifier or "")[len(RECORD_ID) - 3 : -1]
        return int(number) if number else None

    def parsed(data: bytes) -> tuple:
        fields, http, payload = parse_record(zlib.decompress(data, wbits=31))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and _base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"{fields['warc-record-id']} is damaged")
        row = (page(fields["warc-record-id"]), fields.get("warc-target-uri"), int(http["content-length"]), digest, fields["warc-type"], page(fields.get("warc-refers-to")))
        return (*row, None if revisit else payload) if with_payload else row

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        file, handle = "", None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                stop = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
                if files[at] != file:
                    file, handle = files[at], system.open_input_file(f"{root}/{files[at]}")
                ranges = list(zip(offsets[at:stop], lengths[at:stop]))
                for a, b in coalesced(ranges):
                    start = ranges[a][0]
                    data = memoryview(handle.read_at(max(o + n for o, n in ranges[a:b]) - start, start))
                    rows = [parsed(data[o - start : o - start + n]) for o, n in ranges[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                at = stop

    # An explicit number of partitions: index rows are small, so adaptive coalescing would give one task gigabytes of archive.
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(-(-total // TASK_BYTES), selected.sparkSession.sparkContext.defaultParallelism)
    stretch = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    dealt = selected.select("file", "offset", "length").repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, schema)


def archived(pages: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Write all pages and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_archives(index, folder, with_payload=False).drop("url")
