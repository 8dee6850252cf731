"""Operator 7, WARC: index first, then coalesced byte-range reads.

Writing: each task writes archives of gzip members, one member per record, under a temporary name and renames them when
complete, so a task that runs again replaces its files with the same bytes. It returns the index: archive, offset, length, URL
and digest of each record. Reading: selected index rows are dealt by stretches of an archive and sorted by offset; neighbours
with small gaps are read at once, and every payload is checked against its digest. Files are opened through
``pyarrow.fs``, which knows local and cluster stores; the folder must be one that driver and executors share.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest page_id is a response and
the others revisits without payload; a revisit's header names that page, the digest and the payload's length. Records meet
by digest. Digests of more than 1 / HOT_PARTS of all rows are found first; their revisits, known without meeting the response,
are dealt by page and leave their payload behind.

Defined cases: a null html is an empty payload; a null url is empty; shorter payloads are all responses; of repeated rows
with the smallest page_id one is the response and the others revisit it; a null page_id is larger than all others; an empty
table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import HOT_PARTS, shared_folder, stored

MIN_REVISIT = 100
# Characters of a URL that a header line holds as they are.
SAFE = "".join(map(chr, range(33, 127)))
ARCHIVE_BYTES, STRETCH_BYTES = 256 << 20, 16 << 20
MAX_GAP, MAX_RANGE = 64 << 10, 8 << 20
INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """Store and path of a URI, or of a local path."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def response_id(page_id: int | None, digest: str) -> str:
    """Record id of the response that revisits of a digest refer to: there is one per digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response {page_id} {digest}')}>"


def record(page_id: int | None, url: str, digest: str, size: int, payload: bytes | None, refers_to: int | None, place: str, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit where there is no payload. ``place``: archive and offset, which no other record has."""
    own = response_id(page_id, digest) if payload is not None and size >= MIN_REVISIT else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {own}",
        f"WARC-Target-URI: {quote(url, safe=SAFE)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {response_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    block = payload or b""
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a gzip member with one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(headers["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    return headers, rest[:length]


class ArchiveWriter:
    """Archives of one task, each complete or absent under its final name."""

    def __init__(self, folder: str, task: int, attempt: int):
        self.store, self.path = open_folder(folder)
        self.store.create_dir(self.path, recursive=True)
        self.folder, self.task, self.attempt, self.count, self.stream = folder, task, attempt, 0, None

    def place(self) -> str:
        """Archive and offset of the next record, whatever the folder; opens the archive."""
        if self.stream is not None and self.at >= ARCHIVE_BYTES:
            self.close()
        if self.stream is None:
            self.name, self.at = f"archive-{self.task:06d}-{self.count:04d}.warc.gz", 0
            self.stream = self.store.open_output_stream(f"{self.path}/{self.name}.{self.attempt}.part", compression=None)
        return f"{self.name} {self.at}"

    def write(self, member: bytes) -> tuple[str, int]:
        offset = self.at
        self.stream.write(member)
        self.at += len(member)
        return f"{self.folder}/{self.name}", offset

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        part, whole = f"{self.path}/{self.name}.{self.attempt}.part", f"{self.path}/{self.name}"
        if self.store.get_file_info(whole).type != pafs.FileType.NotFound:
            self.store.delete_file(whole)
        self.store.move(part, whole)
        self.stream, self.count = None, self.count + 1


def write_archives(pages: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Write all pages to ``folder``, and the index beside them; returns the index as read again. ``date``: of all records, by default now."""
    written_at = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")  # taken here, so that a task that runs again writes the same
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("hot_id"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1"))  # digests and two numbers
    bound = max(pages.count() // HOT_PARTS, 1)
    hot = groups.where(F.col("n") > bound).select("payload_digest", "hot_id")
    rows = rows.join(F.broadcast(hot), "payload_digest", "left")
    known = F.col("hot_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_id"))  # a revisit, without looking further
    key = F.xxhash64("payload_digest", F.when(known | (F.col("payload_bytes") < MIN_REVISIT), F.struct("page_id", "url")))
    rows = rows.withColumn("payload", F.when(~known, F.col("payload"))).withColumn("hot_id", F.when(known, F.col("hot_id")))
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, key).sortWithinPartitions("payload_digest", F.col("page_id").asc_nulls_last(), "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out = ArchiveWriter(folder, context.partitionId(), context.taskAttemptId())
        last, first = None, None
        for batch in batches:
            places = []
            for page_id, url, payload, digest, size, hot_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "hot_id")), strict=True):
                refers_to = hot_id
                if hot_id is None and size >= MIN_REVISIT:
                    if digest == last:
                        payload, refers_to = None, first
                    else:
                        last, first = digest, page_id
                member = record(page_id, url, digest, size, payload, refers_to, out.place(), written_at)
                places.append((*out.write(member), len(member)))
            if places:
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*places, strict=True)), *(batch.column(c) for c in ("page_id", "url", "payload_digest"))], ["archive", "offset", "length", "page_id", "url", "payload_digest"])
        out.close()

    dealt.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(places: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) joined to ranges (archive, start, end, members) across gaps of up to MAX_GAP."""
    current: list | None = None
    for archive, offset, length in places:
        if current and current[0] == archive and offset - current[2] <= MAX_GAP and offset + length - current[1] <= MAX_RANGE:
            current[2] = max(current[2], offset + length)
            current[3].append((offset, length))
        else:
            if current:
                yield tuple(current)
            current = [archive, offset, offset + length, [(offset, length)]]
    if current:
        yield tuple(current)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the selected index rows, payloads checked against their digests."""
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("archive", "offset", "length").repartition(partitions, "archive", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("archive", "offset")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True)

        opened, source = None, None
        for archive, start, end, members in coalesced(places()):
            if archive != opened:
                store, path = open_folder(archive)
                if source is not None:
                    source.close()
                opened, source = archive, store.open_input_file(path)
            stretch = memoryview(source.read_at(end - start, start))
            rows = []
            for offset, length in members:
                headers, block = parse(stretch[offset - start : offset - start + length])
                number = lambda name: int(headers[name]) if headers.get(name) else None
                digest, response = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "response"
                if response and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload doesn't have its digest")
                rows.append((number("X-Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], number("X-Refers-To-Page-ID"), digest, number("X-Payload-Length"), block if response else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
        if source is not None:
            source.close()

    return dealt.mapInArrow(run, RECORDS)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read all of them back, and describe each record."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4()}"
    records = read_records(write_archives(pages, folder))
    response = F.col("record_type") == "response"
    return records.select(
        "page_id", F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
