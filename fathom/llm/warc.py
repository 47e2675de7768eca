"""WARC archives: written with an index first, read back by sorted, coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .shared import filesystem, replaced, shared_folder, stored

#: Payloads of equal content are written once from this size on.
REVISIT_BYTES = 1000
#: Records less than a gap apart are read at once, up to a limit; blocks of this size are one task's unit.
GAP_BYTES, READ_BYTES, BLOCK_BYTES = 64 << 10, 4 << 20, 8 << 20
#: The archive holds no crawl times, so every record has this date.
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to`` of each page.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id
    is written; the others refer to it. The digests that occur more than once are aggregated
    and stored first, so the join sees two plain tables: it is broadcast only below the session's
    size threshold, and otherwise AQE can split the rows of a hot payload.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    twice = large.groupBy("payload_digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    twice = stored(twice.select(F.col("payload_digest").alias("_digest"), "target"), "warc-repeated")
    kept = rows.join(twice, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    return kept.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(~F.col("target").eqNullSafe(F.col("page_id")), F.col("target")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """``(page_id, url, payload, payload_bytes, digest, type, refers_to)`` of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda key: int(fields[key][10:-1]) if fields.get(key, "<urn:page:>") != "<urn:page:>" else None
    digest, kind = fields["WARC-Payload-Digest"][5:], fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of {fields['WARC-Record-ID']}")
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind, number("WARC-Refers-To")


def _write_part(batches, path: str):
    offset = 0
    with replaced(path) as out:
        for batch in batches:
            for part in slices(batch, "html"):
                rows, frames = [], []
                for page_id, url, html, size, digest, target in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"))):
                    frame = gzip.compress(record(page_id, url, html, size, digest, target), 3, mtime=0)
                    rows.append((path, offset, len(frame), url, digest, page_id, "response" if target is None else "revisit", target))
                    frames.append(frame)
                    offset += len(frame)
                out.write(b"".join(frames))
                yield _batch(rows, [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a gzip-compressed WARC file for each task; return the stored index.

    Null html is an empty payload; a null page_id or url is an empty field. Rows with the same
    largest page_id and payload (ties, repeated rows) are all responses. A very long payload is
    one record. Only the three columns are read, so others may have any names. An empty table
    gives an empty index and no file. Files carry the number of the task attempt,
    so that an attempt that lost never replaces bytes which the index describes.
    """

    def run(batches):
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            context = TaskContext.get()
            path = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
            yield from _write_part((b for bs in ([first], batches) for b in bs), path)

    return stored(decided(pages).mapInArrow(run, INDEX), "warc-index")


def _ranges(rows: list[tuple[str, int, int]]):
    """Groups of sorted (file, offset, length) rows to read at once."""
    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES or row[1] + row[2] - group[0][1] > READ_BYTES):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _read_part(batches):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    opened: tuple = (None, None)
    for batch in batches:
        for group in _ranges(list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))):
            if opened[0] != group[0][0]:
                system, path = filesystem(group[0][0])
                opened = group[0][0], system.open_input_file(path)
            start, end = group[0][1], group[-1][1] + group[-1][2]
            data = opened[1].read_at(end - start, start)
            yield _batch([parsed(gzip.decompress(data[at - start : at - start + size])) for _, at, size in group], fields)


def read(index: DataFrame) -> DataFrame:
    """The records that ``index`` (any selection of rows of it) names, verified by digest.

    Rows are dealt by blocks of a file and sorted by offset; ranges close to each other are one
    read. There is a task for each ``BLOCK_BYTES`` of the records, however small the index rows
    are. A repeated index row reads its record again; an empty index gives an empty table.
    """
    block = F.floor(F.col("offset") / BLOCK_BYTES)
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // BLOCK_BYTES
    dealt = index.select("file", "offset", "length", block.alias("block")).repartition(tasks, "file", "block").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read_part, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read every record back; ``folder`` defaults to a shared one."""
    return read(write(pages, folder or shared_folder(pages.sparkSession, "warc")))
