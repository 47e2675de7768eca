"""Token ids in length-delimited binary files with a separate offset index.

A data file is a header and one record for each document: length (u64), masked checksum of the
length (u32), payload, masked checksum of the payload (u32), all little-endian. A payload is
the doc_id (i64) and the ids (u16 if the vocabulary allows, else u32). The index file beside it
holds, for each record, doc_id (i64), byte offset (u64), tokens before it in this file (u64) and
token count (u32), so that readers can shuffle records without scanning the data.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Memory, joined, pieces, resource, slices
from .shared import filesystem, replaced, shared_folder, stored

MAGIC = b"FTHMIDS1"
HEADER = struct.Struct("<8sII")
LENGTH = struct.Struct("<QI")
CHECK = struct.Struct("<I")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("before", "<u8"), ("count", "<u4")])
MEMO_PIECES = 250_000
#: Bytes read from a data file at once.
READ_BYTES = 4 << 20


def masked(data) -> int:
    """A CRC-32 rotated and shifted, so that checksums of data holding checksums stay strong."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class PieceEncoder:
    """The tokenizers library over distinct pieces, each encoded once while it is remembered.

    The library is used as it is: the strings of its added tokens, special ones too, are those
    tokens wherever they stand in a text. Texts that hold one are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.memo = Memory(MEMO_PIECES)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def ids(self, values: list[str], cut: int) -> list[bytes]:
        """The ids of pieces, as bytes of unsigned 32-bit integers; from ``cut`` on whole texts."""
        known = self.memo.many(values)
        hard = []
        tokenize, letters, put = self.model.tokenize, self.letters, self.memo.put
        for i, found in enumerate(known):
            if found is None:
                value = values[i]
                if i < cut and (value.isalpha() or value[:1] == " " and value[1:].isalpha()):  # one pre-token
                    symbols = value if value.isascii() and value[0] != " " else value.encode().decode("latin1").translate(letters)
                    found = known[i] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
                    if len(value) <= 64:
                        put(value, found)
                else:
                    hard.append(i)
        for i, found in zip(hard, self.tokenizer.encode_batch_fast([values[i] for i in hard], add_special_tokens=False) if hard else []):
            known[i] = array("I", found.ids).tobytes()
            if len(values[i]) <= 64:
                put(values[i], known[i])
        return known

    def encode(self, texts: pa.Array) -> pa.ListArray:
        values, cut, codes, offsets = pieces(texts, self.added)
        known = self.ids(values, cut)
        bounds = np.concatenate([[0], np.cumsum(list(map(len, known)), dtype=np.int64)]) // 4
        flat = pa.array(np.frombuffer(b"".join(known), np.int32))
        return joined(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat), codes, offsets)


def _write_shard(batches, shard: int, path: str, tokenizer: str, end_id: int):
    """Write one task's rows to its data and index file; yield the row that describes them."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    encoder = resource(("token files", tokenizer), lambda: PieceEncoder(tokenizer))
    kind = np.dtype("<u2" if encoder.width == 2 and end_id < 1 << 16 else "<u4")
    rows = []
    offset, before = HEADER.size, 0
    with replaced(path) as out:
        out.write(HEADER.pack(MAGIC, kind.itemsize, 0))
        for batch in (b for bs in ([first], batches) for b in bs):
            for part in slices(batch, "text"):
                ids = encoder.encode(part.column("text").fill_null(""))
                flat, bounds = ids.values.to_numpy().astype(kind), ids.offsets.to_numpy()
                frames = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds, bounds[1:]):
                    payload = b"".join((doc.to_bytes(8, "little", signed=True), flat[a:b].tobytes(), end_id.to_bytes(kind.itemsize, "little")))
                    length = len(payload).to_bytes(8, "little")
                    frames += (length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload)))
                    rows.append((doc, offset, before, b - a + 1))
                    offset += len(payload) + LENGTH.size + CHECK.size
                    before += int(b - a) + 1
                out.write(b"".join(frames))
    with replaced(path[:-3] + "idx") as out:
        out.write(np.array(rows, INDEX).tobytes())
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(rows)], "n_tokens": [before]})


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode the texts and write data and index files in ascending doc_id order.

    Rows are dealt by ranges of doc_id, then of a hash of the text, and sorted, so file number
    order is doc_id order and many rows of one doc_id take several files; rows of one doc_id
    follow each other (ties: by that hash, then by text), null ids come first and are stored as
    the least 64-bit integer. A null or empty text has only the end id; a very long one is one
    record. Other columns of ``df``, whatever their names, are left out. Returns one row a file:
    ``shard, path, n_docs, n_tokens``, as a written table; an empty table gives no file. Files
    carry the number of the task attempt, so a doubled attempt leaves files that nothing names.
    """
    rows = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{folder}/ids-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        yield from _write_shard(batches, context.partitionId(), path, tokenizer, end_id)

    return stored(sorted_rows.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "shards")


def records(path: str):
    """Yield ``(doc_id, before, ids)`` of a data file by its index, checking every checksum."""
    system, name = filesystem(path)
    with system.open_input_file(name[:-3] + "idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with system.open_input_file(name) as f:
        magic, width, _ = HEADER.unpack(f.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        kind = np.dtype(f"<u{width}")
        at = 0
        while at < len(index):
            start = int(index["offset"][at])
            last = max(at + 1, int(np.searchsorted(index["offset"], start + READ_BYTES)))
            end = int(index["offset"][last]) if last < len(index) else f.size()
            data = memoryview(f.read_at(end - start, start))
            for row in index[at:last]:
                own = int(row["offset"]) - start
                length, check = LENGTH.unpack_from(data, own)
                payload = data[own + LENGTH.size : own + LENGTH.size + length]
                if check != masked(data[own : own + 8]) or CHECK.unpack_from(data, own + LENGTH.size + length)[0] != masked(payload):
                    raise ValueError(f"{path}: damaged record at {int(row['offset'])}")
                yield int(row["doc_id"]), int(row["before"]), np.frombuffer(payload[8:], kind)
            at = last


def _read_shard(path: str, base: int):
    block, size = [], 0
    for doc, before, ids in records(path):
        block.append((doc if doc > -(2**63) else None, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32)))
        size += len(ids)
        if size > 1 << 20:
            yield _batch(block)
            block, size = [], 0
    if block:
        yield _batch(block)


def read(shards: DataFrame) -> DataFrame:
    """The documents of :func:`write`'s files: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the CRC-32 of the ids as
    little-endian unsigned 32-bit integers. What the driver holds is one small row for each file.
    """
    spark = shards.sparkSession
    files = shards.orderBy("shard").collect()
    base, rows = 0, []
    for f in files:
        rows.append((f.path, base))
        base += f.n_tokens
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _read_shard(path, base)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, count, crc, ids = zip(*rows)
    bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def round_trip(df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``df``'s documents and read them back; ``folder`` defaults to a shared one."""
    return read(write(df, folder or shared_folder(df.sparkSession, "token-files"), tokenizer, end_id))
