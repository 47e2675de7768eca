"""Arrow-batch plumbing shared by the operators that run NumPy or native libraries."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, is_local, release

#: Bytes of text handled at once in a Python worker; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20

#: Two neighbouring white-space characters (or the separator itself): such texts are not cut.
_UNCUT = r"\x00|[\s\p{Z}\x0b\x1c-\x1f\x{85}]{2}"


def tidy() -> None:
    """Give freed memory back to the system: workers are reused, and the next stage needs it.

    Arrow's pool and the C library both keep what was freed; a library without ``malloc_trim``
    keeps its share.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


@functools.lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(None)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive pieces of about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(lengths, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)
    tidy()


def add_columns(df: DataFrame, column: str, make: Callable[[], Callable], fields: list[T.StructField], limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns computed from the text ``column`` by Arrow arrays.

    ``make()`` runs once a task and returns a function from a string array without nulls to one
    array for each of ``fields``. Columns of ``df`` with the names of ``fields`` are replaced.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    source = df
    if column not in {f.name for f in kept}:
        own = fresh([*df.columns, *names], "text")
        source, column = df.withColumn(own, df[column]), own
    schema = T.StructType([*kept, *fields])
    passed = [f.name for f in kept]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                made = work(pc.fill_null(part.column(column), ""))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in passed), *made], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def pieces(texts: pa.Array, whole: list[str] = ()) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """Cut texts where no pre-token of a byte-level tokenizer can cross.

    Returns the distinct pieces, how many of them are cut (the rest are whole texts), the piece
    numbers of all texts in a row, and each text's bounds in these numbers. Cuts are made only
    before a single space, around a single line feed, and between a letter or digit and a
    following stop or comma: the split pattern starts a new match there whatever stands further
    away. Texts with two white-space characters in a row, and those that hold one of the strings
    ``whole``, stay whole. Pieces of a text, joined, are the text.
    """
    n = len(texts)
    uncut = pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False)
    for string in whole:
        uncut = uncut | pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~uncut))
    plain = pc.replace_substring(plain, " ", "\0 ")
    plain = pc.replace_substring(plain, "\n", "\0\n\0")
    plain = pc.replace_substring_regex(plain, r"([\p{L}\p{N}])([.,])", "\\1\0\\2")
    lists = pc.split_pattern(plain, "\0")
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    values = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not uncut.any():
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return values, len(values), codes, offsets - offsets[0]
    counts = np.ones(n, np.int64)
    counts[~uncut] = np.diff(lists.offsets.to_numpy())
    offsets = np.concatenate([[0], np.cumsum(counts)])
    merged = np.empty(offsets[-1], np.int64)
    at = offsets[:-1][uncut]
    mask = np.ones(len(merged), bool)
    mask[at] = False
    merged[mask] = codes
    merged[at] = len(values) + np.arange(len(at))
    return values + texts.filter(pa.array(uncut)).to_pylist(), len(values), merged, offsets


def joined(parts: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each text, the concatenation of ``parts`` (lists or binaries) numbered by its codes."""
    taken = parts.take(pa.array(codes))
    at = taken.offsets.to_numpy()[offsets] if isinstance(taken, (pa.ListArray, pa.LargeListArray)) else None
    if at is not None:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), taken.values)
    bounds = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(bounds[offsets].astype(np.int32)), taken.buffers()[2]])


class Memory:
    """A bounded memo: two generations of at most ``size`` entries each."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def many(self, keys: list) -> list:
        """The values of keys, None for those not remembered; what was found stays longer."""
        out = list(map(self.new.get, keys))
        if self.old:
            for i, found in enumerate(out):
                if found is None and (found := self.old.get(keys[i])) is not None:
                    out[i] = found
                    self.put(keys[i], found)
        return out

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


_held: list = [None, None]


def resource(key: tuple, make: Callable):
    """``make()``, kept in this worker until another key is asked for.

    Workers serve one stage after another; this way they hold one operator's tables at a time.
    """
    if _held[0] != key:
        _held[:] = None, None
        tidy()
        _held[:] = key, make()
    return _held[1]


def _cores(spark: SparkSession) -> DataFrame:
    """A row for each core, each in a task of its own: as the cores are free, they are dealt to all executors."""
    tasks = 1 if is_local(spark) else spark.sparkContext.defaultParallelism
    return spark.range(0, tasks, 1, tasks)


def settle(spark: SparkSession) -> None:
    """Let executors give back what finished steps have left in their JVMs, before the next one.

    A JVM keeps the heap that a step has grown; Python workers of the next step come on top. A
    full collection returns most of the heap to the system. One short task a core, by DataFrame
    functions only, so steps that are to run without Python can settle too; executors that get
    no task keep their share.
    """
    release(spark)
    _cores(spark).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def unload(spark: SparkSession) -> None:
    """Let Python workers give back the tables of the operator before, for steps that run Python.

    One short task a core; workers that get none keep theirs until their next operator asks for
    its own or Spark ends them, after a minute without work.
    """

    def run(batches):
        resource((), tuple)
        yield from batches

    cores = _cores(spark)
    cores.mapInArrow(run, cores.schema).write.format("noop").mode("overwrite").save()
