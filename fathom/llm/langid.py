"""Language identification by hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1. An n-gram is the product of its letters' vectors,
each rotated by its place; a text is the sum of its n-grams; a language's prototype is the sum
over its training texts. A text gets the language whose prototype has the greatest cosine.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns, resource, slices

UNDETERMINED = "und"
DIMENSIONS = 512
ORDER = 3
#: Letters share vectors modulo this many; 0 stands for a gap between words.
LETTERS = 1024
#: Bytes of text handled at once; an n-gram costs several times its letter.
SLICE_BYTES = 2 << 20


@functools.lru_cache(maxsize=1)
def _places(dimensions: int) -> list[np.ndarray]:
    """Letter vectors, rotated for each place of an n-gram."""
    vectors = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))
    return [np.roll(vectors, ORDER - 1 - place, axis=1) for place in range(ORDER)]


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the texts in a row, and each text's bounds in them.

    Letters are lower-cased; a run of anything else is one gap; every text begins and ends with
    a gap. An n-gram belongs to its middle letter, so none reaches into another text.
    """
    listed = pc.utf8_lower(texts).to_pylist()
    starts = np.cumsum([0, *(len(t) + 1 for t in listed)])
    points = np.frombuffer("\n".join(["", *listed, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = (points % np.uint32(LETTERS - 1)).astype(np.int16) + np.int16(1)
    codes[~_is_letter()[points]] = 0
    keep = codes != 0
    middles = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[starts + 1]
    keep[1:] |= codes[:-1] != 0  # of neighbouring gaps the first stays
    keep[0] = True
    codes = codes[keep].astype(np.int32)
    grams = (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
    return grams[codes[1:-1] != 0], middles


def _bound(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of n-grams."""
    a, b, c = _places(dimensions)
    return a[grams // (LETTERS * LETTERS)] * b[grams // LETTERS % LETTERS] * c[grams % LETTERS]


def _bundle(grams: np.ndarray, counts: np.ndarray, dimensions: int) -> np.ndarray:
    total = np.zeros(dimensions)
    for at in range(0, len(grams), 4096):
        total += counts[at : at + 4096].astype(np.float32) @ _bound(grams[at : at + 4096], dimensions).astype(np.float32)
    return total


def train(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``df``: unit vectors.

    Every row counts, repeated ones too; rows with a null text or language add nothing, nor do
    texts without a letter. Very long texts count in full. Only the two columns are read, so
    others may have any names. Tasks send one vector for each language they saw, so the driver's
    share follows the number of languages only. An empty table gives no prototypes.
    """

    def run(batches):
        resource(("language",), tuple)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                grams, bounds = _grams(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                of = np.repeat(coded.indices.to_numpy(), np.diff(bounds))
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    found, counts = np.unique(grams[of == k], return_counts=True)
                    made = _bundle(found, counts, dimensions)
                    sums[name] = sums.get(name, 0) + made
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

    used = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = used.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    gathered = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv")).select("lang", F.transform("kv", lambda x: x.v).alias("v")).collect()
    out = {}
    for row in gathered:
        vector = np.array(row.v)
        if (norm := np.linalg.norm(vector)) > 0:
            out[row.lang] = vector / norm
    return dict(sorted(out.items()))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with ``pred`` (a language) and ``score``, the cosine cut to 0..1.

    A null or empty text, one without a letter, and any text if there are no prototypes give
    ``und`` and 0. Equal cosines give the language first in the alphabet. Whole texts count,
    however long. Rows are kept as they are, repeated ones too; columns with the names of the
    results are replaced, all others stay. An empty table gives an empty table.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))

    def make():
        resource(("language",), tuple)

        def work(texts):
            grams, bounds = _grams(texts)
            best, cosine = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if len(names):
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    vector = _bundle(*np.unique(grams[bounds[i] : bounds[i + 1]], return_counts=True), matrix.shape[1])
                    cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
                    k = int(np.argmax(cosines))
                    best[i], cosine[i] = names[k], min(1.0, max(0.0, float(cosines[k])))
            return [pa.array(best, pa.string()), pa.array(cosine)]

        return work

    return add_columns(df, text, make, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], SLICE_BYTES)
