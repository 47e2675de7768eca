"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A CGK walk reads a string through random bits: at each step it writes the current character and
moves on or not, by a bit that depends on step and character. Strings at small edit distance
fall back into step, so most written places agree, and edit distance becomes Hamming distance.
Each repeat samples places of a walk of its own as a key.

Every character of a text starts a window, and an item is filed under the walks from each of its
characters: a passage and its item meet wherever a stretch of the two agrees at the sampled places,
so each repeat has as many chances as the passage has stretches, and few repeats reach the
target recall. A meeting proposes the item-sized window in which item and text are aligned; one
block of it is compared by bit-parallel edit distance for all proposals at once, and what is left
is checked by the exact edit distance of the whole item.

Walks of all windows are taken together from their last step to their first: the key of a window
at a step is that of the same or the next character at the following step.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns, resource
from .shared import fresh

#: An item is in a text if a passage is within this share of its length in edits.
DISTANCE = 0.2
#: Keys of a window. Chosen for a recall of 0.95 of passages with random edits of DISTANCE itself.
REPEATS = 4
#: Least lengths of the classes of items, the steps of their walks, and how many of them are sampled.
CLASSES = ((10, 6, 6), (20, 10, 9), (40, 18, 16), (80, 24, 23))
#: Characters of an item that are compared first, and the edits in them that a proposal may have.
BLOCK, BLOCK_EDITS = 64, 20
#: Windows walked at once, and proposals compared at once; they bound the memory.
WINDOWS, PROPOSALS = 1 << 16, 1 << 13
#: Characters of the benchmark that a pass over the documents holds; a larger one takes several passes.
PASS_CHARS = 4 << 20
_LETTERS = 64
_SPREAD = np.uint32(0x9E3779B1)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, with single spaces for whatever is no letter or digit."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")


def edit_distance(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to a part of ``text``, and where that part ends.

    Bit-parallel dynamic programming: one integer holds a whole column.
    """
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        match = masks.get(c, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if now < best:
            best, end = now, k
    return best, end


class _Walk:
    """One repeat of a class: a walk, its sampled places, and the keys of the items."""

    def __init__(self, random: np.random.Generator, steps: int, places: int):
        # Half of a letter's bits are set, so that all walks reach about as far.
        bits = random.permuted(np.tile(np.arange(steps) % 2, (_LETTERS, 1)), axis=1)
        self.moves = (bits << np.arange(steps)).sum(axis=1).astype(np.uint32)
        self.values = random.integers(0, 1 << 32, _LETTERS, np.uint32)
        self.sampled = np.isin(np.arange(steps), random.choice(steps, places, replace=False))

    def keys(self, letters: np.ndarray) -> np.ndarray:
        """The key of the window at each of ``letters``; those of the last ``steps`` are cut short."""
        bits, values = self.moves.take(letters), self.values.take(letters)
        key = np.zeros(len(letters) + 1, np.uint32)
        turn, new = np.empty_like(bits), np.empty_like(bits)
        for step in range(len(self.sampled) - 1, -1, -1):
            np.left_shift(bits, np.uint32(31 - step), out=turn)
            np.right_shift(turn.view(np.int32), 31, out=turn.view(np.int32))
            np.bitwise_xor(key[:-1], key[1:], out=new)
            np.bitwise_and(new, turn, out=new)
            np.bitwise_xor(new, key[:-1], out=key[:-1])
            if self.sampled[step]:
                np.bitwise_xor(key[:-1], values, out=key[:-1])
                np.multiply(key[:-1], _SPREAD, out=key[:-1])
        return key[:-1]

    def file(self, letters: np.ndarray, at: np.ndarray) -> None:
        """Remember the keys of the windows at places ``at`` of the benchmark."""
        keys = self.keys(letters)[at]
        order = np.argsort(keys, kind="stable")
        self.have, self.at = keys[order], at[order]
        bits = min(24, max(16, len(at).bit_length() + 4))
        self.high, self.low = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.marks = np.zeros((2, 1 << bits), bool)
        self.marks[0, self.have >> self.high] = self.marks[1, self.have & self.low] = True

    def meet(self, letters: np.ndarray, count: int):
        """Pairs (window, place of the benchmark) with equal keys, for the first ``count`` windows."""
        keys = self.keys(letters)[:count]
        maybe = np.flatnonzero(self.marks[0].take(keys >> self.high))
        maybe = maybe[self.marks[1].take(keys[maybe] & self.low)]
        low, high = np.searchsorted(self.have, keys[maybe], "left"), np.searchsorted(self.have, keys[maybe], "right")
        ends = np.cumsum(high - low)
        for first in range(0, int(ends[-1]) if len(ends) else 0, WINDOWS):
            number = np.arange(first, min(first + WINDOWS, int(ends[-1])))
            of = np.searchsorted(ends, number, "right")
            yield maybe[of], self.at[high[of] - (ends[of] - number)]


class Index:
    """Keys of a block of benchmark items."""

    def __init__(self, ids: tuple[int, ...], texts: tuple[str, ...]):
        self.ids, self.texts = ids, texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        letters, self.starts = _codes(list(texts))
        self.letters = np.concatenate([letters, np.zeros(BLOCK, np.uint8)])
        self.owner = np.repeat(np.arange(len(texts)), self.lengths + 1)
        offset = np.arange(len(self.owner)) - self.starts[self.owner]
        random = np.random.default_rng(61)
        self.walks: list[_Walk] = []
        bounds = [c[0] for c in CLASSES] + [np.inf]
        for (least, steps, places), most in zip(CLASSES, bounds[1:]):
            walks = [_Walk(random, steps, places) for _ in range(REPEATS)]
            of = self.lengths[self.owner]
            at = np.flatnonzero((of >= least) & (of < most) & (offset <= of - steps // 2))
            if len(at):
                for walk in walks:
                    walk.file(letters, at)
                self.walks += walks
        self.short = [(i, _within(t)) for i, t in enumerate(texts) if len(t) < bounds[0]]

    def found(self, texts: pa.Array) -> list[dict[int, int]]:
        """For each normalised text, the items in it with their distances."""
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        for item, pattern in self.short:
            for doc in np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)).tolist():
                out[doc][self.ids[item]] = edit_distance(self.texts[item], texts[doc].as_py())[0]
        if not self.walks or not len(texts):
            return out
        letters, starts = _codes(texts.to_pylist())
        item, begin = self._proposed(letters)
        doc = np.searchsorted(starts, np.clip(begin + self.lengths[item] // 2, 0, len(letters) - 1), "right") - 1
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order] - starts[doc[order]]
        cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1).tolist(), len(doc)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            wanted, text = self.texts[item[a]], texts[int(doc[a])].as_py()
            most = int(DISTANCE * len(wanted))
            spans = _spans(begin[a:b].tolist(), most)
            best = min(edit_distance(wanted, text[max(0, low - most) : max(0, high + len(wanted) + most)])[0] for low, high in spans)
            if best <= most:
                out[int(doc[a])][self.ids[item[a]]] = best
        return out

    def _proposed(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and the places of ``letters`` where they may begin (less than 0: before the first)."""
        reach = max(len(w.sampled) for w in self.walks)
        padded = np.concatenate([letters, np.zeros(reach, np.uint8)])
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        items, begins, size = [], [], 0

        def settle():
            item, begin, offset = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            # Meetings that align item and text alike, but for a few characters, are one proposal.
            _, one = np.unique(item * (len(letters) + (1 << 24)) + (begin + (1 << 23) >> 3), return_index=True)
            for at in range(0, len(one), PROPOSALS):
                part = one[at : at + PROPOSALS]
                near = self._near(letters, item[part], begin[part], offset[part])
                items.append(item[part][near])
                begins.append(begin[part][near])

        for first in range(0, len(letters), WINDOWS):
            count = min(WINDOWS, len(letters) - first)
            window = padded[first : first + count + reach].astype(np.intp)
            for walk in self.walks:
                for at, place in walk.meet(window, count):
                    item = self.owner[place]
                    offset = place - self.starts[item]
                    waiting.append((item, at + first - offset, offset))
                    size += len(at)
                    if size >= 8 * PROPOSALS:
                        settle()
                        size = 0
        if waiting:
            settle()
        return (np.concatenate(items), np.concatenate(begins)) if items else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _near(self, letters: np.ndarray, item: np.ndarray, begin: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Whether the block of each item around ``offset`` is in the text near its aligned place."""
        length = self.lengths[item]
        size = np.minimum(length, BLOCK)
        first = np.clip(offset - BLOCK // 3, 0, length - size)
        which, of = np.unique(self.starts[item] + first, return_inverse=True)
        within = size[np.unique(of, return_index=True)[1]]
        masks = np.zeros((len(which), _LETTERS), np.uint64)
        rows = np.arange(len(which))
        for k in range(BLOCK):
            masks[rows, self.letters[which + k]] |= np.where(k < within, np.uint64(1) << np.uint64(k), np.uint64(0))
        masks = masks.ravel()
        row = of * _LETTERS
        at = begin + first - BLOCK_EDITS
        top = np.uint64(1) << (size - 1).astype(np.uint64)
        one = np.uint64(1)
        plus, minus = np.full(len(item), ~np.uint64(0)), np.zeros(len(item), np.uint64)
        now = size.astype(np.int16)
        best = now.copy()
        last = len(letters) - 1
        for k in range(int(size.max()) + 2 * BLOCK_EDITS):
            place = at + k
            letter = np.where((place >= 0) & (place <= last), letters[np.clip(place, 0, last)], 0)
            match = masks[row + letter]
            diagonal = (((match & plus) + plus) ^ plus) | match | minus
            up = minus | ~(diagonal | plus)
            down = plus & diagonal
            now += ((up & top) != 0).astype(np.int16) - ((down & top) != 0).astype(np.int16)
            np.minimum(best, now, out=best)
            up, down = up << one, down << one
            plus = down | ~(diagonal | up)
            minus = up & diagonal
        return best <= np.minimum((DISTANCE * length).astype(np.int64), BLOCK_EDITS)


def _within(item: str) -> str:
    """A pattern for the texts that hold an item of fewer than 10 characters within DISTANCE edits."""
    if int(DISTANCE * len(item)) == 0:
        return re.escape(item)
    # One edit: a character changed or lost, or one more.
    quoted = [re.escape(c) for c in item]
    return "|".join("".join(quoted[:k]) + ".?" + "".join(quoted[k + 1 :]) for k in range(len(item))) + "|" + "|".join("".join(quoted[:k]) + "." + "".join(quoted[k:]) for k in range(1, len(item)))


def _spans(begins: list[int], gap: int):
    """First and last start of each run of sorted starts at most ``gap`` apart."""
    first = last = begins[0]
    for b in begins:
        if b - last > gap:
            yield first, last
            first = b
        last = b
    yield first, last


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in a row, each closed by a 0, and where each text starts."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (points % np.uint32(_LETTERS - 1)).astype(np.uint8) + np.uint8(1)
    letters[points == 10] = 0
    lengths = np.array([len(t) for t in texts], np.int64)
    return letters, np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """The distinct items, normalised, in blocks of at most PASS_CHARS characters."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    block, size = {}, 0
    for row in rows.orderBy("i").toLocalIterator():
        item = normalised(pa.array([row.t]))[0].as_py()
        if item:
            block.setdefault(item, row.i)
            size += len(item)
        if size >= PASS_CHARS:
            yield tuple(block.values()), tuple(block)
            block, size = {}, 0
    if block:
        yield tuple(block.values()), tuple(block)


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", found: str = "found") -> DataFrame:
    """``df`` with ``found``: an array of (item_id, distance) of the items in each whole text.

    Null and empty texts hold no item; null and empty items are in no text; of items with equal
    normalised texts the least id stands for all. Repeated rows are kept as they are; very long
    texts take more windows, not more memory than a few times their own size. A column named
    like the result is replaced, all others stay whatever their names. Items with equal distances
    are listed by id. An empty benchmark finds nothing, an empty table gives an empty table. No
    shuffle: what is sent to the tasks is a block of the benchmark of bounded size, one pass for
    each block.
    """
    shape = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    out = df.drop(found).withColumn(found, F.array().cast(shape))
    own = fresh([*df.columns, found], "block")
    for ids, texts in _blocks(benchmark, item_id, item_text):
        shared = df.sparkSession.sparkContext.broadcast((ids, texts))

        def make(shared=shared):
            index = resource(("decontam", shared.value), lambda: Index(*shared.value))

            def work(column):
                hits = index.found(normalised(column))
                return [pa.array([[{"item_id": i, "distance": d} for i, d in sorted(h.items())] for h in hits], kind)]

            return work

        out = add_columns(out, text, make, [T.StructField(own, shape)]).withColumn(found, F.concat(found, own)).drop(own)
    return out
