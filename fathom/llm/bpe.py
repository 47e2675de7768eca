"""Byte-level BPE by merge replay over the distinct words of a block of the corpus.

The distinct pre-tokens of a block are laid out as one linked sequence of symbols. An inverted
index from merge rank (a token pair) to positions drives the replay: ranks are taken in order,
each merge is applied at all of its positions in all words at once, and only the touched
neighbours enter the index anew. A block is what one Arrow slice of a task adds to the words
seen before, so nothing grows with the corpus and no shuffle is needed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import Memory, add_columns, joined, pieces, resource

#: Entries of each generation of the memo of encoded pieces in a Python worker.
MEMO_PIECES = 150_000
#: Bytes of words replayed at once; each takes about 200 bytes of Python's memory. A longer word is replayed alone.
REPLAY_BYTES = 64 << 10


def blocks(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in their order, in blocks of at most ``REPLAY_BYTES`` bytes or of one word."""
    start = size = 0
    for at, word in enumerate(words):
        if at > start and size + len(word) > REPLAY_BYTES:
            yield words[start:at]
            start, size = at, 0
        size += len(word)
    if words:
        yield words[start:]


class MergeReplay:
    """Ranks of a tokenizer and the replay of its merges."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.memo = Memory(MEMO_PIECES)
        self.vocabulary = pa.array(self.tokens, pa.binary())
        self.prepare()

    def prepare(self) -> None:
        """The rank of each pair of tokens that merges, and of each pair of bytes (-1: none)."""
        get = self.ranks.get
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.byte_pairs = np.full(1 << 16, -1, np.int64)
        for left in range(256):
            for right in range(256):
                self.byte_pairs[left << 8 | right] = get(bytes((left, right)), -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word, as bytes of native unsigned 32-bit integers.

        A merge can make a pair of a lower rank than its own. The positions not yet visited then
        go back to the index, so that every word sees the order that encoding it alone gives:
        lowest rank first, leftmost first.
        """
        whole = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        # The rank of the pair that starts at each position, -1 if it does not merge.
        ranks = np.full(len(whole), -1, np.int64)
        ranks[:-1] = self.byte_pairs[whole[:-1] << 8 | whole[1:]]
        last = ends[sizes > 0] - 1
        ranks[last] = -1
        after, before = np.arange(1, len(whole) + 1), np.arange(-1, len(whole) - 1)
        after[last] = before[(ends - sizes)[sizes > 0]] = -1
        # The inverted index: of each pair, by its rank, the positions in all words.
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[places], prepend=-1))
        firsts = ranks[places[cuts]].tolist() if len(places) else []
        bounds, listed = [*cuts.tolist(), len(places)], places.tolist()
        index = {rank: listed[a:b] for rank, a, b in zip(firsts, bounds, bounds[1:])}
        token = np.array(self.byte_ids, np.int64)[whole].tolist()
        after, before, ranks = after.tolist(), before.tolist(), ranks.tolist()
        pair = self.pairs.get
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank, None)
            if found is None:
                continue
            found.sort()
            for number, at in enumerate(found):
                if ranks[at] != rank:
                    continue
                right = after[at]
                further = after[right]
                token[at] = rank
                token[right] = ranks[right] = -1
                after[at] = further
                lower = False
                if further >= 0:
                    before[further] = at
                    new = ranks[at] = pair(rank << 20 | token[further], -1)
                    if new >= 0:
                        lower = new < rank
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                else:
                    ranks[at] = -1
                previous = before[at]
                if previous >= 0:
                    new = ranks[previous] = pair(token[previous] << 20 | rank, -1)
                    if new >= 0:
                        lower = lower or new < rank
                        if new in index:
                            index[new].append(previous)
                        else:
                            index[new] = [previous]
                            heapq.heappush(heap, new)
                if lower and number + 1 < len(found):
                    if rank not in index:
                        heapq.heappush(heap, rank)
                    index.setdefault(rank, []).extend(found[number + 1 :])
                    break
        flat = np.array(token, np.int64)
        alive = flat >= 0
        starts = np.concatenate([[0], ends])
        bounds = (np.concatenate([[0], np.cumsum(alive)])[starts] * 4).tolist()
        out = flat[alive].astype(np.uint32).tobytes()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Token ids of each text, as lists of 32-bit integers."""
        values, _, codes, offsets = pieces(texts)
        memo = self.memo
        known = memo.many(values)
        cut: dict[int, list[str]] = {i: self.split(values[i]) for i, v in enumerate(known) if v is None}
        words = list({w: None for parts in cut.values() for w in parts})
        done: dict[str, bytes] = {}
        for block in blocks([w.encode() for w in words]):
            done.update(zip(words[len(done) : len(done) + len(block)], self.replay(block)))
        for i, parts in cut.items():
            known[i] = done[parts[0]] if len(parts) == 1 else b"".join([done[w] for w in parts])
            if len(values[i]) <= 64:
                memo.put(values[i], known[i])
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in known])]) // 4
        flat = pa.array(np.frombuffer(b"".join(known), np.int32))
        return joined(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat), codes, offsets)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of token ids."""
        flat = ids.flatten()
        offsets = ids.offsets.to_numpy()
        return joined(self.vocabulary, flat.to_numpy(zero_copy_only=False), (offsets - offsets[0]).astype(np.int64))


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``df`` with the token ids of ``column`` and, unless ``decoded`` is None, their bytes.

    ``path`` names a rank file (base64 token, rank) that every executor has; ``pattern`` cuts
    texts into pre-tokens. Null and empty texts give an empty list and empty bytes; special
    tokens do not exist. Rows are kept as they are, repeated ones too; columns with the names of
    the results are replaced. An empty table gives an empty table. One pass without a shuffle.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), True))]
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []

    def make():
        replay = resource(("bpe", path, pattern), lambda: MergeReplay(path, pattern))

        def work(texts):
            out = replay.encode(texts)
            return [out, replay.decode(out)] if decoded else [out]

        return work

    return add_columns(df, column, make, fields)


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the two columns."""
    return encoded.select(
        *(c for c in encoded.columns if c not in (ids, decoded)),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
