"""Near-duplicate vectors by E8 lattice hashing with probing, and exact cosine links.

A table of the index is a random projection to eight dimensions, decoded to the nearest point
of the E8 lattice, whose number is the vector's cell. A vector is also filed under the next
nearest lattice points, so two close vectors on both sides of a cell wall still meet.

Cells hold numbers of vectors and 16-byte sketches: coordinates in an orthonormal frame, whose
distance is never above that of the vectors, so that no linked pair fails their bound. What is left
of a cell are groups of vectors that may be linked; a group that several cells have found is kept
once. Only the vectors of groups are fetched, and their pairs compared by cosine in double precision.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, stored

COSINE = 0.95
TABLES, PROBES = 8, 2
#: Length of a unit vector's projection, in units in which the lattice's least vectors have length sqrt(2).
SCALE = 2.6
#: Rows of a cell or group compared in one task at once; larger ones are cut into pairs of such blocks.
BLOCK = 8192
#: The largest squared distance of linked vectors' sketches: 1 / 127 is a byte's unit, each of 16 places is off by less than one.
REACH = (127 * np.sqrt(2 - 2 * COSINE) + 4) ** 2
#: Rows of a block compared at once; a strip of linked rows holds STRIP x BLOCK pairs.
STRIP = 256
#: Cells of more than BLOCK vectors, and the vectors that are needed, are broadcast by number up to so many, else joined.
BROADCAST_CELLS = 200_000
_ODD = np.random.default_rng(8).integers(1, 1 << 62, 8, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=4)
def _projections(dimensions: int) -> np.ndarray:
    return np.random.default_rng(248).standard_normal((dimensions, TABLES * 8)) * (SCALE / np.sqrt(8))


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 to each row, and its next one; coordinates are integers of even sum."""
    point = np.rint(x)
    rest = x - point
    order = np.argsort(-np.abs(rest), axis=1)
    rows = np.arange(len(x))
    turn = np.where(rest >= 0, 1.0, -1.0)
    odd = point.sum(axis=1) % 2 != 0
    first, second = order[:, 0], order[:, 1]
    best, other = point.copy(), point.copy()
    best[rows[odd], first[odd]] += turn[rows[odd], first[odd]]
    other[rows[odd], second[odd]] += turn[rows[odd], second[odd]]
    even = ~odd
    for k in (first, second):
        other[rows[even], k[even]] += turn[rows[even], k[even]]
    return best, other


def cells(units: np.ndarray) -> np.ndarray:
    """Numbers of the cells of each unit vector: rows x TABLES x (1 + PROBES), its own first."""
    n = len(units)
    x = (units @ _projections(units.shape[1])).reshape(-1, 8)
    points = [*_d8(x), *(p + 0.5 for p in _d8(x - 0.5))]
    far = np.stack([((x - p) ** 2).sum(axis=1) for p in points])
    order = np.argsort(far, axis=0, kind="stable")[: 1 + PROBES]
    doubled = np.stack([(2 * p).astype(np.int64).view(np.uint64) @ _ODD for p in points])
    numbers = np.take_along_axis(doubled, order, axis=0).T.reshape(n, TABLES, 1 + PROBES)
    tables = np.arange(1, TABLES + 1, dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15)
    return ((numbers ^ tables) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _matrices(vectors: pa.Array):
    """Rows of usable vectors of one length at a time: (row numbers, float64 matrix).

    Usable are lists with entries that are all finite numbers, not all of them 0.
    """
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, np.int64)
    starts = vectors.offsets.to_numpy()[:-1].astype(np.int64)
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    for size in np.unique(sizes[valid]).tolist():
        rows = np.flatnonzero(valid & (sizes == size))
        for at in range(0, len(rows) if size else 0, 1 << 14):
            part = rows[at : at + (1 << 14)]
            matrix = flat[starts[part][:, None] + np.arange(size)]
            good = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
            yield part[good], matrix[good]


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their length; first by their largest entry, so that no square overflows."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _contents(matrix: np.ndarray) -> np.ndarray:
    """A hash of the content of each row; -0.0 is 0.0."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(v.data) - (1 << 63) for v in np.ascontiguousarray(matrix + 0.0)], np.int64)


def _index(batches):
    """The columns of a batch with ``content``: a hash of each usable vector, else null."""
    for batch in batches:
        content, null = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
        for rows, matrix in _matrices(batch.column("embedding")):
            null[rows] = False
            content[rows] = _contents(matrix)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, mask=null), batch.column("embedding")], ["vec_id", "content", "embedding"])


def _sketches(units: np.ndarray) -> np.ndarray:
    """Sixteen coordinates of each row in a fixed orthonormal frame, a byte each: rows x 16."""
    frame = np.linalg.qr(np.random.default_rng(95).standard_normal((units.shape[1], min(16, units.shape[1]))))[0]
    out = np.zeros((len(units), 16), np.int8)
    out[:, : frame.shape[1]] = np.rint(units @ frame * 127)
    return out


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Which entries of each row are the first of their value in the row."""
    keep = np.ones(numbers.shape, bool)
    for k in range(1, numbers.shape[1]):
        keep[:, k] = ~(numbers[:, :k] == numbers[:, k : k + 1]).any(axis=1)
    return keep


def _numbers(matrix: np.ndarray) -> np.ndarray:
    """The numbers of a matrix's cells, rows x 24; vectors of different lengths share none."""
    out = [cells(_unit(matrix[at : at + 2000])).reshape(-1, TABLES * (1 + PROBES)) for at in range(0, len(matrix), 2000)]
    return np.concatenate(out) ^ np.int64(matrix.shape[1] * 0x9E3779B97F4A7C1 & (1 << 62) - 1)


def _different(batch: pa.RecordBatch):
    """Matrices of a batch without repeated rows, with the rows' contents."""
    for _, matrix in _matrices(batch.column("embedding")):
        content, at = np.unique(_contents(matrix), return_index=True)
        if len(at):
            yield content, matrix[at]


def _sizes(batches):
    """A row ``cell, size`` for each cell of a batch."""
    for batch in batches:
        for _, matrix in _different(batch):
            numbers = _numbers(matrix)
            found, size = np.unique(numbers[_distinct(numbers)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(size.astype(np.int64))], ["cell", "size"])


def _filed(batches):
    """A row ``cell, content, s, t`` for each distinct cell of a vector: 16 bytes stand for it."""
    for batch in batches:
        for content, matrix in _different(batch):
            numbers, sketch = _numbers(matrix), _sketches(_unit(matrix)).view(np.int64)
            row, col = np.nonzero(_distinct(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[row, col]), *(pa.array(np.ascontiguousarray(v)) for v in (content[row], sketch[row, 0], sketch[row, 1]))], ["cell", "content", "s", "t"])


def _joined(low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    """A number for each row of ``low`` and ``high``, equal where sketches within REACH connect them; -1 if alone."""
    left = low.astype(np.float32)
    right = left if high is None else high.astype(np.float32)
    square, others = (left * left).sum(axis=1), (right * right).sum(axis=1)
    shift = 0 if high is None else len(left)
    label = np.arange(len(right) + shift)
    alone = np.ones(len(label), bool)

    def pairs(top):
        far = square[top : top + STRIP, None] + others - 2 * (left[top : top + STRIP] @ right.T)
        i, j = np.nonzero(far <= REACH)
        i, j = i + top, j + shift
        return (i, j) if shift else (i[i != j], j[i != j])

    # One strip's pairs are kept; those of several are found again in each round.
    once = [pairs(0)] if len(left) <= STRIP else None
    while True:
        before = label.copy()
        for i, j in once or map(pairs, range(0, len(left), STRIP)):
            alone[i] = alone[j] = False
            # Smallest labels go along the links, then labels take their own label.
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            label = label[label]
        if (label == before).all():
            label[alone] = -1
            return label


def _promising(sketch: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which runs of rows, from cut to cut, are long or hold two sketches within REACH."""
    sizes = np.diff(cuts)
    out = sizes > 64
    run = np.repeat(np.arange(len(sizes)), sizes)
    open_ = np.flatnonzero(~out[run] & (sizes[run] > 1))
    wide = sketch.astype(np.int16)
    for step in range(1, int(sizes[~out].max(initial=1))):
        open_ = open_[open_ + step < len(run)]
        open_ = open_[run[open_] == run[open_ + step]]
        if not len(open_):
            break
        gap = (wide[open_] - wide[open_ + step]).astype(np.int32)
        out[run[open_[(gap * gap).sum(axis=1) <= REACH]]] = True
    return out


def _groups(batches):
    """Rows sorted by (cell, x, y, side, content) to the groups of vectors that may be linked.

    A row ``unit, group, cell, side, content`` for each member. Groups of the same vectors have the
    same number, whatever cell they were found in; pairs of blocks (``unit`` 1) are numbered apart,
    since there only vectors of different sides are compared. Held at once is one pair of blocks.
    """
    import xxhash

    key, held, out = None, [], []

    def settle():
        side, content, sketch = (np.concatenate(c) if len(held) > 1 else c[0] for c in zip(*held))
        fresh_ = np.ones(len(content), bool)
        fresh_[1:] = (content[1:] != content[:-1]) | (side[1:] != side[:-1])
        side, content, sketch = side[fresh_], content[fresh_], sketch[fresh_]
        cut = int(np.searchsorted(side, 1)) if key[1] != key[2] else len(side)
        if len(content) < 2 or key[1] != key[2] and cut in (0, len(side)):
            return
        label = _joined(sketch[:cut], None if key[1] == key[2] else sketch[cut:])
        order = np.argsort(label, kind="stable")[np.count_nonzero(label < 0) :]
        for members in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []:
            ids = np.sort(content[members])
            unit = int(key[1] != key[2])
            name = xxhash.xxh3_64_intdigest(ids.tobytes() + (np.array(key).tobytes() if unit else b"")) - (1 << 63)
            out.append((np.full(len(members), unit, np.int8), np.full(len(members), name), np.full(len(members), key[0]), side[members].astype(np.int8), content[members]))

    def rows():
        columns = [np.concatenate(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["unit", "group", "cell", "side", "content"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "x", "y", "side", "content")])
        sketch = np.stack([batch.column("s").to_numpy(), batch.column("t").to_numpy()], axis=1).view(np.int8)
        cuts = np.concatenate([[0], np.flatnonzero((columns[:3, 1:] != columns[:3, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        # Of the cells that begin and end in this batch, only those with some sketches close together count.
        keep = np.ones(len(cuts) - 1, bool)
        keep[1:-1] = _promising(sketch, cuts)[1:-1]
        for k in np.flatnonzero(keep).tolist():
            now, start, end = columns[:3, cuts[k]].tolist(), int(cuts[k]), int(cuts[k + 1])
            if now != key:
                if held:
                    settle()
                key, held = now, []
            held.append((columns[3, start:end], columns[4, start:end], sketch[start:end]))
        if sum(len(o[0]) for o in out) >= 10_000:
            yield rows()
    if held:
        settle()
    if out:
        yield rows()


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each pair of rows of cell numbers shares; the largest integer if none."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        same = (a[:, k : k + 1] == b).any(axis=1)
        out[same] = np.minimum(out[same], a[same, k])
    return out


def _compare_block(mine: np.ndarray, apart: bool, low: tuple, high: tuple | None):
    """Links of rows (content, side, copies, units, cells): each content's links, and edges that connect them.

    ``mine`` are the cells whose pairs are counted here: a pair counts in the least cell that both
    have, so a pair that meets in several groups counts once.
    """
    content, side, copies, left, own = low
    other, other_side, other_copies, right, theirs = low if high is None else high
    counts: dict[int, int] = {}
    parent: dict[int, int] = {}
    edges = []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for top in range(0, len(left), STRIP):
        i, j = np.nonzero(left[top : top + STRIP] @ right.T >= COSINE)
        i += top
        keep = content[i] < other[j] if high is None else content[i] != other[j]
        if apart:
            keep &= side[i] != other_side[j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 200_000):
            part = slice(at, at + 200_000)
            first[part] = np.isin(_least_common(own[i[part]], theirs[j[part]]), mine)
        i, j = i[first], j[first]
        for keys, size in ((content[i], other_copies[j]), (other[j], copies[i])):
            found, of = np.unique(keys, return_inverse=True)
            for k, c in zip(found.tolist(), np.bincount(of, size, len(found)).astype(np.int64).tolist()):
                counts[k] = counts.get(k, 0) + c
        for a, b in zip(content[i].tolist(), other[j].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((a, b))
    return list(counts.items()), edges


def _compare(batches):
    """Rows sorted by (group, x, y, part) to rows (a, b, links): b is null for counts.

    Held at once is one pair of blocks of a group.
    """
    key, held, found = None, [], []

    def settle():
        part, *rest = (np.concatenate([h[k] for h in held]) if len(held) > 1 else held[0][k] for k in range(6))
        cut = len(part) if key[1] == key[2] else int(np.searchsorted(part, 1))
        low, high = tuple(c[:cut] for c in rest), tuple(c[cut:] for c in rest)
        if key[1] == key[2] or len(low[0]) and len(high[0]):
            counts, edges = _compare_block(held[0][6], held[0][7], low, None if key[1] == key[2] else high)
            found.extend((a, None, n) for a, n in counts)
            found.extend((a, b, None) for a, b in edges)

    def rows():
        a, b, n = zip(*found) if found else ((), (), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("group", "x", "y", "part", "content", "side", "copies", "unit")])
        cuts = [0, *(np.flatnonzero((columns[:3, 1:] != columns[:3, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        mine = batch.column("cells")
        place, size, units, numbers = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64), {}, {}
        for rows_, matrix in _matrices(batch.column("embedding")):
            size[rows_] = matrix.shape[1]
            before = len(units.get(matrix.shape[1], ()))
            place[rows_] = before + np.arange(len(rows_))
            for made, new in ((units, _unit(matrix)), (numbers, _numbers(matrix))):
                made[matrix.shape[1]] = np.concatenate([made[matrix.shape[1]], new]) if before else new
        for now, start, end in zip(columns[:3, cuts[:-1]].T.tolist(), cuts, cuts[1:]):
            if now != key:
                if held:
                    settle()
                key, held = now, []
            at, of = place[start:end], int(size[start])
            held.append((*columns[3:7, start:end], units[of][at], numbers[of][at], np.array(mine[start].as_py(), np.int64), bool(columns[7, start])))
        if len(found) >= 10_000:
            yield rows()
    if held:
        settle()
    yield rows()


def _paired(rows: DataFrame, sizes: DataFrame, key: str, member: str, x: str, y: str, side: str) -> DataFrame:
    """``rows`` once for each pair of blocks of their ``key``: a block meets itself and every other, as x <= y.

    ``sizes`` has the keys of more than BLOCK members, and their number of blocks; it is broadcast
    up to BROADCAST_CELLS rows.
    """
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    placed = rows.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(member), "blocks").cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({x: F.least("block", "with"), y: F.greatest("block", "with"), side: (F.col("block") > F.col("with")).cast("int")}).drop("blocks", "block", "with")


def _blocks(sizes: DataFrame, key: str) -> DataFrame:
    return stored(sizes.where(F.col("size") > BLOCK).select(key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "lattice-blocks")


def links(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``df``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    so do vectors of different lengths. Equal vectors are indexed once and linked with each
    other. No cell or group is cut off: one of more than BLOCK vectors is compared in pairs of
    blocks, each a task's unit. ``n_links`` counts rows; rows that repeat a vec_id count as rows of their own.
    A null vec_id takes part, but names no component unless it has no other. Only the two
    columns are read, so others may have any names; an empty table gives an empty table.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = rows.schema["embedding"].dataType.simpleString()
    named = rows.mapInArrow(_index, f"vec_id long, content long, embedding {kind}")
    indexed = stored(named.select("vec_id", "content"), "lattice-vectors")
    nodes = stored(indexed.where("content is not null").groupBy("content").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "lattice-nodes")
    # 1. Cells hold numbers and sketches; what they say may be linked are groups, the same group once.
    wide = _blocks(rows.select("embedding").mapInArrow(_sizes, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")), "cell")
    filed = rows.select("embedding").mapInArrow(_filed, "cell long, content long, s long, t long")
    dealt = _paired(filed, wide, "cell", "content", "x", "y", "side").repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "side", "content")
    met = stored(dealt.mapInArrow(_groups, "unit byte, group long, cell long, side byte, content long"), "lattice-groups")
    owners = met.groupBy("group").agg(F.first("unit").alias("unit"), F.collect_set("cell").alias("cells"), F.countDistinct("content").alias("size"))
    owners = stored(owners, "lattice-owners")
    members = met.select("group", F.when(F.col("unit") == 1, F.col("side")).otherwise(0).cast("int").alias("side"), "content").distinct()
    # 2. The vectors of the groups, each once a group, are compared.
    needed = stored(met.select("content").distinct(), "lattice-needed")
    few = needed.count() <= BROADCAST_CELLS
    vectors = named.select("content", "embedding").join(F.broadcast(needed) if few else needed, "content").groupBy("content").agg(F.first("embedding").alias("embedding"))
    vectors = stored(vectors.join(nodes.select("content", "copies"), "content"), "lattice-needed-vectors")
    listed = members.join(owners.select("group", "unit", "cells"), "group").join(vectors, "content")
    pairs = _paired(listed, _blocks(owners, "group"), "group", "content", "x", "y", "part")
    compared = pairs.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "part").mapInArrow(_compare, "a long, b long, links long")
    found = stored(compared, "lattice-links")
    discard(met, owners, needed, vectors, wide)
    # 3. Counts of rows, and components with the name of their least vector.
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "content")
    labels = components(found.where("b is not null").select("a", "b"))
    of = nodes.join(counts, "content", "left").join(labels.withColumnRenamed("id", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    of = stored(of.select("content", "node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "lattice-counted")
    names = of.groupBy("component").agg(F.min("node").alias("component_id"))
    known = stored(of.join(names, "component").select("content", "n_links", "component_id"), "lattice-components")
    discard(found, labels, of, nodes)
    out = indexed.join(known, "content", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
