"""N-gram Jaccard self-join of documents by a prefix-tree join over globally ordered sets.

1. One pass turns each text into its set of 64-bit shingle hashes, collapses equal sets to a
   64-bit signature, and counts the shingles that recur within a batch.
2. The global order puts shingles that the counts show to be frequent last (rarest first, then
   by hash). Two sets with Jaccard of at least t share a shingle among the first
   n - ceil(t n) + 1 of each, so one row for each such shingle is dealt by shingle; those
   that no other set has are dropped. The order decides the cost, never the result.
3. Sets that share a prefix shingle are compared in rounds. First each with the most typical set
   of its group; links found so are joined to components, and these are compared likewise. Then,
   for groups that still hold several components, every set outside the group's main component
   with every set of another one that it can reach. A pair left out is in one component already,
   so no link that matters is lost.
4. Comparisons run in blocks: the candidates of a set form a prefix tree (sorted sets with common
   prefixes), walked once with partial overlaps shared along prefixes; a subtree is left as soon
   as its overlap and the remaining length cannot reach the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns, resource, slices
from .components import components
from .shared import discard, release, stored

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles seen in so many texts of a batch are reported; the most frequent of them, at most FREQUENT, are ordered last.
REPORT, FREQUENT = 3, 200_000
#: Rows of a frequent shingle are dealt to one more task for each so many of its texts.
DEAL_ROWS = 1000
#: Up to so many documents to compare, their ids are broadcast to the scan that fetches the texts.
BROADCAST_IDS = 400_000
#: Rounds of comparisons with typical sets before the remaining pairs are compared one by one.
ROUNDS = 2
#: Candidates in one prefix tree, and tasks that the candidates of one set are dealt to.
BLOCK, DEALT = 256, 64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPREAD = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _SPREAD
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (empty without words).

    A-Z is lower-cased; words are runs between ASCII white space; a text of fewer than WORDS
    words has one shingle, its whole sequence.
    """
    import xxhash

    lists = pc.split_pattern_regex(pc.ascii_lower(texts), r"[\x20\x09-\x0D]+")
    coded = lists.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    values = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.array([digest(w) | 1 if w else 0 for w in values], np.uint64).reshape(-1)
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.empty(0, np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    kept = words != 0
    words, bounds = words[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]
    count = len(words) - WORDS + 1
    mixed = words * np.uint64(3)
    grams = _mixed(sum((_mixed(mixed[k : k + count] + np.uint64(k)) * _MULTIPLIERS[k] for k in range(WORDS)), np.zeros(max(count, 0), np.uint64))) if count > 0 else np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            found = np.sort(grams[a : b - WORDS + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(_mixed((_mixed(mixed[a:b] + np.arange(b - a, dtype=np.uint64)) * _MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sets_of(part: pa.RecordBatch):
    """The sets of a slice's texts, hashed a few megabytes at a time."""
    for some in slices(part, "text", 3 << 20):
        yield from shingle_sets(some.column("text").fill_null(""))


def _signature(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0


def _scan(batches):
    """Rows (doc_id, signature, n) of texts, and (token, seen) of shingles that recur."""
    for batch in batches:
        resource(("jaccard",), tuple)
        for part in slices(batch, "text", 24 << 20):
            sets = list(_sets_of(part))
            ids = part.column("doc_id").cast(pa.int64())
            signatures = [_signature(s) for s in sets]
            distinct = {g: s for g, s in zip(signatures, sets)}
            tokens, seen = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            tokens, seen = tokens[seen >= REPORT].view(np.int64), seen[seen >= REPORT]
            yield _rows(True, ids, pa.array(signatures, pa.int64()), pa.array([len(s) for s in sets], pa.int64()))
            yield _rows(False, None, pa.array(tokens), pa.array(seen.astype(np.int64)))


def _rows(is_doc: bool, ids, key, number) -> pa.RecordBatch:
    ids = pa.nulls(len(key), pa.int64()) if ids is None else ids
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), is_doc)), ids, key, number], ["is_doc", "doc_id", "key", "number"])


class _Order:
    """The global order: frequent shingles, by count, after all others."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(tokens >> np.uint64(42)).astype(np.int64)] = True

    def frequency(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.int64)
        at = np.flatnonzero(self.marks[(found >> np.uint64(42)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, found[at]), len(self.tokens) - 1)
            same = self.tokens[place] == found[at]
            out[at[same]] = self.counts[place[same]]
        return out

    def ordered(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of a set in the global order, and their frequencies."""
        frequency = self.frequency(found)
        if frequency.any():
            order = np.lexsort((found, frequency))
            return found[order], frequency[order]
        return found, frequency


def _prefixes(batches, order: _Order, deal_rows: int):
    """Rows (dealt, token, signature, n, place) of the prefixes of distinct sets of a batch.

    Whether a token's rows are dealt to several tasks depends on its frequency alone, so it is
    the same in every set: ``dealt`` is the token itself below ``deal_rows``, never from there.
    """
    for batch in batches:
        resource(("jaccard",), tuple)
        for part in slices(batch, "text", 8 << 20):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            done = set()
            for found in _sets_of(part):
                n = len(found)
                signature = _signature(found)
                if not n or signature in done:
                    continue
                done.add(signature)
                tokens, frequency = order.ordered(found)
                size = n - (PERCENT * n + 99) // 100 + 1
                tokens, frequency = tokens[:size], frequency[:size]
                salts = np.uint64(signature & 0xFFFF) % (frequency // deal_rows + 1).astype(np.uint64)
                dealt = np.where(frequency >= deal_rows, _mixed(tokens + salts * _SPREAD), tokens)
                for column, values in zip(columns, (dealt, tokens, np.full(size, signature), np.full(size, n), np.arange(size))):
                    column.append(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["dealt", "token", "sig", "n", "place"])


def _repeated(batches):
    """Of rows sorted by (dealt, sig): without repeated ones, those whose ``dealt`` has several sets or is one of many of its token."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        data = np.stack([batch.column(i).to_numpy() for i in range(5)])
        previous = carry
        if carry is not None:
            data = np.concatenate([carry[0], data], axis=1)
        fresh = np.ones(data.shape[1], bool)
        fresh[1:] = (data[0, 1:] != data[0, :-1]) | (data[2, 1:] != data[2, :-1])
        data = data[:, fresh]
        same = np.concatenate([[previous is not None and previous[1]], data[0, 1:] == data[0, :-1]])
        keep = same | (data[0] != data[1])
        keep[:-1] |= same[1:]
        carry = data[:, -1:], bool(same[-1])
        yield _packed(data[1:, :-1][:, keep[:-1]])
    if carry is not None:
        last = carry[0]
        yield _packed(last[1:, [carry[1] or last[0, 0] != last[1, 0]]])


def _packed(data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in data], ["token", "sig", "n", "place"])


def _tree_join(query: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[int]:
    """Keys of the rows (key, ranks in the order, set in the order) that reach the bound with ``query``.

    The sets, sorted, are the paths of a prefix tree. ``partial`` holds the overlap at each depth
    of the current path; a set keeps what it shares with the path before.
    """
    wanted = np.sort(query)
    n = len(query)
    rows = sorted((r for r in rows if 100 * min(n, len(r[2])) >= PERCENT * max(n, len(r[2]))), key=lambda r: r[1])
    out, path, partial = [], np.empty(0, np.uint64), np.zeros(1, np.int64)
    cut = None
    for key, _, found in rows:
        m = min(len(path), len(found))
        differ = np.flatnonzero(path[:m] != found[:m])
        shared = int(differ[0]) if len(differ) else m
        need = -(-PERCENT * (n + len(found)) // (100 + PERCENT))
        if cut is not None and shared >= cut[0] and cut[1] + len(found) - cut[0] < need:
            continue  # in a subtree that was left
        at = np.minimum(np.searchsorted(wanted, found[shared:]), n - 1)
        partial = np.concatenate([partial[: shared + 1], partial[shared] + np.cumsum(wanted[at] == found[shared:])])
        path = found
        bound = partial + (len(found) - np.arange(len(found) + 1))
        low = np.flatnonzero(bound < need)
        cut = (int(low[0]), int(partial[low[0]])) if len(low) else None
        total = int(partial[-1])
        if 100 * total >= PERCENT * (n + len(found) - total):
            out.append(key)
    return out


def _compare(batches, order: _Order):
    """Linked pairs among rows sorted by (a, part, not the query itself): (a, b, text)."""
    query, group, block = None, None, []

    def flush():
        linked = _tree_join(query, block) if block else []
        block.clear()
        return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(linked), pa.int64()), pa.array(linked, pa.int64())], ["a", "b"])

    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text").fill_null(""))
            for a, p, b, found in zip(part.column("a").to_pylist(), part.column("part").to_pylist(), part.column("b").to_pylist(), sets):
                if _signature(found) != b:
                    continue  # another text under the same doc_id
                if (a, p) != group or len(block) >= BLOCK:
                    if block:
                        yield flush()
                    group = (a, p)
                tokens, frequency = order.ordered(found)
                if a == b:
                    query = tokens
                else:
                    block.append((b, list(zip(frequency.tolist()[:64], tokens.tolist()[:64])), tokens))
    if block:
        yield flush()


class _Join:
    """The steps of one join over stored tables."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs
        scanned = stored(docs.mapInArrow(_scan, "is_doc boolean, doc_id long, key long, number long"), "jaccard-scan")
        self.sets = scanned.where("is_doc").select("doc_id", F.col("key").alias("sig"), F.col("number").alias("n_shingles"))
        frequent = scanned.where("not is_doc").groupBy("key").agg(F.sum("number").alias("seen")).orderBy(F.desc("seen"), "key").limit(FREQUENT).toPandas()
        tokens = frequent["key"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(tokens)
        self.order = self.spark.sparkContext.broadcast((tokens[by], frequent["seen"].to_numpy(np.int64)[by]))
        #: The first document of each distinct set stands for it.
        self.first = stored(self.sets.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc")), "jaccard-first")

    def postings(self) -> DataFrame:
        """``token, sig, n, place`` of prefix shingles that several sets have."""
        order, deal_rows = self.order, DEAL_ROWS

        def prefixes(batches):
            yield from _prefixes(batches, _Order(*order.value), deal_rows)

        rows = self.docs.select("text").mapInArrow(prefixes, "dealt long, token long, sig long, n long, place long")
        dealt = rows.repartition("dealt").sortWithinPartitions("dealt", "sig")
        out = stored(dealt.mapInArrow(_repeated, "token long, sig long, n long, place long"), "jaccard-postings")
        del rows, dealt
        release(self.spark)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of signatures that reach the bound."""
        pairs = stored(pairs, "jaccard-pairs")
        needed = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct().join(self.first, "sig")
        needed = stored(needed.select("sig", F.col("doc").alias("doc_id")), "jaccard-needed")
        few = needed.count() <= BROADCAST_IDS
        texts = self.docs.select("doc_id", "text").join(F.broadcast(needed) if few else needed, self.docs["doc_id"].eqNullSafe(needed["doc_id"]))
        texts = stored(texts.select("sig", "text"), "jaccard-texts")
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(DEALT)))
        members = dealt.join(texts.withColumnRenamed("sig", "b"), "b").select("a", "part", "b", "text")
        queries = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("sig", "a"), "a").select("a", "part", F.col("a").alias("b"), "text")
        rows = members.union(queries).repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b")
        order = self.order

        def compare(batches):
            yield from _compare(batches, _Order(*order.value))

        found = stored(rows.mapInArrow(compare, "a long, b long"), "jaccard-linked")
        discard(pairs, needed, texts)
        release(self.spark)
        return found

    def ranked(self, postings: DataFrame) -> DataFrame:
        """Postings with ``pop``: how common the prefix shingles of a set are among all sets.

        Of a group of near copies the one with the fewest own words has the most common ones, and
        is most likely to reach the bound with the others.
        """
        seen = stored(postings.groupBy("token").agg(F.count("*").alias("seen")), "jaccard-seen")
        size = F.first("n") - F.floor((PERCENT * F.first("n") + 99) / 100) + 1
        pop = stored(postings.join(seen, "token").groupBy("sig").agg((F.sum(F.log2("seen")) / size).alias("pop")), "jaccard-popularity")
        out = stored(postings.join(pop, "sig"), "jaccard-ranked")
        discard(seen, pop, postings)
        return out

    def placed(self, ranked: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Rows with ``comp``, the component of the set: at first each set its own."""
        if labels is None:
            return ranked.withColumn("comp", F.col("sig"))
        of = labels.select(F.col("id").alias("sig"), "component")
        return stored(ranked.join(of, "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component"), "jaccard-placed")

    def main_pairs(self, placed: DataFrame) -> DataFrame:
        """The most common set of each component in a shingle's group with that of the whole group."""
        best = F.max_by(F.struct("sig", "n", "comp"), F.struct("pop", "sig"))
        centres = stored(placed.groupBy("token").agg(best.alias("c")).select("token", F.col("c.sig").alias("a"), F.col("c.n").alias("m"), F.col("c.comp").alias("own")), "jaccard-centres")
        each = stored(placed.groupBy("token", "comp").agg(F.max_by(F.struct("sig", "n"), F.struct("pop", "sig")).alias("r")).select("token", "comp", F.col("r.sig").alias("b"), F.col("r.n").alias("n")), "jaccard-each")
        both = each.join(centres, "token").where("comp <> own").where(_sizes("n", "m"))
        out = stored(_shared_enough(both.select("a", "b", "n", "m")), "jaccard-main")
        discard(centres, each)
        return out

    def other_pairs(self, placed: DataFrame) -> DataFrame:
        """Pairs across components in groups that still hold several of them.

        It is enough to meet at the first shingle that both sets have. With places p and q there,
        the overlap is at most 1 and what is left of the shorter rest, so rows far behind in a
        prefix meet only much shorter partners.
        """
        sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("size"))
        open_ = stored(sizes.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("several")).where("several > 1").select("token", "main"), "jaccard-open")
        rows = stored(placed.join(open_, "token").select("token", "sig", "n", "place", "comp", "main"), "jaccard-open-rows")
        minor = rows.where("comp <> main").select("token", F.col("sig").alias("a"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("comp").alias("own"))
        need = F.ceil((F.col("n") + F.col("m")) * PERCENT / (100 + PERCENT))
        reach = 1 + F.least(F.col("n") - F.col("place") - 1, F.col("m") - F.col("q") - 1)
        both = minor.join(rows, "token").where("comp <> own and (comp = main or a < sig)").where(_sizes("n", "m")).where(reach >= need)
        pairs = stored(both.select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct(), "jaccard-reached")
        release(self.spark)
        # All prefix shingles that sets of different components share are in open groups, so the
        # sets' own lists of them tell how many a pair shares.
        own = stored(rows.groupBy("sig", "n").agg(F.collect_set("token").alias("tokens")), "jaccard-own")
        sides = [own.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}")) for k in "ab"]
        shared = F.size(F.array_intersect("t_a", "t_b"))
        out = stored(pairs.join(sides[0], "a").join(sides[1], "b").where(_enough(shared, F.col("n_a"), F.col("n_b"))).select("a", "b"), "jaccard-others")
        discard(open_, rows, pairs, own)
        return out

    def result(self) -> DataFrame:
        ranked = self.ranked(self.postings())
        links = labels = tried = None
        made = []
        placed = self.placed(ranked, None)
        for _ in range(ROUNDS):
            pairs = self.main_pairs(placed)
            new = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
            found = self.linked(new)
            links, tried = (found, pairs) if links is None else (links.union(found), tried.union(pairs))
            made += [found, pairs]
            discard(labels, placed)
            labels = components(links)
            placed = self.placed(ranked, labels)
        others = self.other_pairs(placed)
        more = self.linked(others)
        discard(others, placed, ranked)
        if more.limit(1).count():
            discard(labels)
            labels = components(links.union(more))
        # A component has the name of its least document.
        of = self.first.join(labels.withColumnRenamed("id", "sig"), "sig", "left").select("sig", "doc", F.coalesce("component", "sig").alias("comp"))
        names = of.groupBy("comp").agg(F.min("doc").alias("component_id"))
        of = stored(of.join(names, "comp").select("sig", "comp", "component_id"), "jaccard-components")
        discard(labels, more, self.first, *made)
        return self.sets.join(of, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("sig").alias("set_id"), F.coalesce("comp", F.col("sig")).alias("group_id"))


def _sizes(n: str, m: str):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _shared_enough(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough prefix tokens; a row for each token shared.

    Of two sets, let x be the one whose prefix ends first in the order. Every common token
    that is not in both prefixes is behind x's prefix, so the overlap is at most the shared prefix
    tokens and ceil(t |x|) - 1 more. Rows of main pairs may be too few, since a set is not the
    typical one of all groups it shares; pairs left out for it are met again as other pairs.
    """
    counted = rows.groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"))
    return counted.where(_enough(F.col("shared"), F.col("n"), F.col("m"))).select("a", "b")


def _enough(shared, n, m):
    behind = F.floor((PERCENT * F.greatest(n, m) + 99) / 100) - 1
    return shared + behind >= F.ceil((n + m) * PERCENT / (100 + PERCENT))


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, set_id, group_id`` of each row of ``df``.

    A null text is an empty one: no shingle, linked with nothing, set and group 0. Equal sets are
    one, with one number; ``group_id`` numbers components, also where ids repeat. Repeated rows stay; rows with equal doc_id are separate texts, each in the
    component of its own. A null doc_id takes part, but never names a component unless all of
    its texts lack one. Very long texts are one set each. Only the two columns are read, so others
    may have any names. An empty table gives an empty table.
    """
    return _Join(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).result()


def with_sets(df: DataFrame, text: str = "text", set_id: str = "set_id") -> DataFrame:
    """``df`` with the number of each text's set, as :func:`join` gives it; 0 without shingles."""

    def make():
        def work(texts):
            return [pa.array([_signature(s) for s in shingle_sets(texts)], pa.int64())]

        return work

    return add_columns(df, text, make, [T.StructField(set_id, T.LongType())], 2 << 20)
