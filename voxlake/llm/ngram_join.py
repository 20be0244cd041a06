"""Operator 3, n-gram Jaccard join over a prefix tree.

Sets of word n-grams are linked when their Jaccard similarity reaches a threshold. Equal sets are one class. Two linked
classes share l of the first |x| - ceil(t|x|) + l grams of any global order; here first the order of the hashes, which
needs no counts. So classes send these grams to buckets, as packed arrays, and a class stays if enough of them occur in
a second class; the same is then asked of all grams of the classes that stay, of which the threshold's share must occur
twice. What is left is a small part of the classes. Its grams are counted and put into one global order, by frequency.
Of two linked classes the smaller has one of its shortest beginning, the rarest grams that it can miss in a set of its own size and one
more, among the rarest grams that the larger can miss in a smaller set and one more; so only such gram's classes fall into
one family. Each family's sets are joined over a trie: classes that share a beginning share its overlap, and a subtree
ends where the grams left are too few or where all its sets are of the component already. No pairs are made outside it.

A family too large for a task is joined in rounds, all such families at once. As long as grams of it occur under two
labels, classes with enough such grams to be linked across labels remain; some of them are pivots, a trie of bounded
size that each chunk of the family walks, and leave when all their links are known.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Families that one task joins, in classes and in grams; a larger one is dealt in chunks of FAMILY classes. Pivots of a round, likewise.
FAMILY, FAMILY_GRAMS, PIVOTS, PIVOT_GRAMS = 4000, 2_000_000, 256, 250_000
#: (gram, class) rows that a task deals at once. Of a gram that these hold more often than BATCH_MOST, two rows go to the bucket, so
#: that no bucket receives it from each document.
DEALT, BATCH_MOST = 500_000, 2
#: (gram, class) rows that a bucket receives, and classes whose counts meet in one, about.
BUCKET, COUNTED = 250_000, 500_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)


def grams(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; A to Z count as lower case; fewer words are one gram."""
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, np.uint64(m))
    for k in range(m):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_ODD[k % 5]) + h[k : len(h) - m + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(29)))


def class_of(g: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63)


def second_hash(g: np.ndarray) -> int:
    """Tells apart unequal sets of one class_of()."""
    return xxhash.xxh64_intdigest(g.tobytes(), 1) - (1 << 63)


def needed(percent: int, x: int) -> int:
    """Grams that a set of x shares at least with any linked set."""
    return -(-percent * x // 100)


def depth(x: int) -> int:
    """Grams that two prefixes share at least; it grows with the set."""
    return 1 + x // 10


def linked(percent: int, shared: int, x: int, y: int) -> bool:
    return 100 * shared >= percent * (x + y - shared)


class Groups:
    """Numbers in disjoint groups, each known by its least."""

    def __init__(self):
        self.root: list[int] = []

    def new(self) -> int:
        self.root.append(len(self.root))
        return len(self.root) - 1

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)


#: Fields of a trie's node: ranks of its edge, children by first rank, (set, size) that end here, least and largest size
#: below, one set below, whether those below were of several groups when last looked at.
EDGE, CHILDREN, ENDS, LEAST, MOST, ONE, MIXED = range(7)


class Trie:
    """Sets as sorted lists of ranks, and the groups that links between them make."""

    def __init__(self, percent: int):
        self.percent, self.groups = percent, Groups()
        self.root = [[], {}, [], 1 << 60, 0, None, False]

    def add(self, ranks: list[int], size: int, name: int) -> None:
        node, at, find = self.root, 0, self.groups.find
        while True:
            node[LEAST], node[MOST] = min(node[LEAST], size), max(node[MOST], size)
            if node[ONE] is None:
                node[ONE] = name
            elif find(node[ONE]) != find(name):
                node[MIXED] = True
            if at == len(ranks):
                node[ENDS].append((name, size))
                return
            child = node[CHILDREN].get(ranks[at])
            if child is None:
                node[CHILDREN][ranks[at]] = [ranks[at:], {}, [(name, size)], size, size, name, False]
                return
            edge, k, most = child[EDGE], 0, min(len(child[EDGE]), len(ranks) - at)
            while k < most and edge[k] == ranks[at + k]:
                k += 1
            if k < len(edge):
                node[CHILDREN][ranks[at]] = [edge[:k], {edge[k]: [edge[k:], *child[1:]]}, [], *child[LEAST:]]
                child = node[CHILDREN][ranks[at]]
            node, at = child, at + k

    def _of_group(self, node: list, group: int) -> bool:
        """Whether all sets at and below a node are known to be of one group, and this is it."""
        find = self.groups.find
        if node[ONE] is None or find(node[ONE]) != group:
            return False
        if node[MIXED]:
            node[MIXED] = any(c[MIXED] or find(c[ONE]) != group for c in node[CHILDREN].values()) or any(find(n) != group for n, _ in node[ENDS])
        return not node[MIXED]

    def join(self, ranks: list[int], size: int, name: int) -> Iterator[int]:
        """Unites a set of `size` grams, of which `ranks` are known to the order, with the groups of the sets that it is linked
        with; gives one such set of each group."""
        have, p, groups = frozenset(ranks), self.percent, self.groups
        group = groups.find(name)
        stack = [(self.root, 0, 0)]
        while stack:
            node, shared, passed = stack.pop()
            if self._of_group(node, group):
                continue
            edge = node[EDGE]
            if edge:
                shared += len(have.intersection(edge))
                passed += len(edge)
            for other, n in node[ENDS]:
                if groups.find(other) != group and linked(p, shared, size, n):
                    groups.unite(name, other)
                    group = groups.find(name)
                    yield other
            likely = []
            for first, child in node[CHILDREN].items():
                least, most = max(child[LEAST], -(-size * p // 100)), min(child[MOST], size * 100 // p)
                left = min(len(ranks) - bisect_right(ranks, first - 1), most - passed)
                # of all sizes below, the least asks for the fewest shared grams
                if least <= most and linked(p, shared + left, size, least):
                    (likely if first in have else stack).append((child, shared, passed))
            stack += likely  # looked at first, so that the rest may be of the group by then


class Order:
    """Ranks of grams in the global order, the most common first, from (grams, counts) of some sets."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.found, at = np.unique(np.concatenate([g for g, _ in sets]), return_index=True)
        counts = np.concatenate([k for _, k in sets])[at]
        self.rank = np.empty(len(self.found), np.int64)
        self.rank[np.lexsort((self.found, -counts))] = np.arange(len(self.found))

    def __call__(self, g: np.ndarray) -> list[int]:
        """Sorted ranks of those of the grams that the order knows."""
        at = np.minimum(np.searchsorted(self.found, g), len(self.found) - 1)
        return np.sort(self.rank[at[self.found[at] == g]]).tolist()


def local_components(sets: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], percent: int) -> list[int]:
    """For each set, given by its shared grams with their counts and its whole size, the number of the first set of its component."""
    order, trie = Order(sets), Trie(percent)
    for i, (g, _) in enumerate(sets):
        ranks = order(g)
        trie.groups.new()
        for _ in trie.join(ranks, sizes[i], i):
            pass
        trie.add(ranks, sizes[i], i)
    return [trie.groups.find(i) for i in range(len(sets))]


def _classes(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, second, size, first = [], [], [], []
            for text in batch.column("text"):
                g = grams(text.as_py(), n)
                c.append(class_of(g))
                second.append(second_hash(g))
                size.append(len(g))
                first.append(g[: len(g) - needed(percent, len(g)) + depth(len(g))].view(np.int64) if len(g) else np.zeros(0, np.int64))
            cols = {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "c": pa.array(c, pa.int64()), "second": pa.array(second, pa.int64()), "n": pa.array(size, pa.int32())}
            yield pa.RecordBatch.from_pydict(cols | {"first": base.lists(first)})

    return run


_ROW, _COUNT = np.dtype([("g", "<i8"), ("c", "<i8")]), np.dtype([("c", "<i8"), ("k", "<i8")])


def _rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """(gram, class) of the lists in a column, each once."""
    lists = batch.column(column).cast(pa.large_list(pa.int64()))
    rows = np.zeros(len(lists.flatten()), _ROW)
    rows["g"] = lists.flatten().to_numpy()
    rows["c"] = np.repeat(batch.column("c").to_numpy(), np.diff(lists.offsets.to_numpy()))
    return np.unique(rows)


def _dealt(kind: int, rows: np.ndarray, key: str, buckets: int) -> pa.RecordBatch:
    """Rows as one binary for each bucket of their key."""
    bucket = (rows[key].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = [x.tobytes() for x in np.split(rows, cuts)] if len(rows) else []
    at = bucket[np.concatenate([[0], cuts])] if len(rows) else bucket
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(parts), pa.int32()), "bucket": pa.array(at, pa.int64()), "rows": pa.array(parts, pa.binary())})


def _counted(rows: np.ndarray) -> np.ndarray:
    """Each class with the number of its rows."""
    c, k = np.unique(rows["c"], return_counts=True)
    out = np.zeros(len(c), _COUNT)
    out["c"], out["k"] = c, k
    return out


def _packed(column: str, buckets: int, parts: int):
    """The rows of each DEALT or so dealt by gram (kind 0). Of a gram that these hold more than BATCH_MOST times, the first two
    rows go, so that its bucket knows of a second class, and all its rows are counted by class at once (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in base.gathered((_rows_of(batch, column) for batch in batches), DEALT):
            rows = np.unique(rows)  # copies among them are one class
            start = np.concatenate([[True], rows["g"][1:] != rows["g"][:-1]])
            count = np.diff(np.concatenate([np.flatnonzero(start), [len(rows)]]))
            often = np.repeat(count > BATCH_MOST, count)
            if often.any():
                yield _dealt(1, _counted(rows[often]), "c", parts)
                marks = np.concatenate([rows[often & start], rows[often & np.concatenate([[False], start[:-1]])]])
                rows = np.concatenate([rows[~often], marks])
            yield _dealt(0, rows, "g", buckets)

    return run


def _met(parts: int):
    """By class, counts of the rows of a task's buckets whose gram occurs in a second class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), _ROW) for batch in batches for x in batch.column("rows")]
        if held:
            rows = np.unique(np.concatenate(held))
            same = rows["g"][1:] == rows["g"][:-1]
            twice = np.zeros(len(rows), bool)
            twice[1:] |= same
            twice[:-1] |= same
            yield _dealt(1, _counted(rows[twice]), "c", parts)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, k: the counts of a task's classes, added as they come."""
    total, waiting, n = np.zeros(0, _COUNT), [], 0

    def added():
        rows = np.concatenate([total, *waiting])
        c, at = np.unique(rows["c"], return_inverse=True)
        out = np.zeros(len(c), _COUNT)
        out["c"] = c
        np.add.at(out["k"], at, rows["k"])
        return out

    for batch in batches:
        for x in batch.column("rows"):
            waiting.append(np.frombuffer(x.as_buffer(), _COUNT))
            n += len(waiting[-1])
            if n > max(BUCKET, len(total)):
                total, waiting, n = added(), [], 0
    total = added()
    if len(total):
        yield pa.RecordBatch.from_pydict({"c": pa.array(total["c"].copy()), "k": pa.array(total["k"].copy())})


def _shared_grams(table: DataFrame, column: str, name: str) -> DataFrame:
    """c, k of each class in table (c, column): how many grams of its list another class has too; some may count twice."""
    spark = table.sparkSession
    total, classes = table.agg(F.sum(F.size(column)), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, counted = max(parts, math.ceil((total or 0) / BUCKET)), max(1, math.ceil(classes / COUNTED))
    kinds = "kind int, bucket long, rows binary"
    packed = base.stored(table.select("c", column).mapInArrow(base.lean(_packed(column, buckets, counted)), kinds), f"{name}-packed")
    met = packed.where("kind = 0").repartition(buckets, "bucket").mapInArrow(base.lean(_met(counted)), kinds)
    met = base.stored(met.unionByName(packed.where("kind = 1")), f"{name}-met")
    base.forget(packed)
    out = base.stored(met.repartition(max(parts, counted), "bucket").mapInArrow(base.lean(_summed), "c long, k long"), name)
    base.forget(met)
    return out


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t.as_py(), n) for t in batch.column("text")]
            # a text of the same id and text hash could be of another class
            own = [(c, g) for c, old, g in zip(batch.column("c").to_pylist(), batch.column("old").to_pylist(), sets, strict=True) if len(g) and class_of(g) == old]
            yield pa.RecordBatch.from_pydict({"c": pa.array([c for c, _ in own], pa.int64()), "grams": base.lists([g.view(np.int64) for _, g in own])})

    return run


def _families(percent: int):
    """Over rows in order of family: (a, b) from each class to the first of its component. One family is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sizes, sets = None, [], [], []

        def done():
            return [(names[i], names[j]) for i, j in enumerate(local_components(sets, sizes, percent)) if i != j] if len(sets) > 1 else []

        for batch in batches:
            out = []
            for family, c, n, g, k in zip(*(batch.column(x).to_pylist() for x in ("family", "c", "n")), batch.column("grams"), batch.column("counts"), strict=True):
                if family != now:
                    out += done()
                    now, names, sizes, sets = family, [], [], []
                names.append(c)
                sizes.append(n)
                sets.append((g.values.to_numpy(), k.values.to_numpy()))
            if out:
                yield _links(out)
        if out := done():
            yield _links(out)

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _against(percent: int):
    """Over rows in order of family and chunk, pivots first: links (a, b) that join each class with the pivots that it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots, trie, order, names = None, [], None, None, []
        for batch in batches:
            out = []
            for family, chunk, pivot, c, n, g, k in zip(*(batch.column(x).to_pylist() for x in ("family", "chunk", "pivot", "c", "n")), batch.column("grams"), batch.column("counts"), strict=True):
                if (family, chunk) != now:
                    now, pivots, trie = (family, chunk), [], None
                g, k = g.values.to_numpy(), k.values.to_numpy()
                if pivot:
                    pivots.append((c, n, g, k))
                    continue
                if trie is None:
                    trie, order, names = Trie(percent), Order([(g, k) for _, _, g, k in pivots]), []
                    for other, m, h, _ in pivots:
                        trie.add(order(h), m, trie.groups.new())
                        names.append(other)
                    own = set(names)
                if c in own:
                    c = None  # a pivot is looked for among the others under a number of its own
                names.append(c)
                i = trie.groups.new()
                found = [names[j] for j in trie.join(order(g), n, i)]
                # a pivot's row has found itself: it links all that it found
                out += [(x, found[0]) for x in found[1:]] if c is None else [(c, x) for x in found]
            if out:
                yield _links(out)

    return run


def _stars(links: DataFrame) -> DataFrame:
    """c, label of links (a, b) that go from each class to one label of its component."""
    return links.select(F.col("a").alias("c"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("c"), F.col("b").alias("label")).distinct())


def _pool_labels(pool: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """c, label of linked classes: of links, which are stars, and of what links the classes of pool (family, c, n, grams, counts)."""
    label = base.stored(_stars(links), "join-label")
    columns = ["family", "c", "n", "grams", "counts"]
    while True:
        pool = pool.select(*columns).join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
        each = pool.select("c", "label", "n", F.explode("grams").alias("g"))
        spread = base.stored(each.groupBy("g").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("g"), "join-spread")
        rest = each.join(spread, "g").groupBy("c").agg(F.count("*").alias("k"), F.first("n").alias("m")).where(100 * F.col("k") >= percent * F.col("m"))
        pool = base.stored(pool.join(rest.select("c", (F.col("k") / F.col("m")).alias("openness")), "c").select(*columns, "openness"), "join-pool")
        base.forget(spread)
        sizes = base.stored(pool.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("chunks")), "join-sizes")
        if sizes.isEmpty():
            return label
        best = Window.partitionBy("family").orderBy(F.desc("openness"), "n", "c")
        first = pool.select("family", "openness", "n", "c").withColumn("i", F.row_number().over(best)).where(F.col("i") <= PIVOTS)
        chosen = first.withColumn("sum", F.sum("n").over(best)).where((F.col("sum") <= PIVOT_GRAMS) | (F.col("i") == 1))
        chosen = base.stored(chosen.select("c"), "join-chosen")
        # families here are larger than FAMILY classes, so a million of them would hold billions of classes
        dealt = pool.join(F.broadcast(sizes), "family")
        rows = dealt.withColumns({"chunk": F.pmod(F.xxhash64("c"), "chunks").cast("int"), "pivot": F.lit(False)})
        pivots = dealt.join(chosen, "c").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "pivot": F.lit(True)})
        both = rows.select(*columns, "chunk", "pivot").unionByName(pivots.select(*columns, "chunk", "pivot"))
        met = both.repartition("family", "chunk").sortWithinPartitions("family", "chunk", F.desc("pivot"), "c").mapInArrow(base.lean(_against(percent)), "a long, b long")
        links = base.stored(links.unionByName(met), "join-links")
        label = base.stored(components(links).select(F.col("node").alias("c"), "label"), "join-label")
        pool = base.stored(pool.select(*columns).join(chosen, "c", "left_anti"), "join-pool")


def labelled(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """doc_id, th, n, label of each row of docs (doc_id, text): its text's hash, the size of its set, and what its component has in common.

    Equal sets are told by two 64-bit hashes of all their grams, and grams by a 64-bit hash. Rows without words have n = 0.
    """
    spark = docs.sparkSession
    base.bounded_batches(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    table = base.stored(read.mapInArrow(base.lean(_classes(n, percent)), "doc_id long, th long, c long, second long, n int, first array<long>"), "join-classes")
    classes = table.where("n > 0").groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("n").alias("n"), F.min("second").alias("s0"), F.max("second").alias("s1"))
    classes = base.stored(classes.withColumn("old", F.col("c")), "join-reps")
    clash = classes.where("s0 <> s1").select("c")
    if not clash.isEmpty():  # unequal sets of one hash: as many rows as chance gives, about pairs of classes / 2 ** 64
        own = table.join(F.broadcast(clash.withColumn("clash", F.lit(True))), "c", "left").withColumn("old", F.col("c"))
        table = base.stored(own.withColumn("c", F.when(F.col("clash"), F.xxhash64("c", "second")).otherwise(F.col("c"))).drop("clash"), "join-classes")
        classes = base.stored(table.where("n > 0").groupBy("c", "old").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("n").alias("n")), "join-reps")
    shared = _shared_grams(table, "first", "join-shared")
    # the least linked partner has needed(n) grams, so its depth is the least that must be shared
    wanted = shared.join(classes, "c").where(F.col("k") >= 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    wanted = base.stored(wanted.select("c", "old", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("rep_th")), "join-wanted")
    # sets are made anew from the texts of the classes that are looked at
    texts = read.join(F.broadcast(wanted) if wanted.count() <= 500_000 else wanted, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = base.stored(texts.select("c", "old", "text").mapInArrow(base.lean(_sets(n)), "c long, grams array<long>"), "join-sets")
    again_counts = _shared_grams(sets, "grams", "join-again")
    again = sets.join(again_counts.where("k > 0"), "c").where(100 * F.col("k") >= percent * F.size("grams"))
    few = base.stored(again.select("c", "grams").dropDuplicates(["c"]), "join-sets")
    base.forget(sets)
    # the global order: grams by the number of classes, which those of one class cannot take part in
    each = few.select("c", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    counts = base.stored(each.groupBy("g").agg(F.count("*").cast("int").alias("k")).where("k > 1"), "join-counts")
    order = each.join(counts, "g").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "g"))).alias("x")).where(100 * F.size("x") >= percent * F.col("n"))
    sets = base.stored(order.select("c", "n", F.col("x.g").alias("grams"), F.transform("x.k", lambda k: -k).alias("counts")), "join-ordered")
    base.forget(few)
    base.forget(counts)
    # Sets of x and y >= x grams that are linked share as many as any set of x shares with an equal one of its size, at least, and
    # percent of y: so one gram is among those that each may miss and one more. Grams of one class stand first and are not listed.
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    need_equal = F.expr(f"cast((2 * {percent} * cast(n as bigint) + {99 + percent}) div {100 + percent} as int)")
    spots = F.transform(F.slice("grams", need, F.size("grams") - need + 1), lambda g, i: F.struct(g.alias("g"), (i + need >= need_equal).alias("short")))
    rare = base.stored(sets.select("c", F.explode(spots).alias("x")).select("c", "x.*"), "join-rare")
    least = rare.groupBy("g").agg(F.min(F.when(F.col("short"), F.col("c"))).alias("b"), F.count("*").alias("k"))
    least = base.stored(least.where("k > 1 and b is not null").select("g", "b"), "join-least")
    families = components(rare.join(least, "g").select(F.col("c").alias("a"), "b")).select(F.col("node").alias("c"), F.col("label").alias("family"))
    families = sets.select("c", F.size("grams").alias("m")).join(families, "c")
    families = base.stored(families, "join-families")
    for done in (rare, least, shared, wanted, again_counts):
        base.forget(done)
    large = families.groupBy("family").agg(F.count("*").alias("k"), F.sum("m").alias("m")).where((F.col("k") > FAMILY) | (F.col("m") > FAMILY_GRAMS)).select("family", F.lit(True).alias("large"))
    large = base.stored(large, "join-large")
    families = families.join(large, "family", "left").select("c", "family", F.coalesce("large", F.lit(False)).alias("large"))
    inside = sets.join(families, "c")
    links = inside.where("not large").repartition("family").sortWithinPartitions("family", "c").mapInArrow(base.lean(_families(percent)), "a long, b long")
    links = base.stored(links, "join-links")
    label = _stars(links) if large.isEmpty() else _pool_labels(inside.where("large"), links, percent)
    label = base.stored(label, "join-label")
    out = table.select("doc_id", "th", "c", "n").join(label, "c", "left")
    out = base.stored(out.select("doc_id", "th", "n", F.coalesce("label", "c").alias("label")), "join-labels")
    for done in (table, classes, sets, families, large, links, label):
        base.forget(done)
    return out


def _first_rows(rows: DataFrame) -> DataFrame:
    """l, first: for each component of several rows, doc_id and th of the row of least doc_id (nulls last)."""
    first = F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    found = rows.where("n > 0").groupBy(F.col("label").alias("l")).agg(first.alias("first"), F.count("*").alias("k"))
    found = base.stored(found.where("k > 1").select("l", "first"), "join-first")
    return F.broadcast(found) if found.count() <= 500_000 else found


def jaccard_components(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): components of the links at percent / 100 or more.

    The component's id is its least doc_id (nulls last). A text without words, or null, has no grams and is a component of its own;
    so is any row of that kind, even if repeated. Rows with equal sets are linked, whatever their ids. Extra columns are ignored.
    Texts of any length are taken whole: a task holds the set of one at a time, and the sets of a family; an empty table gives none.
    """
    rows = labelled(docs, percent, n)
    joined = rows.join(_first_rows(rows), (F.col("label") == F.col("l")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text and others) without those that a row of less doc_id (nulls last; then text hash) is linked with,
    directly or over others. Rows without words stay; of others that share doc_id and text one does.
    """
    rows = labelled(docs, percent, n)
    joined = rows.join(_first_rows(rows), (F.col("label") == F.col("l")) & (F.col("n") > 0))
    gone = base.stored(joined.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th")).distinct(), "join-gone")
    keyed = docs.withColumn("_th", F.xxhash64("text"))
    stay = keyed.join(F.broadcast(gone) if gone.count() <= 500_000 else gone, (F.col("_th") == F.col("gone_th")) & F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    if not rows.where("n > 0").groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        worded = F.coalesce(F.col("text").rlike(base.WORD_SQL), F.lit(False))
        stay = stay.where(worded).dropDuplicates(["doc_id", "_th"]).unionByName(stay.where(~worded))
    return stay.drop("_th")
