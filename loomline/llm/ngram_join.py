"""Jaccard self-join of word n-gram sets with count-vector R-trees, and the groups that its links make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sliced, tidy
from .components import components
from .shingles import shingle_sets

WORDS, PERCENT = 4, 85
#: Groups that n-grams are hashed into for the count vectors.
GROUPS = 64
#: Counters of the frequency sketch; its size is fixed, whatever the number of documents.
COUNTERS = 1 << 18
_CHUNK = 1 << 12
#: Points in a leaf of the R-tree, and rows of a block that one task joins with as many others.
LEAF, TILE = 32, 4096
#: Node ids (8 bytes each) that may be broadcast to pick documents; beyond it a join is used.
MOST_BROADCAST = 250_000
#: Blocks by which a node's pairs are told apart, so that few of them are compared in more than one block.
HOMES = 4
#: Pivots are chosen again while more than one in FAIR of the pairs compared are linked, ROUNDS times at most: what they
#: leave, the trees find.
FAIR, ROUNDS = 4, 8


def _node() -> Column:
    """A row's name: its doc_id, or for rows without one a number from the text, below all usual ones."""
    return F.coalesce("doc_id", F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("text"), 3))


def _sets(batch: pa.RecordBatch, column: int, words: int) -> list[np.ndarray]:
    return shingle_sets([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()], words)


def frequency_levels(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> np.ndarray:
    """For each value of an n-gram's upper hash bits, how far above the average its documents are: 0, or a power of two.

    A pass over all documents adds up counters of fixed size. n-grams on high levels come last in the order of the
    prefix filter, so that what many documents share (a common line or passage) makes no candidates.
    """
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for part in (p for batch in batches for p in sliced(batch, 0)):
            sets = _sets(part, 0, words)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        parts = counts.reshape(-1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), type=pa.int32()), pa.array([p.tobytes() for p in parts], type=pa.binary())], schema=schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int32()), pa.array([s.tobytes() for s in sums.values()], type=pa.binary())], schema=schema)

    ddl = "chunk int, counts binary"
    total = scratch.save(docs.select("text").mapInArrow(tidy(counted), ddl).repartition("chunk").mapInArrow(tidy(added), ddl), "sketch").collect()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for row in total:
        counts[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], dtype=np.int64)
    usual = 4 * counts.mean() + 16
    return np.ceil(np.log2(np.maximum(counts / usual, 1))).astype(np.uint8)


def prefix(grams: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n-grams in the order (level, hash): two sets that are alike enough share one of them.

    Their overlap is at least percent of either size, so it can't lie wholly behind n - ceil(n * percent / 100) + 1
    n-grams of either set.
    """
    size = len(grams) + (-len(grams) * percent) // 100 + 1 if len(grams) else 0
    order = np.argsort(levels[(grams >> np.uint64(46)).astype(np.int64)], kind="stable")
    return grams[order[:size]]


def count_vector(grams: np.ndarray) -> np.ndarray:
    """How many n-grams fall in each group. The overlap of two sets is at most the sum of the smaller counts.

    There are GROUPS groups, or more for larger sets (a power of two, two n-grams a group at most on average), by the
    hash's lower bits: a longer vector folds onto a shorter one by adding up. So fine a vector tells nearly all pairs
    below the threshold from those above it.
    """
    groups = max(GROUPS, 1 << max(0, (len(grams) // 2 - 1).bit_length()))
    return np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint32)


def packed(vector: np.ndarray) -> bytes:
    """The counts in the least of half a byte and 1, 2 or 4 bytes each that holds them all; the first byte says which."""
    if vector.max(initial=0) < 16:
        return b"\0" + (vector[::2] | vector[1::2] << 4).astype(np.uint8).tobytes()
    width = 1 if vector.max() < 1 << 8 else 2 if vector.max() < 1 << 16 else 4
    return bytes([width]) + vector.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)
    halves = np.frombuffer(data, dtype=np.uint8, offset=1)
    return np.stack([halves & 15, halves >> 4], axis=1).ravel()


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of the smaller counts, at the shorter vector's groups."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def profiles(docs: DataFrame, levels: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, node (its name), n (set size), sign_a and sign_b (128 bits of the whole set), keys (the prefix) and vector of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sign_a", pa.int64()), ("sign_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("vector", pa.binary())])
    table = levels.tobytes()

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(table, dtype=np.uint8)
        for batch in (p for whole in batches for p in sliced(whole, 2)):
            sets = _sets(batch, 2, words)
            keys = [prefix(s, level, percent).view(np.int64) for s in sets]
            sums = [int(s.sum(dtype=np.uint64)) for s in sets]
            squares = [int((s * (s | np.uint64(1))).sum(dtype=np.uint64)) for s in sets]
            signed = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
            offsets = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)))
            vectors = pa.array([packed(count_vector(s)) for s in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(signed(sums)), pa.array(signed(squares)), lists, vectors], schema=schema)

    return docs.select("doc_id", _node().alias("node"), "text").mapInArrow(tidy(profiled), "doc_id long, node long, n long, sign_a long, sign_b long, keys array<long>, vector binary")


def members(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """node and grams (the whole set, as bytes) of the documents in `nodes`."""
    schema = pa.schema([("node", pa.int64()), ("sign_a", pa.int64()), ("grams", pa.binary())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in sliced(whole, 1)):
            sets = _sets(batch, 1, words)
            signs = np.array([int(s.sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs), pa.array([s.tobytes() for s in sets], type=pa.binary())], schema=schema)

    rows = docs.select(_node().alias("node"), "text").join(_small(nodes), "node", "left_semi")
    return rows.mapInArrow(tidy(listed), "node long, sign_a long, grams binary").dropDuplicates(["node", "sign_a"])


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, of sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are alike, by exact intersection."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [alike(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent) for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_grams", "b_grams").mapInArrow(tidy(test), "a long, b long")


class CountTree:
    """A packed R-tree over count vectors: points sorted by size and leading counts, leaves of LEAF, and the largest
    coordinates and least size of each leaf and of each group of leaves."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, classes: np.ndarray):
        self.order = np.lexsort((vectors[:, 2], vectors[:, 1], vectors[:, 0], sizes)) if len(sizes) else np.empty(0, dtype=np.int64)
        self.sizes, self.vectors, self.classes = sizes[self.order], vectors[self.order], classes[self.order]
        self.levels = []
        high, low, big = self.vectors, self.sizes, self.sizes
        first, last = self.classes, self.classes
        while True:
            cuts = np.arange(0, len(high), LEAF)
            high, low, big = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(big, cuts)
            first, last = np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            self.levels.append((high, low, big, first, last))
            if len(high) == 1:
                break

    def join(self, other: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of points of both trees, of different classes, that sizes and bounds allow."""
        top = max(len(self.levels), len(other.levels)) - 1
        todo = [(top, 0, 0)] if len(self.sizes) and len(other.sizes) else []
        while todo:
            level, i, j = todo.pop()
            if level < 0:
                continue
            mine, yours = self._below(level, i), other._below(level, j)
            ok = self._allowed(level, mine, other, yours, percent)
            for x, y in zip(*np.nonzero(ok)):
                if level:
                    todo.append((level - 1, int(mine[x]), int(yours[y])))
            if level == 0 and ok.any():
                x, y = np.nonzero(ok)
                yield self.order[mine[x]], other.order[yours[y]]

    def _below(self, level: int, i: int) -> np.ndarray:
        """Numbers of the entries under entry i of a level: entries of the next lower level, or points."""
        if level >= len(self.levels):
            return np.array([0])
        count = len(self.levels[level - 1][1]) if level else len(self.sizes)
        return np.arange(i * LEAF, min((i + 1) * LEAF, count))

    def _boxes(self, level: int, which: np.ndarray) -> tuple[np.ndarray, ...]:
        if level == 0:
            return self.vectors[which], self.sizes[which], self.sizes[which], self.classes[which], self.classes[which]
        if level >= len(self.levels) + 1:
            level = len(self.levels)
        return tuple(part[which] for part in self.levels[level - 1])

    def _allowed(self, level: int, mine: np.ndarray, other: CountTree, yours: np.ndarray, percent: int) -> np.ndarray:
        high, low, big, first, last = self._boxes(level, mine)
        high2, low2, big2, first2, last2 = other._boxes(level, yours)
        bound = np.minimum(high[:, None, :], high2[None, :, :]).sum(axis=2, dtype=np.int64)
        ok = (100 + percent) * bound >= percent * (low[:, None] + low2[None, :])
        ok &= (100 * big[:, None] >= percent * low2[None, :]) & (100 * big2[None, :] >= percent * low[:, None])
        one = (first == last)[:, None] & (first2 == last2)[None, :] & (first[:, None] == first2[None, :])
        return ok & ~one


def small_join(sizes: np.ndarray, vectors: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What a tree of one leaf gives when joined with itself."""
    bound = np.minimum(vectors[:, None, :], vectors[None, :, :]).sum(axis=2, dtype=np.int64)
    ok = ((100 + percent) * bound >= percent * (sizes[:, None] + sizes[None, :])) & (100 * sizes[:, None] >= percent * sizes[None, :])
    return np.nonzero(ok & (100 * sizes[None, :] >= percent * sizes[:, None]) & (classes[:, None] != classes[None, :]))


def with_homes(blocks: DataFrame) -> DataFrame:
    """blocks (block, node, ...) with `homes`: the node's HOMES largest blocks, in the order (size down, block).

    Two nodes that share homes are a matter for the first of these alone, so a pair is compared in one block however
    many n-grams it shares. Blocks all of whose nodes have one other block as their first home go: that one holds them.
    """
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    ranked = blocks.join(sizes, "block").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), "block"))).alias("all"))
    homes = ranked.select("node", F.transform(F.slice(F.array_distinct("all"), 1, HOMES), lambda x: x["block"]).alias("homes"))
    placed = blocks.join(homes, "node")
    first = F.col("homes")[0]
    needed = placed.groupBy("block").agg(F.min(first).alias("low"), F.max(first).alias("high")).where("low <> high or low = block").select("block")
    return placed.join(needed, "block", "left_semi")


def own_pairs(block: int, homes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows x and y are this block's to compare: those whose first common home it is, or without one.

    homes: a row of blocks for each node, in one order for all, filled up with -1.
    """
    same = (homes[x][:, :, None] == homes[y][:, None, :]) & (homes[x] >= 0)[:, :, None]
    same = same.any(axis=2)
    first = homes[x, np.argmax(same, axis=1)]
    return ~same.any(axis=1) | (first == block)


def tree_pairs(blocks: DataFrame, vectors: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs (a < b) within blocks of (block, node, class, n, homes), between different classes. vectors:
    (node, vector).

    A block of more than TILE rows is dealt into tiles by a hash of the node, and each pair of tiles is a task's unit,
    so memory stays bounded and no pair is lost. Each unit joins two R-trees.
    """
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    tiled = blocks.join(sizes, "block").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("block", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "node", "class", "n", "homes")
    tiled = tiled.join(vectors, "node")

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in ("block", "low", "high")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield held.slice(start, end - start)
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and held.num_rows:
            yield held

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            node, label, size, tile = (unit.column(c).to_numpy() for c in ("node", "class", "n", "tile"))
            block = unit.column("block")[0].as_py()
            homes = np.full((len(node), HOMES), -1, dtype=np.int64)
            for i, own in enumerate(unit.column("homes").to_pylist()):
                homes[i, : len(own)] = own
            fine = [unpacked(v) for v in unit.column("vector").to_pylist()]
            vector = np.array([folded(v, GROUPS) for v in fine])

            def kept(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                """The pairs that are this block's and that the vectors allow in full length."""
                wanted = own_pairs(block, homes, x, y)
                x, y = x[wanted], y[wanted]
                need = percent * (size[x] + size[y])
                ok = np.array([(100 + percent) * overlap_bound(fine[i], fine[j]) >= n for i, j, n in zip(x.tolist(), y.tolist(), need.tolist())], dtype=bool)
                a, b = node[x[ok]], node[y[ok]]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

            low, high = unit.column("low")[0].as_py(), unit.column("high")[0].as_py()
            if low == high and len(node) <= LEAF:
                x, y = small_join(size, vector, label, percent)
                once = node[x] < node[y]
                yield kept(x[once], y[once])
                continue
            mine, yours = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
            if not len(mine) or not len(yours):
                continue
            trees = [CountTree(size[w], vector[w], label[w]) for w in ((mine,) if low == high else (mine, yours))]
            for x, y in trees[0].join(trees[-1], percent):
                x, y = mine[x], yours[y]
                once = node[x] < node[y] if low == high else node[x] != node[y]
                yield kept(x[once], y[once])

    dealt = tiled.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high")
    return dealt.mapInArrow(tidy(joined), "a long, b long").distinct()


def link_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    1. Rows with equal sets are one node, named by their least doc_id.
    2. Nodes that share an n-gram of their prefixes meet in its block. That loses no link.
    3. Rounds of pivots: in each block every node is compared with one of them, which joins most copies at once. The
       pivot then leaves its block, and blocks go on while their nodes are in different components; the next round
       takes new pivots, as long as a fair share of the pairs compared turns out to be linked, and ROUNDS times at most.
    4. What is still in different components of a block is joined by count-vector R-trees, each pair in one block.
       Sizes and bounds prune, exact intersections decide.
    5. Components of all links.

    Null and empty texts, and texts of white space alone, have no n-grams and are linked with nothing. Rows without
    doc_id are nodes like others, so they link what is alike to them; they get the least doc_id of their component, or
    null where it has none. Repeated rows get equal results; rows of one doc_id with different texts share the links
    that its texts have. A very long text's set is held whole, by one task. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams", shuffled=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = frequency_levels(docs, scratch, words)
    rows = scratch.save(profiles(docs, levels, words, percent).withColumn("row", F.monotonically_increasing_id()), "profiles")
    signed = rows.where("n > 0").groupBy("sign_a", "sign_b", "n").agg(F.min(F.struct("node", "row")).alias("p"), F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("rows"))
    signed = scratch.save(signed.select("sign_a", "sign_b", "n", "p.*", "name", "rows"), "nodes")
    unique = scratch.save(rows.join(signed.select("row"), "row", "left_semi").select("node", "n", "keys", "vector"), "unique")
    vectors = unique.select("node", "n", "vector")
    # dealt out once, for the counts and for the rows
    keyed = unique.select("node", "n", F.explode("keys").alias("block")).repartition("block")
    several = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("other"), F.min("n").alias("small"), F.max("n").alias("large"))
    several = several.where(f"m > 1 and p.node <> other and (m > 2 or 100 * small >= {percent} * large)").select("block", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    open_ = scratch.save(keyed.join(several, "block"), "open0")
    fit = f"node <> pivot and 100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)"
    stars = open_.where(fit)
    edges = spark.createDataFrame([], "a long, b long")
    turn = 0
    while True:
        pairs = scratch.save(_bounded(stars.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), vectors, percent), f"pairs{turn}", light=True)
        links = _linked(pairs, docs, scratch, f"links{turn}", words, percent)
        label = components(edges.unionByName(links), scratch, f"step{turn}")
        edges = label.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        left = open_.where("node <> pivot").select("block", "node", "n").join(label, "node", "left").select("block", "node", "n", F.coalesce("component", "node").alias("class"))
        heads = left.groupBy("block").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n", "class")).alias("p"))
        heads = heads.where("low <> high").select("block", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.class").alias("pivot_class"))
        turn += 1
        open_ = scratch.save(left.join(heads, "block"), f"open{turn}")
        scratch.drop(f"open{turn - 1}")
        if turn == ROUNDS or links.count() * FAIR <= pairs.count() or open_.isEmpty():
            break
        stars = open_.where(f"class <> pivot_class and {fit}")

    rest = with_homes(open_.select("block", "node", "n", "class"))
    more = _linked(scratch.save(tree_pairs(rest, vectors.drop("n"), percent), "tree", light=True), docs, scratch, "more", words, percent)
    whole = components(edges.unionByName(more), scratch, "whole")
    apart = signed.join(whole, "node", "left").where("component is not null").select("sign_a", "sign_b", F.col("n").alias("size"), "component", "name")
    least = apart.groupBy("component").agg(F.min("name").alias("least"))
    linked = apart.join(least, "component").select("sign_a", "sign_b", "size", "least")
    alone = signed.where("rows > 1").join(whole, "node", "left_anti").select("sign_a", "sign_b", F.col("n").alias("size"), F.col("name").alias("least"))
    groups = linked.unionByName(alone)
    same = (rows["sign_a"] == groups["sign_a"]) & (rows["sign_b"] == groups["sign_b"]) & (rows["n"] == groups["size"])
    found = rows.join(groups, same, "left").select(rows["doc_id"], rows["n"].alias("n_shingles"), F.when(rows["n"] > 0, F.coalesce(groups["least"], rows["doc_id"])).otherwise(rows["doc_id"]).alias("component_id"))
    return scratch.only(found)


def _linked(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, words: int, percent: int) -> DataFrame:
    """The pairs whose sets are alike. Only the sets of nodes in a pair are made again and moved."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = scratch.save(members(docs, nodes, words), f"{name}-sets", light=True)
    found = scratch.save(verified(pairs, sets, percent).distinct(), name, light=True)
    scratch.drop(f"{name}-sets")
    return found


def _bounded(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and count vectors allow."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * percent
            views = [[unpacked(v) for v in batch.column(c).to_pylist()] for c in (4, 5)]
            bound = np.array([overlap_bound(x, y) for x, y in zip(*views)], dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * bound >= sizes))

    side = lambda c: vectors.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("vector").alias(f"{c}_vector"))
    fit = (100 * F.least("a_n", "b_n")) >= percent * F.greatest("a_n", "b_n")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b", "a_n", "b_n", "a_vector", "b_vector").mapInArrow(tidy(test), "a long, b long")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents of which each group keeps one: that of its component's doc_id. All columns stay.

    Documents without n-grams and rows without doc_id are kept. Rows that share a doc_id are one document, of which
    the row with the least text stays.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    groups = scratch.save(link_groups(docs, words, percent), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    often = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    apart = scratch.save(gone.unionByName(often).distinct(), "apart")
    kept = docs.join(_small(apart), "doc_id", "left_anti")
    again = docs.join(_small(often.join(gone, "doc_id", "left_anti")), "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return kept.unionByName(again.select(F.struct("*").alias("_row"), "doc_id", "text").withColumn("_first", first).where("_first = 1").select("_row.*"))


def _small(ids: DataFrame) -> DataFrame:
    """A hint to broadcast ids where their number is within the bound."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, MIN(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
