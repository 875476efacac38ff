"""Nearest neighbours by robust-pruned directed graphs, one a shard, searched with beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

TOP = 20
#: Edges of a point, width of the beams that build and that search, relaxation of distances when pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 48, 64, 80, 1.2
#: A shard's beam is widened until a sample of so many of its points reaches this recall against brute force.
PROBES, LEAST_RECALL = 256, 0.97
#: Vectors of a shard at most, and shards at least (so that small tables use all cores too).
SHARD_ROWS, LEAST_SHARDS = 25_000, 8
#: Points that are inserted, and queries that are searched, at once.
BATCH = 256
#: Points of the sample that searches begin from (at least; four times the root of all), and how many of them each takes.
ENTRIES, STARTS = 256, 4


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and vector (doubles) of the rows that take part: not null or empty, not all zero, every component finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    wide = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias("vector"))
    return wide.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


class Graph:
    """A directed graph over the distinct vectors of a shard, for largest inner products.

    The graph is built with Euclidean distances between inverted points (each divided by its squared length, which
    makes neighbours of the points that large inner products reach one after the other); searches of the finished graph
    go by inner products. Points are inserted in batches in two passes: a beam search proposes what it visited as
    neighbours, pruning keeps a candidate only while no kept one is nearer to it by the factor ALPHA, and edges are
    made both ways and pruned again where a point has too many.
    """

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        plain = points / max(np.abs(points).max(initial=0.0), 1e-300)
        norms = np.einsum("ij,ij->i", plain, plain)
        turned = plain / np.maximum(norms, 1e-30)[:, None]
        turned /= max(np.sqrt(np.einsum("ij,ij->i", turned, turned).max(initial=0.0)), 1e-30)
        self.points = turned.astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.degree, self.alpha = degree, alpha
        n = len(points)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        if not n:
            return
        order = np.random.default_rng(7).permutation(n)
        self.entries = order[: max(ENTRIES, int(4 * np.sqrt(n)))]
        rng = np.random.default_rng(8)
        if n > 1:
            seeds = rng.integers(0, n - 1, (n, min(degree // 4, n - 1)))
            self.edges[:, : seeds.shape[1]] = seeds + (seeds >= np.arange(n)[:, None])
        for relax in (1.0, alpha):
            for at in range(0, n, BATCH):
                self._insert(order[at : at + BATCH], beam, relax)
        self.points, self.squares = plain.astype(np.float32), np.zeros(n, dtype=np.float32)
        self.entries = np.unique(np.concatenate([self.entries, np.argsort(-norms, kind="stable")[: ENTRIES // 2]]))

    def _insert(self, chosen: np.ndarray, beam: int, alpha: float) -> None:
        found, passed = self.search(self.points[chosen], beam, trail=True)
        own = self.edges[chosen]
        candidates = np.concatenate([found, passed, own], axis=1)
        self.edges[chosen] = kept = self._pruned(chosen, candidates, alpha)
        source = np.repeat(chosen, kept.shape[1])
        target = kept.ravel()
        ok = target >= 0
        self._link_back(target[ok], source[ok], alpha)

    def _link_back(self, target: np.ndarray, source: np.ndarray, alpha: float) -> None:
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(heads), BATCH):
            part = slice(at, at + BATCH)
            width = int(count[part].max())
            extra = np.full((len(heads[part]), width), -1, dtype=np.int64)
            row = np.repeat(np.arange(len(heads[part])), count[part])
            column = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            start = first[at]
            extra[row, column] = source[start : start + len(row)]
            both = np.concatenate([self.edges[heads[part]], extra], axis=1)
            both = self._distinct(both)
            full = (both >= 0).sum(axis=1) > self.degree
            packed = -np.sort(-both, axis=1)[:, : self.degree]
            self.edges[heads[part][~full]] = packed[~full]
            if full.any():
                self.edges[heads[part][full]] = self._pruned(heads[part][full], both[full], alpha)

    @staticmethod
    def _distinct(ids: np.ndarray) -> np.ndarray:
        """Each row sorted, with -1 for repeats."""
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        return ids

    def _pruned(self, owners: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """At most `degree` diverse neighbours of each owner: the nearest candidate is kept, and those that it is
        nearer to than the owner by the factor alpha are dropped, again and again."""
        ids = self._distinct(candidates)
        ids[ids == owners[:, None]] = -1
        vectors = self.points[np.maximum(ids, 0)]
        far = np.where(ids >= 0, ((vectors - self.points[owners][:, None, :]) ** 2).sum(axis=2), np.inf)
        order = np.argsort(far, axis=1)[:, : 3 * self.degree]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        square = (vectors**2).sum(axis=2)
        between = square[:, :, None] + square[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
        alive = ids >= 0
        out = np.full((len(owners), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(owners))
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            best = np.argmax(alive, axis=1)
            out[some, k] = ids[rows[some], best[some]]
            alive &= ~((alpha * alpha * between[rows, best] <= far) & some[:, None])
            alive[rows, best] = False
        return out

    def search(self, queries: np.ndarray, beam: int, trail: bool = False):
        """Numbers of the `beam` nearest points found for each query, nearest first, -1 where there are fewer; with
        `trail` also the points that the search expanded, for the long edges among them.

        A search begins at the nearest of a sample of the points, so that it needn't find its way between clusters.
        """
        q, n = len(queries), len(self.points)
        beam = min(beam, n)
        ids = np.full((q, beam), -1, dtype=np.int64)
        far = np.full((q, beam), np.inf, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        passed: list[tuple[np.ndarray, np.ndarray]] = []
        if n and q:
            starts = min(STARTS, beam, len(self.entries))
            gap = self.squares[self.entries] - 2 * queries @ self.points[self.entries].T
            near = np.argpartition(gap, starts - 1, axis=1)[:, :starts]
            ids[:, :starts], done[:, :starts] = self.entries[near], False
            far[:, :starts] = np.take_along_axis(gap, near, 1)
            seen = np.zeros((q, n), dtype=bool)
            seen[np.arange(q)[:, None], ids[:, :starts]] = True
        active = np.arange(q) if n else np.empty(0, dtype=np.int64)
        while len(active):
            waiting = np.where(done[active], np.inf, far[active])
            first = np.argmin(waiting, axis=1)
            open_ = ~done[active, first]
            active, first = active[open_], first[open_]
            if not len(active):
                break
            done[active, first] = True
            expanded = ids[active, first]
            if trail:
                passed.append((active, expanded))
            new = self.edges[expanded].astype(np.int64)
            fresh = (new >= 0) & ~seen[active[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], new[r, c]] = True
            distance = np.full(new.shape, np.inf, dtype=np.float32)
            hit = new[r, c]
            distance[r, c] = self.squares[hit] - 2 * np.einsum("ij,ij->i", self.points[hit], queries[active[r]])
            all_far = np.concatenate([far[active], distance], axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[active] = np.take_along_axis(all_far, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, new, -1)], axis=1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), keep, 1)
        order = np.argsort(far, axis=1)
        ids = np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(ids, order, 1), -1)
        if not trail:
            return ids
        out = np.full((q, len(passed)), -1, dtype=np.int64)
        for k, (rows, nodes) in enumerate(passed):
            out[rows, k] = nodes
        return ids, out

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Numbers of the `beam` points found whose inner products with each query are largest, largest first."""
        unit = queries / np.maximum(np.abs(queries).max(axis=1, keepdims=True, initial=0.0), 1e-300)
        parts = [self.search(unit[at : at + BATCH].astype(np.float32), beam) for at in range(0, len(queries), BATCH)]
        return np.concatenate(parts) if parts else np.empty((0, min(beam, len(self.points))), dtype=np.int64)

    def fitting_beam(self, points: np.ndarray, top: int, beam: int, least: float = LEAST_RECALL) -> int:
        """The beam, doubled until a sample of the points finds at least that share of its `top` largest inner
        products. A beam as wide as the graph finds all."""
        n = len(points)
        probes = np.random.default_rng(9).permutation(n)[:PROBES]
        product = points[probes] @ points.T
        want = np.partition(product, n - min(top, n), axis=1)[:, n - min(top, n)] if n else np.empty(0)
        beam = max(beam, top)
        while beam < n:
            found = self.nearest(points[probes], beam)
            hits = np.where(found >= 0, np.take_along_axis(product, np.maximum(found, 0), 1), -np.inf)
            if (hits >= want[:, None]).sum(axis=1).clip(max=top).sum() >= least * top * len(probes):
                break
            beam *= 2
        return beam


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Shard:
    """The graph over a shard's vectors, and what answers queries from it.

    Equal vectors are one point of the graph; of its ids, the `top` + 1 smallest can be among a query's best.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, top: int, beam: int):
        self.top = top
        self.points, which = np.unique(points, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order = order[place <= top]
        self.ids = ids[order]
        self.begins = np.searchsorted(which[order], np.arange(len(self.points) + 1))
        self.graph = Graph(self.points)
        self.beam = self.graph.fitting_beam(self.points, top, beam)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's `top` best of the shard among those that the beam finds. Scores are
        inner products of the original vectors in double precision."""
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(query_ids), BATCH):
            part = queries[at : at + BATCH]
            for query, vector, found in zip(query_ids[at : at + BATCH], part, self.graph.nearest(part, self.beam)):
                hits = found[found >= 0][: max(4 * self.top, 80)]
                lengths = self.begins[hits + 1] - self.begins[hits]
                owner = np.repeat(hits, lengths)
                members = self.ids[np.repeat(self.begins[hits], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
                score = (self.points[owner] * vector).sum(axis=1)
                other = members != query
                best = np.lexsort((members[other], -score[other]))[: self.top]
                out.append((np.full(len(best), query), members[other][best], score[other][best]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def nearest(vectors: DataFrame, top: int = TOP, every: int = 20, beam: int = SEARCH_BEAM, key: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every`, its `top` nearest other rows.

    Rows are dealt out to shards by a hash of the key, so that no cluster of like vectors makes a large shard; every
    shard is one task, which indexes all its rows in one graph and searches all queries, a batch at a time; each query's
    best of all shards stay. The number of shards follows the number of rows. Rows that repeat a key count once, with
    the least of their vectors. Rows that are not usable() take no part, nor do vectors of another length than most
    have; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = scratch.save(usable(vectors, key, column).groupBy(key).agg(F.min("vector").alias("vector")), "rows")
    lengths = rows.groupBy(F.size("vector").alias("k")).count().orderBy(F.desc("count"), "k").head()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == lengths["k"])
    shards = max(LEAST_SHARDS, -(-lengths["count"] // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).withColumn("query", F.lit(False))
    asked = rows.where(F.col(key) % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("query", F.lit(True))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's points come first; they are held. Its queries follow and are answered as they come."""
        number, held, shard = -1, [], None

        def built() -> Shard | None:
            return Shard(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held]), top, beam) if held else None

        for batch in batches:
            query, of = batch.column("query").to_numpy(zero_copy_only=False), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (query[1:] != query[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                if high == low:
                    continue
                part = batch.slice(low, high - low)
                ids, matrix = part.column(key).to_numpy(), _matrix(part.column("vector"))
                if of[low] != number:
                    number, held, shard = of[low], [], None
                if not query[low]:
                    held.append((ids, matrix))
                    continue
                shard = shard or built()
                if shard is not None:
                    found = shard.answer(ids, matrix)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(found, schema)], schema=schema)

    both = dealt.unionByName(asked).select("shard", "query", key, "vector")
    found = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "query").mapInArrow(tidy(searched), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return scratch.only(ranked.select("query_id", "rank", "vec_id", "score"))
