"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table


def walkable(points: np.ndarray) -> np.ndarray:
    """The vectors as the graph measures them: single precision where it holds them and their squares exactly enough, that is
    where each component is a single-precision number and none is so large or small that squares leave its range."""
    points = np.ascontiguousarray(points, np.float64)
    size = np.abs(points[points != 0])
    single = points.astype(np.float32)
    fits = not len(size) or (size.min() > 1e-12 and size.max() < 1e15 and bool((single == points).all()))
    return single if fits else points


class Graph:
    """A directed graph over one shard's vectors: searches start at the medoid, edges are pruned by relaxed distance."""

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 7):
        self.points = walkable(points)
        n = len(points)
        # Edges back may fill a third more places before a point is pruned to its degree again.
        self.degree, self.edges = degree, np.full((n, degree + degree // 3 + 1), -1, np.int32)
        self.start = int(np.argmin(((self.points - self.points.mean(0)) ** 2).sum(1))) if n else 0
        # Batches that double in size, each inserted at once against the graph so far; a second pass refines.
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int64) if n else order
        for slack in (1.0, alpha):
            at = 1
            while at < n:
                size = min(n - at, max(1, min(at, 1024)))
                self._insert(order[at : at + size], beam, slack)
                at += size
        self._connect(beam)

    def _apart(self, nodes: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances of pairs (node, query row), by differences, so that far and tight clusters keep their digits; a few
        megabytes at a time, however long the vectors are."""
        out = np.empty(len(nodes), queries.dtype)
        step = max(1, (1 << 21) // max(1, self.points.shape[1]))
        for i in range(0, len(nodes), step):
            apart = self.points[nodes[i : i + step]] - queries[rows[i : i + step]]
            out[i : i + step] = np.einsum("pd,pd->p", apart, apart)
        return out

    def _reached(self) -> np.ndarray:
        """Which points the start leads to."""
        seen = np.zeros(len(self.points), bool)
        front = np.array([self.start])
        while len(front):
            seen[front] = True
            front = np.unique(self.edges[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        return seen

    def _connect(self, beam: int, spare: int = 4) -> None:
        """Pruning may cut points off: each gets an edge, in a place of its own, from the nearest that is reached and has one left."""
        if not len(self.points):
            return
        self.edges = np.concatenate([self.edges, np.full((len(self.points), spare), -1, np.int32)], axis=1)
        while len(lost := np.flatnonzero(~self._reached())):
            node = lost[0]
            near = self.search(self.points[[node]], beam)[0][0]
            near = near[near >= 0]
            room = (self.edges[near] < 0).any(1)
            while not room.any():  # all of the beam are full: more places for every point
                self.edges = np.concatenate([self.edges, np.full((len(self.points), spare), -1, np.int32)], axis=1)
                room[:] = True
            host = near[int(np.argmax(room))]
            self.edges[host, int(np.argmax(self.edges[host] < 0))] = node

    def search(self, queries: np.ndarray, beam: int, few: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances), nearest first, of the beams after greedy search from the start; -1 fills up."""
        q = np.ascontiguousarray(queries, np.float64)
        q = q.astype(self.points.dtype) if np.abs(q).max(initial=0) < 1e15 else q
        m, n = len(q), len(self.points)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, q.dtype)
        ids[:, 0] = self.start
        dist[:, 0] = self._apart(ids[:, 0], q, np.arange(m))
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        seen[:, self.start] = True
        live = np.arange(m)
        while True:
            open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
            going = np.isfinite(open_).any(1)
            live, open_ = live[going], open_[going]
            if not len(live):
                break
            # The nearest few that are not opened yet, and those of their neighbours that no step has seen.
            best = np.argpartition(open_, min(few, beam) - 1, axis=1)[:, :few]
            opened = np.isfinite(np.take_along_axis(open_, best, 1))
            row = live[:, None]
            done[row, best] |= opened
            near = self.edges[np.where(opened, ids[row, best], self.start)].reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[row, near]
            pair = np.sort(np.nonzero(fresh)[0] * n + near[fresh])
            at, node = np.divmod(pair[np.diff(pair, prepend=-1) > 0], n)
            seen[live[at], node] = True
            count = np.bincount(at, minlength=len(live))
            place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            new_ids = np.full((len(live), int(count.max())), -1, np.int64)
            new_d = np.full(new_ids.shape, np.inf, dist.dtype)
            new_ids[at, place], new_d[at, place] = node, self._apart(node, q, live[at])
            all_ids, all_d = np.concatenate([ids[live], new_ids], 1), np.concatenate([dist[live], new_d], 1)
            all_done = np.concatenate([done[live], np.zeros(new_ids.shape, bool)], 1)
            pick = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[live], dist[live] = np.take_along_axis(all_ids, pick, 1), np.take_along_axis(all_d, pick, 1)
            done[live] = np.take_along_axis(all_done, pick, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def _prune(self, nodes: np.ndarray, ids: np.ndarray, slack: float) -> np.ndarray:
        """Keep diverse edges: the nearest candidate stays and drops all that are much nearer to it than to the node.

        Products of candidates are taken as seen from their node, so that they keep the digits of its surroundings.
        """
        out = np.full((len(nodes), self.degree), -1, np.int32)
        block = max(1, (1 << 22) // ids.shape[1] ** 2)
        for at in range(0, len(nodes), block):
            node, near = nodes[at : at + block], ids[at : at + block]
            apart = self.points[np.maximum(near, 0)] - self.points[node][:, None, :]
            square = np.einsum("qkd,qkd->qk", apart, apart)
            product = apart @ apart.transpose(0, 2, 1)
            dist = np.where((near < 0) | (near == node[:, None]), np.inf, square)
            live = np.arange(len(node))
            for k in range(self.degree):
                best = dist[live].argmin(1)
                going = np.isfinite(dist[live, best])
                live, best = live[going], best[going]
                if not len(live):
                    break
                out[at + live, k] = near[live, best]
                between = square[live, best][:, None] + square[live] - 2 * product[live, best]
                left = np.where(slack * slack * between <= dist[live], np.inf, dist[live])
                left[np.arange(len(live)), best] = np.inf
                dist[live] = left
        return out

    def _insert(self, nodes: np.ndarray, beam: int, slack: float) -> None:
        ids = np.concatenate([self.search(self.points[nodes], beam)[0], self.edges[nodes].astype(np.int64)], 1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1  # own edges that the search found too
        kept = self._prune(nodes, ids, slack)
        self.edges[nodes] = -1
        self.edges[nodes, : self.degree] = kept
        # Edges back: fill free places, prune where there are none.
        src, dst = np.repeat(nodes, self.degree), kept.ravel().astype(np.int64)
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
        order = np.argsort(counts, kind="stable")  # targets of like width together
        targets, first, counts = targets[order], first[order], counts[order]
        places, at = self.edges.shape[1], 0
        while at < len(targets):
            some = slice(at, at + max(1, min(512, (1 << 19) // int(counts[min(at + 511, len(targets) - 1)]))))
            t, f, c = targets[some], first[some], counts[some]
            at += len(t)
            back = np.full((len(t), int(c.max())), -1, np.int64)
            row, nth = np.repeat(np.arange(len(t)), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            back[row, nth] = src[np.repeat(f, c) + nth]
            both = np.concatenate([self.edges[t].astype(np.int64), back], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, axis=1)  # free places last
            self.edges[t] = both[:, :places]
            full = (both >= 0).sum(1) > places
            if full.any():
                self.edges[t[full]] = -1
                self.edges[t[full], : self.degree] = self._prune(t[full], both[full], slack)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 32_768, degree: int = 32, beam: int = 96, shard_bytes: int = 128 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the nearest `k` found of all other vectors.

    score is the Euclidean distance in double precision of the original vectors; ties go to the smaller
    vec_id. Vectors go to shards of about `shard_rows` (long ones: of about `shard_bytes`) by hash, a task builds each shard's graph and runs all
    queries' beams through it, a block at a time; each shard's best are ranked together. Recall is a matter of
    `degree` and `beam`. Each query visits each shard: larger shards cost a build in a longer task and save visits, whose work
    hardly grows with the shard. The walk is in single precision where the vectors are. Equal vectors count as one point of a graph: among them only the k + 1 smallest ids
    can be in any answer, and those are found before the shuffle by a grouped limit.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
    another length than most have (the greater of two lengths that are as frequent). Rows that repeat an id with the
    same vector count once; a null id takes no part; other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).distinct()
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if length:
        rows, asked = rows.filter(F.size("v") == length[0].n), asked.filter(F.size("q") == length[0].n)
    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1)
    points = stash(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # at most k + 1 ids
    most = min(shard_rows, max(1, shard_bytes // (8 * length[0].n))) if length else shard_rows
    shards = max(1, -(-points.count() // most))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition is one shard, which `shard_rows` and `shard_bytes` bound."""
        held = list(batches)
        for number, shard in pd.concat(held).groupby("shard") if held else ():
            graph = Graph(np.stack(shard.v.to_list()), degree, beam)
            body = pickle.dumps((graph.points, [np.asarray(i, np.int64) for i in shard.ids], graph.edges, graph.start))
            yield pd.DataFrame({"shard": [number], "graph": [body]})

    def beams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, graph = [], None
        for batch in batches:
            # Each shard's graph comes first, then its queries.
            for at in np.split(np.arange(len(batch)), np.flatnonzero(batch.graph.notna())):
                part = batch.iloc[at]
                if len(part) and part.graph.iloc[0] is not None:
                    graph = Graph.__new__(Graph)
                    graph.points, ids, graph.edges, graph.start = pickle.loads(part.graph.iloc[0])
                    part = part.iloc[1:]
                for i in range(0, len(part), 256):
                    some = part.iloc[i : i + 256]
                    q = np.stack(some.q.to_list()).astype(np.float64)
                    out = []
                    for query_id, x, near in zip(some.query_id, q, graph.search(q, beam)[0], strict=True):
                        near = near[near >= 0]
                        d = np.sqrt(((graph.points[near].astype(np.float64) - x) ** 2).sum(1))  # the points are the originals exactly
                        out += [(int(query_id), int(v), float(d[o])) for o in np.argsort(d, kind="stable")[: k + 1] for v in ids[near[o]] if v != query_id]
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    graphs = stash(dealt.repartitionById(shards, F.col("shard")).mapInPandas(build, "shard int, graph binary"))
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "q")
    both = graphs.select("shard", "graph", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("q")).unionByName(copies.withColumn("graph", F.lit(None).cast("binary")))
    streamed = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    near = streamed.mapInPandas(beams, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's search of `embeddings`: each row whose id is divisible by 100 against all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))
