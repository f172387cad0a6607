"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

A shard's distinct vectors are inserted in batches: a greedy beam search from the entry points proposes neighbours, and
pruning with a relaxed distance keeps those that no kept, nearer neighbour is (``ALPHA`` times) closer to; edges are then
also added backwards, and pruned again where a point has too many. Queries are broadcast in blocks of ``BLOCK_BYTES`` at
most, and every shard is read where it lies, once for each block; a beam search finds candidates in its graph, whose
distances are then computed in double precision on the original vectors. Only each task's best candidates of a query
travel. Equal vectors are one point of the graph with all their ids. Shards and blocks have a bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Scratch, ship
from .lean import lean, lean_group

SHARD_ROWS, BLOCK_BYTES = 1 << 14, 32 << 20
DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH, ENTRIES = 32, 48, 256, 1.2, 128, 24


class Graph:
    def __init__(self, points: np.ndarray, degree: int = DEGREE, edges: np.ndarray | None = None, entries: list[int] | None = None):
        self.points = points.astype(np.float32)
        self.degree = degree
        if edges is not None:
            self.entries, self.edges = entries, edges
            return
        # entry points: the most central one, then one by one the farthest from all before
        far = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        self.entries = [int(far.argmin())]
        far[:] = np.inf
        while len(self.entries) < min(ENTRIES, len(points)):
            np.minimum(far, ((points - points[self.entries[-1]]) ** 2).sum(axis=1), out=far)
            self.entries.append(int(far.argmax()))
        self.edges = np.full((len(points), degree), -1, np.int32)
        self._build()

    def search(self, queries: np.ndarray, beam: int, done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(points, squared distances) of the beam's end for each query, nearest first; -1 and inf where it has fewer."""
        q, n = queries.astype(np.float32), len(queries)
        at, dist = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
        k = len(self.entries)
        at[:, :k] = self.entries
        dist[:, :k] = ((q[:, None] - self.points[self.entries][None]) ** 2).sum(axis=2)
        spent, seen = np.zeros((n, beam), bool), np.zeros((n, len(self.points) + 1), bool)
        seen[:, self.entries] = True
        live = np.arange(n)
        while live.size:
            free = np.where(spent[live] | (at[live] < 0), np.inf, dist[live])
            k = free.argmin(axis=1)
            go = free[np.arange(len(live)), k] < np.inf
            live, k = live[go], k[go]
            if not live.size:
                break
            spent[live, k] = True
            near = self.edges[at[live, k]].astype(np.int64)
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], near] |= new
            d = np.full(near.shape, np.inf, np.float32)
            i, j = np.nonzero(new)
            d[i, j] = ((self.points[near[i, j]] - q[live[i]]) ** 2).sum(axis=1)
            all_d, all_at = np.concatenate([dist[live], d], axis=1), np.concatenate([at[live], np.where(new, near, -1)], axis=1)
            all_spent = np.concatenate([spent[live], np.zeros(near.shape, bool)], axis=1)
            by = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live], at[live], spent[live] = (np.take_along_axis(x, by, axis=1) for x in (all_d, all_at, all_spent))
        return at, dist

    def prune(self, who: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """For each point, up to ``degree`` of its candidates (-1: none): nearest first, each drops those that it is closer to."""
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == who[:, None]] = -1
        x = self.points[cand]
        d = ((x - self.points[who][:, None]) ** 2).sum(axis=2)
        d[cand < 0] = np.inf
        norm = (x * x).sum(axis=2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        out, alive, rows = np.full((len(who), self.degree), -1, np.int32), np.isfinite(d), np.arange(len(who))
        for k in range(self.degree):
            best = np.where(alive, d, np.inf).argmin(axis=1)
            ok = alive[rows, best]
            if not ok.any():
                break
            out[ok, k] = cand[ok, best[ok]]
            alive &= ALPHA**2 * between[rows, best] > d
            alive[rows, best] = False
        return out

    def _build(self) -> None:
        n, r = len(self.points), np.random.default_rng(1)
        order = r.permutation(n)
        order = np.concatenate([self.entries, order[~np.isin(order, self.entries)]])
        lo = len(self.entries)
        self.edges[self.entries] = self.prune(order[:lo], np.tile(order[:lo], (lo, 1)))
        while lo < n:
            who = order[lo : lo + min(BATCH, max(1, lo))]
            lo += len(who)
            found, _ = self.search(self.points[who], BUILD_BEAM)
            # points of one batch do not see each other in the graph yet
            mates = np.broadcast_to(who, (len(who), len(who)))
            d = ((self.points[who][:, None] - self.points[who][None]) ** 2).sum(axis=2)
            near = np.take_along_axis(mates, np.argsort(d, axis=1)[:, : min(9, len(who))], axis=1)
            self.edges[who] = self.prune(who, np.concatenate([found, near], axis=1))
            src = np.repeat(who, self.degree)
            dst = self.edges[who].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            target, first, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(target), int(count.max(initial=0))), -1, np.int64)
            extra[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            both = np.concatenate([self.edges[target].astype(np.int64), extra], axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(axis=1) > self.degree
            self.edges[target[full]] = self.prune(target[full], both[full])
            short = np.flatnonzero(~full)
            left = np.sort(both[short], axis=1)[:, ::-1]
            self.edges[target[short]] = left[:, : self.degree]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if isinstance(col, pa.ChunkedArray) else col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _indexed(key, table):
    """One shard as one row: its distinct vectors, their ids and the graph."""
    dim = key[0].as_py()
    v, ids = _matrix(table["v"], dim), table["vec_id"].to_numpy()
    points, inv = np.unique(v, axis=0, return_inverse=True)
    by = np.lexsort((ids, inv.ravel()))
    g = Graph(points)
    row = {"dim": [dim], "shard": [key[1].as_py()], "points": [points.tobytes()], "ids": [ids[by].tobytes()], "first": [np.searchsorted(inv.ravel()[by], np.arange(len(points) + 1)).tobytes()], "edges": [g.edges.tobytes()], "entries": [g.entries]}
    return pa.table(row, pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("points", pa.binary()), ("ids", pa.binary()), ("first", pa.binary()), ("edges", pa.binary()), ("entries", pa.list_(pa.int32()))]))


_INDEX = "dim int, shard int, points binary, ids binary, first binary, edges binary, entries array<int>"


def _best(found: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of (query, vector, distance) columns, the ``top`` nearest rows of each query."""
    who, ids, dist = found
    by = np.lexsort((ids, dist, who))
    who, ids, dist = who[by], ids[by], dist[by]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < top
    return [who[keep], ids[keep], dist[keep]]


def _asked(shared, top: int):
    """Searches a task's shards for all queries of a block, and merges what they find."""

    def run(batches):
        blocks, held = shared.value, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1).to_pylist()[0]
                dim = r["dim"]
                if dim not in blocks:
                    continue
                points = np.frombuffer(r["points"]).reshape(-1, dim)
                ids, first = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["first"], np.int64)
                g = Graph(points, edges=np.frombuffer(r["edges"], np.int32).reshape(len(points), -1), entries=r["entries"])
                who, q = blocks[dim]
                for lo in range(0, len(q), 256):
                    at, _ = g.search(q[lo : lo + 256], BEAM)
                    out = [[held[0]], [held[1]], [held[2]]]
                    for x, i, near in zip(q[lo : lo + 256], who[lo : lo + 256].tolist(), at, strict=True):
                        near = near[near >= 0]
                        d = np.sqrt(((points[near] - x) ** 2).sum(axis=1))
                        near_ids = [ids[first[p] : first[p + 1]][: top + 1] for p in near]  # sorted; the query's own may be one
                        found, dist = np.concatenate(near_ids), np.repeat(d, [len(y) for y in near_ids])
                        found, dist = found[found != i], dist[found != i]
                        by = np.lexsort((found, dist))[:top]
                        for o, v in zip(out, (np.full(len(by), i), found[by], dist[by]), strict=True):
                            o.append(v)
                    held = [np.concatenate(o) for o in out]
            held = _best(held, top)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(held, top)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, top: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that the column ``is_query`` marks,
    its ``top`` nearest other rows found, by Euclidean distance, ties to the smaller vec_id.

    Rows without vec_id, and embeddings that are null, empty, zero or hold null or non-finite components, take no part.
    Vectors are compared only with vectors of their length. Rows equal in id and vector count once. Fewer candidates than
    ``top`` give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)
    rows = scratch.save(rows.distinct().withColumn("dim", F.size("v")), "rows")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    spread = lambda k, *of: F.pmod(F.xxhash64(*of), F.lit(k)).cast("int")
    index = scratch.save(rows.withColumn("shard", spread(shards, "vec_id")).groupBy("dim", "shard").applyInArrow(lean_group(_indexed), _INDEX), "index")
    queries, found = rows.where(is_query).select("vec_id", "dim", "v"), None
    size = queries.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES))  # half full on average, so that none is too large
    for k in range(blocks):
        got = queries.where(spread(blocks, "vec_id", "v") == k).toArrow().sort_by([("dim", "ascending"), ("vec_id", "ascending")])
        sizes, dims = got["dim"].to_numpy(), {}
        for dim in np.unique(sizes).tolist():
            of = got.filter(pa.array(sizes == dim))
            dims[dim] = (of["vec_id"].to_numpy(), _matrix(of["v"], dim))
        shared = spark.sparkContext.broadcast(dims)
        part = scratch.save(index.mapInArrow(lean(_asked(shared, top)), "query_id long, vec_id long, score double"), f"found_{k}")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    scratch.drop("index", "rows")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
