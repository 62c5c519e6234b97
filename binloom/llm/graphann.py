"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of about SHARD by a hash of their id. A shard's graph grows
in batches: a greedy beam search from the entry node proposes a new node's neighbours;
relaxed distance pruning keeps one only if no kept one is nearer to it by the factor
RELAX; reverse edges are added and full lists pruned again. A query searches every shard
with a wider beam, and the best of all shards are ranked by the exact inner product.

Nearness is the inner product. With one more coordinate that gives all vectors of a shard
one length, and 0 for queries, that is the order of Euclidean distances, which pruning
needs. Equal vectors of a shard are one node; it keeps the MOST + 1 least ids, as many as
any answer can hold.

Vectors that are null, zero, empty or hold null or non-finite components take no part,
neither do rows without an id. Vectors of different lengths are never compared. Of rows
with one id all are candidates. With fewer candidates than asked for, all are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.session import written

#: Vectors of a shard, about; edges of a node; beams when building and searching; factor of pruning; nodes expanded in a step.
SHARD, DEGREE, BUILD_BEAM, BEAM, RELAX, EXPANDED = 20_000, 28, 48, 224, 1.15, 6
BATCH, QUERY_BLOCK, MOST = 512, 8192, 20


@dataclass
class Graph:
    vectors: np.ndarray  # float32, all of one length
    edges: np.ndarray  # DEGREE neighbours of each node, -1: none
    entries: np.ndarray  # where searches start


def distances(x: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distance, up to a constant for each row, of each row's nodes to its vector; all nodes have one length."""
    return -np.matmul(x[of], to[:, :, None])[:, :, 0]


def beam_search(graph: Graph, size: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes left in each query's beam and their distances, nearest first; -1 and inf where the beam isn't full."""
    q, e, r = len(queries), EXPANDED, graph.edges.shape[1]
    start = graph.entries[graph.entries < size]
    seen = np.zeros((q, size), dtype=np.int32)
    seen[:, start] = 1
    nodes = np.full((q, beam), -1, dtype=np.int32)
    far = np.full((q, beam), np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    first = np.tile(start, (q, 1))[:, :beam]
    d = distances(graph.vectors, first, queries)
    order = np.argsort(d, axis=1, kind="stable")
    k = first.shape[1]
    nodes[:, :k], far[:, :k], done[:, :k] = np.take_along_axis(first, order, 1), np.take_along_axis(d, order, 1), False
    live, stamp = np.arange(q), 1
    while len(live):
        n, f, g = nodes[live], far[live], done[live]
        open_ = ~g
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :e]  # the nearest that aren't expanded yet
        valid = np.take_along_axis(open_, pick, 1)
        some = valid.any(axis=1)
        if not some.all():
            live, n, f, g, pick, valid = live[some], n[some], f[some], g[some], pick[some], valid[some]
            if not len(live):
                break
        np.put_along_axis(g, pick, True, 1)
        at = np.where(valid, np.take_along_axis(n, pick, 1), 0)
        near = np.where(valid[:, :, None], graph.edges[at], -1).reshape(len(live), e * r)
        row = live[:, None]
        safe = np.maximum(near, 0)
        column = stamp + 1 + np.arange(e * r, dtype=np.int32)[None]
        new = (near >= 0) & (seen[row, safe] == 0)
        r_, c_ = np.nonzero(new)
        seen[live[r_], near[r_, c_]] = (stamp + 1 + c_).astype(np.int32)  # of repeats within a step the last counts
        new &= seen[row, safe] == column
        stamp += e * r
        d = np.full(near.shape, np.inf, dtype=np.float32)
        r_, c_ = np.nonzero(new)
        d[r_, c_] = -np.einsum("ij,ij->i", graph.vectors[near[r_, c_]], queries[live[r_]])
        all_d, all_n = np.concatenate([f, d], axis=1), np.concatenate([n, near], axis=1)
        all_g = np.concatenate([g, ~new], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), axis=1, kind="stable"), 1)
        f = np.take_along_axis(all_d, best, 1)
        nodes[live], far[live] = np.where(np.isfinite(f), np.take_along_axis(all_n, best, 1), -1), f
        done[live] = np.take_along_axis(all_g, best, 1) | ~np.isfinite(f)
    return nodes, far


def pruned(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """The candidates that each node keeps as neighbours; -1 stands for none, and repeats count once."""
    b, c = candidates.shape
    safe = np.maximum(candidates, 0)
    v = x[safe]
    base = np.einsum("ij,ij->i", x[own], x[own])[:, None] * 2
    d = base - 2 * np.matmul(v, x[own][:, :, None])[:, :, 0]
    d[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    v = x[np.maximum(candidates, 0)]
    between = base[:, :, None] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(d)
    kept = np.full((b, degree), -1, dtype=np.int32)
    count = np.zeros(b, dtype=np.int64)
    for k in range(c):
        take = np.flatnonzero(alive[:, k] & (count < degree))
        if not len(take):
            continue
        kept[take, count[take]] = candidates[take, k]
        count[take] += 1
        alive[take] &= RELAX * between[take, k] > d[take]
        alive[take] &= candidates[take] != candidates[take, k][:, None]
    return kept


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """The graph of some distinct vectors of one length."""
    n = len(vectors)
    order = np.random.default_rng(seed).permutation(n)  # nodes are numbered as they are added
    x = np.ascontiguousarray(vectors[order], dtype=np.float32)
    edges = np.full((n, DEGREE), -1, dtype=np.int32)
    graph = Graph(x, edges, np.arange(min(n, 16)))
    size = 0
    while size < n:
        own = np.arange(size, min(n, size + BATCH))
        parts = np.array_split(own, max(1, len(own) // 128))
        if size:
            near = [beam_search(graph, size, x[part], BUILD_BEAM)[0] for part in parts]
        else:  # the first batch is compared with itself
            near = [np.argsort(-(x[part] @ x[own].T), axis=1, kind="stable")[:, : 2 * BUILD_BEAM].astype(np.int32) for part in parts]
        kept = np.concatenate([pruned(x, part, found, DEGREE) for part, found in zip(parts, near, strict=True)])
        edges[own] = kept
        # edges back, all new ones of a node at once
        source, target = np.repeat(own, DEGREE), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        node, start, count = np.unique(target, return_index=True, return_counts=True)
        degree = (edges[node] >= 0).sum(axis=1)
        fits = degree + count <= DEGREE
        place = np.arange(len(target)) - np.repeat(start, count) + np.repeat(degree, count)
        easy = np.repeat(fits, count)
        edges[target[easy], place[easy]] = source[easy]
        hard = np.flatnonzero(~fits)
        while len(hard):  # those with few new edges first, so that the rows of a block are about as long
            hard = hard[np.argsort(count[hard], kind="stable")]
            part, hard = hard[:256], hard[256:]
            wide = np.full((len(part), DEGREE + int(count[part].max())), -1, dtype=np.int32)
            wide[:, :DEGREE] = edges[node[part]]
            for i, p in enumerate(part.tolist()):
                wide[i, DEGREE : DEGREE + count[p]] = source[start[p] : start[p] + count[p]]
            edges[node[part]] = pruned(x, node[part], wide, DEGREE)
        size = int(own[-1]) + 1
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    renamed = np.where(edges >= 0, order[np.maximum(edges, 0)], -1).astype(np.int32)
    return Graph(x[back], renamed[back], order[: min(n, 16)])


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def extended(x: np.ndarray) -> np.ndarray:
    """One more coordinate, which gives all rows the length of the longest."""
    square = (x**2).sum(axis=1)
    return np.c_[x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))].astype(np.float32)


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: ids and vectors of its nodes, and their edges, as bytes; from (id, vector)."""

    def run(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        x, ids = matrix(table["vector"], dim), table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        node = node.ravel()
        by = np.argsort(node, kind="stable")
        start = np.searchsorted(node[by], np.arange(len(distinct)))
        keep = np.arange(len(by)) - start[node[by]] <= MOST
        graph = build(extended(distinct))
        row = [shard, dim, ids[by][keep].tobytes(), node[by][keep].astype(np.int32).tobytes(), distinct.tobytes(), graph.edges.tobytes(), graph.entries.astype(np.int32).tobytes()]
        return pa.table([[v] for v in row], schema=pa.schema([("shard", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "node", "x", "edges", "entries"))]))

    keyed = vectors.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return keyed.repartition(max(1, shards), "shard", "dim").groupBy("shard", "dim").applyInArrow(run, "shard long, dim int, ids binary, node binary, x binary, edges binary, entries binary")


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", most: int = MOST, beam: int = BEAM, shard_size: int = SHARD, owner: str = "query") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the most nearest rows found for each row that queries selects."""
    good = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = good.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    total, asked = good.agg(F.count("*"), F.count_if(queries)).first()
    shards, blocks = max(1, -(-total // shard_size)), max(1, -(-asked // QUERY_BLOCK))
    graphs = written(index(rows, shards), owner)
    sets = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = good.filter(queries).select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    wanted = wanted.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(blocks)).cast("int"))
    wanted = wanted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))

    def run(left: Iterator[pa.Table] | pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        get = lambda c, kind: np.frombuffer(left[c][0].as_py(), dtype=kind)
        dim = left["dim"][0].as_py()
        ids, node, x = get("ids", np.int64), get("node", np.int32), get("x", np.float64).reshape(-1, dim)
        graph = Graph(extended(x), get("edges", np.int32).reshape(len(x), -1), get("entries", np.int32))
        start = np.searchsorted(node, np.arange(len(x) + 1))
        q, q_ids, out = matrix(right["vector"], dim), right["query_id"].to_numpy(), []
        for at in range(0, len(q), 256):
            part, part_ids = q[at : at + 256], q_ids[at : at + 256]
            found, _ = beam_search(graph, len(x), np.c_[part, np.zeros(len(part))].astype(np.float32), beam)
            for i in range(len(part)):
                nodes = found[i][found[i] >= 0][: 2 * most + 2]
                count = start[nodes + 1] - start[nodes]
                rows = np.repeat(start[nodes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                score = np.repeat(np.array([part[i] @ x[k] for k in nodes]), count)
                rows, score = rows[ids[rows] != part_ids[i]], score[ids[rows] != part_ids[i]]
                best = np.lexsort((ids[rows], -score))[:most]
                out.append((np.full(len(best), part_ids[i]), ids[rows][best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    hits = sets.groupBy("shard", "dim", "block").cogroup(wanted.groupBy("shard", "dim", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
