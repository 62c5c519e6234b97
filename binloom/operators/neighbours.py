"""Exact nearest neighbours of all rows, without comparing all pairs.

Equal vectors are one node, which keeps as many of its least keys as an answer can hold.
Pivots, a bounded number of nodes, make cells: a node belongs to the cell of its nearest
pivot, and its distance to the pivot puts it in one of the cell's rings; a ring of many
nodes is dealt to blocks. Each block is first searched by its own nodes, which bounds how
far a node's k-th neighbour can be. Then a node visits the rings that the triangle
inequality doesn't keep farther than that: those whose distances from their pivot, and
whose pivot against the node's own, allow it. Only visits are shuffled. Where distances tell
nothing, as among random vectors of many dimensions, all rings are visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.session import discard, written

#: Rows of a block, about; most pivots; rings of a cell; queries that a block meets at once.
BLOCK, PIVOTS, RINGS, QUERIES = 16384, 1024, 4, 32768
#: Rows of a block among which a first bound is sought.
FIRST = 2048
#: What rounding may add to a distance, relative to the lengths that it is made of.
SLACK = 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x to each of y, rounded."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """node (the least key), vector and keys (the keep least) of each distinct vector of (key, vector)."""
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("key"))).filter(F.col("n") <= keep)
    return least.groupBy("vector").agg(F.array_sort(F.collect_list("key")).alias("keys")).select(F.col("keys")[0].alias("node"), "vector", "keys")


def nearest_of(x: np.ndarray, y: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and distance of the k nearest of y to each row of x within its bound, equal distances by the row of y.

    Single precision leaves out what is farther than the bound by more than its rounding, or than the k-th
    of the first rows where there is no bound; the rest, a few of each row, is measured in double precision.
    """
    middle = y.mean(axis=0)
    near_x, near_y = x - middle, y - middle
    size, far = (near_y**2).sum(axis=1), (near_x**2).sum(axis=1)
    kind = np.float32 if max(size.max(initial=0), far.max(initial=0)) < 1e30 else np.float64
    slack = 8 * (x.shape[1] + 8) * np.finfo(kind).eps * (far + size.max(initial=0)) + 4 * np.finfo(kind).tiny
    low_y, low_size = np.ascontiguousarray(near_y.astype(kind).T), size.astype(kind)
    out: tuple[list, list, list] = [], [], []
    for at in range(0, len(x), 256):
        part, own, room = x[at : at + 256], far[at : at + 256], slack[at : at + 256]
        d = low_size - 2 * (near_x[at : at + 256].astype(kind) @ low_y)
        limit = bound[at : at + 256] ** 2 * (1 + SLACK) - own + room
        open_ = np.flatnonzero(np.isinf(limit))
        if len(open_) and len(y) > k:
            some = d[open_, : max(FIRST, k + 1)]
            limit[open_] = np.partition(some, k - 1, axis=1)[:, k - 1] + 2 * room[open_]
        flat = np.flatnonzero(d <= limit[:, None].astype(kind))
        row, to = flat // len(y), flat % len(y)
        exact = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            exact[i : i + (1 << 16)] = np.sqrt(((part[row[i : i + (1 << 16)]] - y[to[i : i + (1 << 16)]]) ** 2).sum(axis=1))
        order = np.lexsort((to, exact, row))
        row, to, exact = row[order], to[order], exact[order]
        first = np.searchsorted(row, np.arange(len(part)))
        good = (np.arange(len(row)) - first[row] < k) & (exact <= bound[at + row])
        for held, found in zip(out, (row[good] + at, to[good], exact[good]), strict=True):
            held.append(found)
    return tuple(np.concatenate(held) for held in out)


def searched(left: DataFrame, right: DataFrame, by: list[str], k: int, kind: str) -> DataFrame:
    """src, dst and distance of the k nearest of each group's nodes to each of its queries, within a query's bound."""
    key_type = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([("src", key_type), ("dst", key_type), ("distance", pa.float64())])

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return schema.empty_table()
        x, y = matrix(asked["vector"]), matrix(there["vector"])
        a, b, bound = asked["node"].to_numpy(), there["node"].to_numpy(), asked["bound"].to_numpy()
        order = np.argsort(b, kind="stable")
        row, to, d = nearest_of(x, y[order], bound, k)
        return pa.table([a[row], b[order][to], d], schema=schema)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"src {kind}, dst {kind}, distance double")


def with_pivots(rows: DataFrame, pivots: np.ndarray, find: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """The rows with what find makes of a batch and its distances to the pivots."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *find(batch, distances(matrix(batch.column("vector")), pivots))], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, f"{kinds}, {schema}")


def rings_of(nodes: DataFrame, block: int) -> tuple[DataFrame, np.ndarray, dict[str, np.ndarray]]:
    """The nodes with cell, radius, ring and split, the pivots, and of each ring that has nodes its cell, number, least and greatest radius and splits."""
    count = nodes.count()
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(min(PIVOTS, -(-count // (RINGS * block)))).select("vector").toArrow()  # PIVOTS rows at most
    pivots = matrix(chosen["vector"])
    placed = written(with_pivots(nodes, pivots, lambda _, d: [pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], "cell int, radius double"), "neighbours")
    edges = placed.groupBy("cell").agg(F.percentile_approx("radius", [k / RINGS for k in range(1, RINGS)], 1000).alias("edges"))  # a row a pivot
    ring = F.size(F.filter("edges", lambda e: e < F.col("radius")))
    ringed = written(placed.join(F.broadcast(edges), "cell").withColumn("ring", ring).drop("edges"), "neighbours")
    discard(placed)
    told = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).orderBy("cell", "ring").toPandas()  # RINGS rows a pivot
    rings = {c: told[c].to_numpy() for c in ("cell", "ring", "low", "high")} | {"splits": -(-told["n"].to_numpy() // block)}
    splits = F.broadcast(nodes.sparkSession.createDataFrame([(int(c), int(r), i, int(s)) for i, (c, r, s) in enumerate(zip(rings["cell"], rings["ring"], rings["splits"], strict=True))], "cell int, ring int, entry int, splits int"))
    return ringed.join(splits, ["cell", "ring"]).withColumn("split", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int")).drop("ring", "splits"), pivots, rings


def visits(bounded: DataFrame, pivots: np.ndarray, rings: dict[str, np.ndarray]) -> DataFrame:
    """The nodes (with cell and bound) with the numbers of the rings that can hold a neighbour within the bound."""

    def find(batch: pa.RecordBatch, d: np.ndarray) -> list[pa.Array]:
        cell, bound = (batch.column(c).to_numpy() for c in ("cell", "bound"))
        own = d[np.arange(len(d)), cell]
        to = d[:, rings["cell"]]
        apart = np.maximum(np.maximum(to - rings["high"], rings["low"] - to), (to - own[:, None]) / 2)
        row, entry = np.nonzero(apart <= bound[:, None] + SLACK * (1 + to))
        size = np.bincount(row, minlength=len(d))
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(entry.astype(np.int32)))]

    return with_pivots(bounded, pivots, find, "entries array<int>")


def nearest(df: DataFrame, key: str, vector: str, k: int = 7, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """src, dst, rank (from 1) and distance (Euclidean) of the k nearest rows of each row, equal distances by dst.

    A row is its own nearest neighbour unless itself is off, but for equal rows of smaller keys. Keys are whole
    numbers or strings, once each; vectors are of one length; rows without vector are left out.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull())
    kind = rows.schema["key"].dataType.simpleString()
    kind = kind if kind == "string" else "bigint"
    rows = rows.withColumn("key", F.col("key").cast(kind))
    nodes, m = written(nodes_of(rows, k + 1), "neighbours"), k if itself else k + 1  # a row's own node is among those found
    if nodes.isEmpty():
        return rows.select(F.col("key").alias("src"), F.col("key").alias("dst"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    located, pivots, rings = rings_of(nodes.select("node", "vector"), block)
    located = written(located, "neighbours")
    blocks, by = located.select("node", "vector", "entry", "split"), ["entry", "split"]
    own = written(searched(blocks.withColumn("bound", F.lit(float("inf"))), blocks, by, m, kind), "neighbours")
    bound = own.groupBy(F.col("src").alias("node")).agg(F.when(F.count("*") == m, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
    going = written(visits(located.join(bound, "node").select("node", "vector", "cell", "bound", "entry", "split"), pivots, rings).withColumnsRenamed({"entry": "at", "split": "at_split"}).drop("cell"), "neighbours")
    visit = going.withColumn("entry", F.explode("entries")).drop("entries")
    asked = visit.groupBy("entry").agg(F.count("*").alias("n")).select("entry", F.ceil(F.col("n") / QUERIES).cast("int").alias("parts"))  # a row a ring
    splits = F.broadcast(df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(rings["splits"])], "entry int, splits int"))
    visit = visit.join(splits, "entry").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).filter("not (entry = at and split = at_split)")
    visit = visit.join(F.broadcast(asked), "entry").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("node", "vector", "bound", *by, "part")
    hosts = blocks.join(F.broadcast(asked), "entry").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "vector", *by, "part")
    found = own.unionByName(searched(visit, hosts, [*by, "part"], m, kind))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).filter(F.col("n") <= m)
    keyed = first.select("src", "distance", F.col("dst").alias("node")).join(nodes.select("node", F.explode("keys").alias("dst")), "node")
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).filter(F.col("n") <= k + 1)
    lists = keyed.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("near"))
    lists = written(lists.join(nodes.select(F.col("node").alias("src"), "vector"), "src").select("vector", "near"), "neighbours")
    discard(located, own, going, nodes)
    near = F.col("near") if itself else F.filter("near", lambda x: x["dst"] != F.col("key"))
    out = rows.join(lists, "vector").select(F.col("key").alias("src"), F.posexplode(F.slice(near, 1, k)).alias("place", "n"))
    return out.select("src", F.col("n.dst").alias("dst"), (F.col("place") + 1).alias("rank"), F.col("n.distance").alias("distance"))
