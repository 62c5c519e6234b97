"""Clustering of design matrices: k-means, mixtures, complete linkage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators.components import components
from binloom.session import discard, written

#: Rows that complete linkage takes at once; its memory grows with their square. Rows of a block of a larger group, and of the small groups of a task, about.
LINKED, BLOCK, BIN = 4096, 2048, 256
STARTS = 10
#: Distances that k-means holds at once.
CELLS = 1 << 21


def _vectors(df: DataFrame, key: str, features: str) -> DataFrame:
    return df.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("_vector"))


def _sums(rows: DataFrame, find: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of what find makes of each batch's vectors and row numbers, width numbers: one aggregation of a row a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += find(_matrix(batch.column("x")), batch.column("row").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    out = rows.select("x", "row").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(width)
    total[out["i"].to_numpy()] = out["v"].to_numpy()
    return total


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest center."""
    own, far, step = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), max(1, CELLS // len(centers))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = np.maximum((part**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None] - 2 * part @ centers.T, 0)
        own[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = np.take_along_axis(d, own[at : at + step, None], 1)[:, 0]
    return own, far


def seeded_centers(rows: DataFrame, n: int, starts: int, seed: int, over: int = 2, steps: int = 5) -> np.ndarray:
    """[start, center, dimension]: centers drawn by their squared distance to those before, a few at a time.

    Each step is one pass: every start draws about over * n rows by their share of its cost, with numbers
    that hash the row, so that how tasks are cut doesn't matter. What was drawn, some (steps * over + 1) * n rows a start,
    is weighed by the rows nearest to it in one more pass and reduced to n centers on the driver.
    """

    def unit(row: np.ndarray, start: int, step: int) -> np.ndarray:
        x = row.astype(np.uint64) + np.uint64((seed * 1_000_003 + start * 1009 + step) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)

    def drawn(keep: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, row = _matrix(batch.column("x")), batch.column("row").to_numpy()
                    for s in range(starts):
                        at = np.flatnonzero(keep(x, row, s))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(row[at]), batch.column("x").take(pa.array(at))], names=["start", "row", "x"])

        out = rows.select("x", "row").mapInArrow(run, "start long, row long, x array<double>").toPandas().sort_values(["start", "row"])
        return [np.array(out["x"][out["start"] == s].tolist(), dtype=np.float64) for s in range(starts)]

    first = rows.agg(*[F.min_by("x", F.xxhash64("row", F.lit(seed), F.lit(s))).alias(f"s{s}") for s in range(starts)]).first()
    chosen = [np.array([first[s]], dtype=np.float64) for s in range(starts)]
    for step in range(steps):
        cost = _sums(rows, lambda x, _, c=chosen: np.array([_nearest(x, c[s])[1].sum() for s in range(starts)]), starts)
        new = drawn(lambda x, row, s, c=chosen, cost=cost, step=step: unit(row, s, step) * cost[s] < over * n * _nearest(x, c[s])[1])
        chosen = [np.concatenate([c, a]) if len(a) else c for c, a in zip(chosen, new, strict=True)]
    size = max(map(len, chosen))

    def weights(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_nearest(x, c)[0], minlength=size) for c in chosen])

    weight = _sums(rows, weights, starts * size).reshape(starts, size)
    out = []
    for s, c in enumerate(chosen):
        rng, w = np.random.default_rng(seed + s), weight[s, : len(c)]
        picked = [c[rng.choice(len(c), p=w / w.sum())]]
        while len(picked) < n:
            d = _nearest(c, np.array(picked))[1] * w
            picked.append(c[rng.choice(len(c), p=d / d.sum())] if d.sum() > 0 else c[len(picked) % len(c)])
        m = np.array(picked)
        for _ in range(20):
            own = _nearest(c, m)[0]
            heavy = np.bincount(own, weights=w, minlength=n)
            m = np.where(heavy[:, None] > 0, np.stack([np.bincount(own, weights=w * c[:, k], minlength=n) for k in range(c.shape[1])], axis=1) / np.maximum(heavy, 1e-300)[:, None], m)
        out.append(m)
    return np.stack(out)


def kmeans(df: DataFrame, n: int, key: str = "scaffold", features: str = "features", seed: int = 1, starts: int = STARTS, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """key and cluster (from 0): of several starts the one with the least cost.

    All starts go forward together: a round is one pass over the rows, whatever their number. A start
    ends when its cost falls by less than the tolerance's share. Rows without features are left out.
    """
    rows = written(df.filter(F.col(features).isNotNull()).select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x")).withColumn("row", F.xxhash64("key")))
    kind = rows.schema["key"].dataType.simpleString()
    if rows.isEmpty():
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("cluster"))
    centers = seeded_centers(rows, n, starts, seed)
    dim, last, best = centers.shape[2], np.full(starts, np.inf), centers
    for _ in range(rounds):
        def moved(x: np.ndarray, _: np.ndarray, at: np.ndarray = centers) -> np.ndarray:
            out = []
            for s in range(starts):
                own, far = _nearest(x, at[s])
                out += [np.stack([np.bincount(own, weights=x[:, k], minlength=n) for k in range(dim)], axis=1).ravel(), np.bincount(own, minlength=n), far.sum()[None]]
            return np.concatenate(out)

        found = _sums(rows, moved, starts * (n * dim + n + 1)).reshape(starts, -1)
        sums, count, cost = found[:, : n * dim].reshape(starts, n, dim), found[:, n * dim : -1], found[:, -1]
        best = centers
        if (last - cost <= tolerance * np.maximum(cost, 1e-300)).all():
            break
        last = cost
        centers = np.where(count[:, :, None] > 0, sums / np.maximum(count, 1)[:, :, None], centers)
    chosen = best[int(cost.argmin())]

    def labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(_nearest(_matrix(batch.column("x")), chosen)[0])], names=["key", "cluster"])

    return rows.mapInArrow(labels, f"key {kind}, cluster long").withColumnRenamed("key", key)


def gaussian_mixture(df: DataFrame, n: int, key: str = "scaffold", features: str = "features", seed: int = 1, rounds: int = 30, starts: int = 3) -> DataFrame:
    """key, cluster (from 0) and probability under a mixture with full covariances: of several starts the likeliest."""
    rows = written(_vectors(df, key, features))
    fits = (GaussianMixture(k=n, featuresCol="_vector", predictionCol="cluster", probabilityCol="_p", seed=seed + i, maxIter=rounds).fit(rows) for i in range(starts))
    model = max(fits, key=lambda m: m.summary.logLikelihood)
    return model.transform(rows).select(key, F.col("cluster").cast("long").alias("cluster"), F.array_max(vector_to_array("_p")).alias("probability"))


def dirichlet_mixture(df: DataFrame, n: int, key: str = "scaffold", features: str = "features", concentration: float = 0.5, rounds: int = 25, seed: int = 1) -> DataFrame:
    """key, cluster (from 0) and probability under a truncated Dirichlet-process mixture with one covariance for all components.

    Starts from k-means. Variational rounds: each is one pass that sums responsibilities and
    weighted rows; the driver holds n means and one covariance matrix only.
    """
    rows = written(df.select(key, F.col(features).cast("array<double>").alias("x")))
    total = rows.count()
    if not total:
        return rows.select(key, F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    start = KMeans(k=n, featuresCol="_vector", seed=seed).fit(rows.select(array_to_vector("x").alias("_vector")))
    first, size = np.array(start.clusterCenters()), np.array(start.summary.clusterSizes, dtype=np.float64)
    dim = first.shape[1]

    def moments(batches):
        s, o, c = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            x = np.array(b["x"].tolist()).reshape(-1, dim)
            s, o, c = s + x.sum(axis=0), o + x.T @ x, c + len(x)
        yield pd.DataFrame({"part": [np.r_[s, o.ravel(), c].tolist()]})

    def added(frame: DataFrame) -> np.ndarray:
        out = frame.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        return out["v"].to_numpy()

    m = added(rows.select("x").mapInPandas(moments, "part array<double>"))
    mean, second = m[:dim] / total, m[dim:-1].reshape(dim, dim) / total
    order = np.argsort(-size[: len(first)], kind="stable")
    mu, sticks = first[order], np.maximum(size[order], 0.5) / total
    cov = second - (mu.T * (size[order] / total)) @ mu + 1e-6 * np.eye(dim)

    def density(x: np.ndarray, mu: np.ndarray, inverse: np.ndarray, logs: np.ndarray) -> np.ndarray:
        far = np.einsum("nd,de,ne->n", x, inverse, x)[:, None] - 2 * x @ inverse @ mu.T + np.einsum("kd,de,ke->k", mu, inverse, mu)[None]
        p = logs[None] - far / 2
        p = np.exp(p - p.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        inverse, logs, at = np.linalg.inv(cov), np.log(np.maximum(sticks, 1e-300)), mu

        def expected(batches, inverse=inverse, logs=logs, at=at):
            n_k, s_k = np.zeros(len(at)), np.zeros(at.shape)
            for b in batches:
                x = np.array(b["x"].tolist()).reshape(-1, dim)
                r = density(x, at, inverse, logs)
                n_k, s_k = n_k + r.sum(axis=0), s_k + r.T @ x
            yield pd.DataFrame({"part": [np.r_[n_k, s_k.ravel()].tolist()]})

        sums = added(rows.select("x").mapInPandas(expected, "part array<double>"))
        n_k, s_k = sums[: len(mu)], sums[len(mu) :].reshape(mu.shape)
        new = (s_k + mean) / (n_k + 1)[:, None]
        cov = second - (new.T * (n_k / total)) @ new + 1e-6 * np.eye(dim)
        cov = (cov + cov.T) / 2
        w, v = np.linalg.eigh(cov)
        cov = (v * np.maximum(w, 1e-6)) @ v.T
        after = np.cumsum(n_k[::-1])[::-1] - n_k
        share = (1 + n_k) / (1 + n_k + concentration + after)
        sticks = share * np.r_[1, np.cumprod(1 - share)[:-1]]
        sticks /= sticks.sum()
        moved = np.abs(new - mu).max()
        mu = new
        if moved < 1e-4:
            break
    inverse, logs, at = np.linalg.inv(cov), np.log(np.maximum(sticks, 1e-300)), mu

    def assigned(batches):
        for b in batches:
            r = density(np.array(b["x"].tolist()).reshape(-1, dim), at, inverse, logs)
            yield pd.DataFrame({key: b[key], "cluster": r.argmax(axis=1).astype(np.int64), "probability": r.max(axis=1)})

    return rows.mapInPandas(assigned, f"{key} {rows.schema[key].dataType.simpleString()}, cluster long, probability double")


def linkage_clusters(x: np.ndarray, threshold: float) -> np.ndarray:
    """Clusters (from 1, in order of their first row) of complete linkage cut at a distance, by chains of nearest neighbours."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2) if n <= 512 else (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    alive, parent, chain = np.ones(n, dtype=bool), np.arange(n), []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        if d[a, b] <= threshold:  # merges above the cut don't join clusters
            parent[b] = a
        far = np.maximum(d[a], d[b])
        d[a], d[:, a] = far, far
        d[a, a] = np.inf
        alive[b] = False
    root = parent.copy()
    for i in range(n):
        j = i
        while root[j] != j:
            j = root[j]
        root[i] = j
    _, first, label = np.unique(root, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label] + 1


def close_links(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the threshold that join all rows which such pairs join: fewer pairs than rows."""
    n = len(x)
    size = (x**2).sum(axis=1)
    slack = 1e-9 * (1.0 + 2 * size.max(initial=0.0) + threshold**2)  # of rounding; a pair too many joins parts, which does no harm
    near = np.empty((n, n), dtype=bool)
    for at in range(0, n, 512):
        near[at : at + 512] = size[at : at + 512, None] + size[None] - 2 * x[at : at + 512] @ x.T <= threshold**2 + slack
    open_, a, b = np.ones(n, dtype=bool), [], []
    for first in range(n):
        if not open_[first]:
            continue
        open_[first], stack = False, [first]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(near[i] & open_)
            open_[new] = False
            a += [i] * len(new)
            b += new.tolist()
            stack += new.tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def close_pairs(x: np.ndarray, other: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of other within the threshold, and their distances."""
    own, size, a, b, far = (x**2).sum(axis=1), (other**2).sum(axis=1), [], [], []
    for at in range(0, len(x), 512):
        d = np.sqrt(np.maximum(own[at : at + 512, None] + size[None] - 2 * x[at : at + 512] @ other.T, 0))
        i, j = np.nonzero(d <= threshold)
        a, b, far = [*a, i + at], [*b, j], [*far, d[i, j]]
    return np.concatenate(a), np.concatenate(b), np.concatenate(far)


def _pairs_within(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b and d of all pairs of rows of a part within the threshold, in both directions; from (_part, _row, _x, _size: the part's rows)."""
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("_row"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("_part", "_row", "_x", "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_row")
        lo, own, row = table["_lo"][0].as_py(), table["_own"].to_numpy(), table["_row"].to_numpy()
        x = _matrix(table["_x"].combine_chunks())
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == table["_hi"][0].as_py())
        if not len(left) or not len(right):
            return kinds.empty_table()
        a, b, d = close_pairs(x[left], x[right], threshold)
        a, b = row[left[a]], row[right[b]]
        good = (a < b) | (table["_hi"][0].as_py() != lo)
        a, b, d = a[good], b[good], d[good]
        return pa.table([np.r_[a, b], np.r_[b, a], np.r_[d, d]], schema=kinds)

    return dealt.groupBy("_part", "_lo", "_hi").applyInArrow(pairs, "a long, b long, d double")


def linked_by_rounds(rows: DataFrame, threshold: float) -> DataFrame:
    """_row and _head (a row of its cluster) of complete linkage within each part of any size; from (_part, _row, _x, _size).

    Only clusters all of whose rows lie within the threshold of each other can merge, so a table of such pairs
    of clusters is enough. In a round all clusters that are each other's nearest merge, which gives the clusters of
    merging one pair after the other, since no merge brings clusters closer; a pair stays if all
    its parts' pairs are there, at the largest of their distances. Equal distances go by the rows.
    """
    edges, heads = written(_pairs_within(rows, threshold)), written(rows.select("_row", F.col("_row").alias("_head")))
    while True:
        order = F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        near = edges.groupBy("a").agg(F.min(order).alias("e")).select("a", "e.lo", "e.hi")
        merged = written(near.groupBy("lo", "hi").agg(F.count("*").alias("n")).filter("n = 2").select("lo", "hi"))  # chosen from both ends
        if merged.isEmpty():
            discard(edges, merged)
            return heads
        new = merged.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"))
        two = merged.select("lo", F.lit(2).alias("_two"))
        last = edges, heads
        heads = written(heads.join(new, F.col("_head") == F.col("_from"), "left").select("_row", F.coalesce("_to", "_head").alias("_head")))
        for c in ("a", "b"):
            edges = edges.join(new, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
        sums = edges.filter("a <> b").groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"))
        for c in ("a", "b"):
            sums = sums.join(two.withColumnRenamed("lo", "_lo"), F.col(c) == F.col("_lo"), "left").withColumn(f"_{c}", F.coalesce("_two", F.lit(1))).drop("_lo", "_two")
        edges = written(sums.filter("n = _a * _b").select("a", "b", "d"))
        discard(*last, merged)


def _linked_parts(rows: DataFrame, by: list[str], key: str, threshold: float, linked: int, refuse: bool = False) -> DataFrame:
    """Complete linkage of groups of any size, given as (group, key, _x, _row, _n: the group's rows), by components of the pairs within the threshold.

    No merge below the cut leaves a component. Blocks of a group meet each other, so that every pair is looked at.
    Components of more than linked rows are clustered by rounds over all tasks, or refused.
    """
    kind = {c: rows.schema[c].dataType.simpleString() for c in [*by, key]}
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("_row"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(*by, "_row", "_x", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = close_links(np.array(frame["_x"].tolist(), dtype=np.float64), threshold)
        row = frame["_row"].to_numpy()
        return pd.DataFrame({"a": row[a], "b": row[b]})

    found = components(written(dealt.groupBy(*by, "_lo", "_hi").applyInPandas(links, "a long, b long")))
    placed = written(rows.join(found, F.col("_row") == F.col("node"), "left").withColumn("_part", F.coalesce("component", "_row")).select(*by, key, "_x", "_row", "_part"))
    over = written(placed.groupBy("_part").agg(F.count("*").alias("_size")).filter(F.col("_size") > linked))
    large = None
    if not refuse and not over.isEmpty():
        first = linked_by_rounds(placed.join(F.broadcast(over), "_part").select("_part", "_row", "_x", "_size"), threshold)
        large = placed.select(*by, key, "_row").join(first, "_row")
        head = F.min_by("_row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_row"))  # the first row of a cluster is its head
        large = large.join(large.groupBy("_head").agg(head.alias("_least")), "_head").select(*by, key, "_row", F.col("_least").alias("_head"))
        placed = placed.join(F.broadcast(over.select("_part")), "_part", "left_anti")
    bins = max(1, -(-rows.count() // BLOCK))
    placed = placed.select(*by, key, "_x", "_row", "_part", F.pmod(F.xxhash64("_part"), F.lit(bins)).alias("_bin"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = np.empty(len(frame), dtype=np.int64)
        frame = frame.sort_values([key, "_row"]).reset_index(drop=True)
        for own in frame.groupby("_part").indices.values():
            if len(own) > linked:
                raise ValueError(f"{len(own)} rows joined by pairs within the threshold are over the limit of {linked} of complete linkage")
            label = linkage_clusters(np.array(frame["_x"].iloc[own].tolist(), dtype=np.float64), threshold)
            _, first = np.unique(label, return_index=True)
            head[own] = frame["_row"].to_numpy()[own[first[label - 1]]]
        frame["_head"] = head
        return frame[[*by, key, "_row", "_head"]]

    clusters = placed.groupBy("_bin").applyInPandas(run, ", ".join(f"`{c}` {kind[c]}" for c in [*by, key]) + ", _row long, _head long")
    clusters = written(clusters if large is None else clusters.unionByName(large))
    # clusters are numbered in order of their first rows: places in a sorted table, counted from the group's first
    heads = clusters.filter("_row = _head").orderBy(*by, F.col(key).asc_nulls_last(), "_row").select(*by, F.col("_head").alias("_first"), F.monotonically_increasing_id().alias("_at"))
    heads = written(heads).withColumn("_slice", F.shiftright("_at", 33))
    before = F.sum("n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = heads.groupBy("_slice").agg(F.count("*").alias("n")).select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    heads = written(heads.join(F.broadcast(slices), "_slice").withColumn("_place", F.col("_at") - F.shiftleft("_slice", 33) + F.col("_before")))
    least = heads.groupBy(*by).agg(F.min("_place").alias("_least"))
    same = F.lit(True)
    for c in by:
        least = least.withColumnRenamed(c, f"_g_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    named = heads.join(F.broadcast(least), same).select("_first", (F.col("_place") - F.col("_least") + 1).alias("cluster"))
    return clusters.join(named, F.col("_head") == F.col("_first")).select(*by, key, "cluster")


def _by_bins(rows: DataFrame, group: str | None, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What run makes of each group, or of all rows without one; groups are dealt to bins, since many of them have a row or two and handing over each alone takes longer than clustering it."""
    if group is None or rows.schema[group].dataType.typeName() in ("float", "double"):  # whose hash tells zeros apart
        return rows.groupBy(*[group] * bool(group)).applyInPandas(run, schema)
    bins = max(1, -(-rows.count() // BIN))
    by, none = F.pmod(F.xxhash64(group), F.lit(bins)).alias("_bin"), F.col(group).isNull().alias("_none")

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        code, _ = pd.factorize(frame[group], use_na_sentinel=False)
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code))
        return pd.concat([run(frame.iloc[order[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], ignore_index=True)

    return rows.groupBy(by, none).applyInPandas(each, schema)


def complete_linkage(df: DataFrame, threshold: float, key: str = "scaffold", features: str = "features", group: str | None = None, limit: int | None = None, linked: int | None = None, at_once: int | None = None) -> DataFrame:
    """key, the group if there is one, and cluster (from 1): clusters whose rows all lie within the threshold of each other.

    A group of up to at_once rows (LINKED) is clustered as a whole, a larger one by components of its
    pairs within the threshold, and a component of more rows by rounds of merges over all tasks, which
    gives the same clusters. With linked, which then stands for at_once, such a component raises
    instead. With a limit, groups are always clustered as a whole, and one of more rows raises.
    """
    refuse, linked = linked is not None, linked or at_once or LINKED
    by = [group] if group else []
    rows = df.select(*by, key, F.col(features).cast("array<double>").alias("_x"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if limit is not None and len(frame) > limit:
            raise ValueError(f"a group of {len(frame)} rows is over the limit of {limit} of complete linkage")
        frame = frame.sort_values(key).reset_index(drop=True)
        frame["cluster"] = linkage_clusters(np.array(frame["_x"].tolist(), dtype=np.float64), threshold) if len(frame) > 1 else 1
        return frame[[*by, key, "cluster"]]

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, key]) + ", cluster long"
    if limit is not None:
        return rows.groupBy(*by).applyInPandas(run, schema)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    sizes = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.count("*").alias("_n"))
    large = written(sizes.filter(F.col("_n") > linked))
    if large.isEmpty():
        return _by_bins(rows.drop("_row"), group, key, run, schema)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    parts = _linked_parts(written(rows.join(F.broadcast(large), same).select(*by, key, "_x", "_row", "_n")), by, key, threshold, linked, refuse)
    if not by:
        return parts
    return _by_bins(rows.join(F.broadcast(large), same, "left_anti").drop("_row"), group, key, run, schema).unionByName(parts)
