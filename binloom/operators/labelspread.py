"""Label spreading on the graph of nearest neighbours.

With S = D^-1/2 W D^-1/2 over the symmetrised graph, F moves to alpha S F + (1 - alpha) Y
until it changes by less than a tolerance or a number of rounds is over (Zhou et al. 2004);
the change is looked at every LOOK rounds.
F is a table (node, label, weight) of non-zero weights; a round is one join and one sum.

Labels don't meet on the way: F moves for each by itself. Where there are many, F has almost
all nodes for each of them, and its joins are what takes the time; so as long as the graph may be sent to
several tasks, as the small side of a join may, labels are dealt to shares, and a task
moves their columns, a block at a time, through all rounds. Larger graphs are joined round by round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.operators.neighbours import nearest
from binloom.schema import NO_INDEX
from binloom.session import discard, written

NEIGHBOURS, ROUNDS, TOLERANCE, LOOK = 7, 30, 1e-3, 5
#: Edges up to which a graph is sent to the shares of labels (some 100 MB in a task); weights that a block holds; labels of a block at most; weights moved at once.
SENT_EDGES, CELLS, WIDE, MOVED = 1 << 20, 1 << 23, 64, 1 << 14
#: Shares of labels for each core, about; blocks of a share at most; edges from which a node is moved by itself.
SHARES, BLOCKS, HUB = 3, 64, 64


def graph(neighbours: DataFrame) -> DataFrame:
    """src, dst, w of the normalised symmetric graph, without loops; an edge in both directions weighs double."""
    directed = neighbours.filter("src <> dst").select("src", "dst")
    edges = directed.unionByName(directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg((F.count("*") / 2).alias("w"))
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    return edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def seeds(labels: DataFrame, key: str, label: str) -> DataFrame:
    """node, label, weight of the rows with a label; NULL and NO_INDEX are none."""
    known = labels.filter(F.col(label).isNotNull() & (F.col(label).cast("string") != F.lit(str(NO_INDEX))))
    return known.select(F.col(key).alias("node"), F.col(label).alias("label"), F.lit(1.0).alias("weight"))


def step(edges: DataFrame, weights: DataFrame, start: DataFrame, alpha: float) -> DataFrame:
    """One round."""
    moved = edges.join(weights, edges["src"] == weights["node"]).groupBy(F.col("dst").alias("node"), "label").agg(F.sum(F.col("w") * F.col("weight")).alias("weight"))
    both = moved.select("node", "label", (F.col("weight") * alpha).alias("weight")).unionByName(start.select("node", "label", (F.col("weight") * (1 - alpha)).alias("weight")))
    return both.groupBy("node", "label").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, start: DataFrame, alpha: float = 1.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """node, label, weight after the last round, weights of a node divided by their sum."""
    edges, start = written(edges), written(start)
    weights = start
    for k in range(1, rounds + 1):
        last, new = weights, written(step(edges, weights, start, alpha).filter("weight > 0"))
        weights = new
        if k % LOOK:
            if last is not start:
                discard(last)
            continue
        old = last.select("node", "label", F.col("weight").alias("before"))
        change = new.join(old, ["node", "label"], "full").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0]
        if last is not start:
            discard(last)
        if (change or 0.0) < tolerance:
            break
    discard(edges)
    total = weights.groupBy("node").agg(F.sum("weight").alias("_sum"))
    return weights.join(total, "node").select("node", "label", F.try_divide("weight", "_sum").alias("weight"))


class Graph:
    """Edges (source, end, weight) by their ends, nodes numbered from the one with most edges, so that the n-th edges of neighbouring nodes are moved by a few calls for whole rows of weights."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, nodes: int, width: int) -> None:
        degree = np.bincount(dst, minlength=nodes)
        self.order = np.argsort(-degree, kind="stable")  # of old numbers
        self.place = np.empty(nodes, dtype=np.int64)
        self.place[self.order] = np.arange(nodes)
        src, dst, degree = self.place[src], self.place[dst], degree[self.order]
        by = np.lexsort((self.order[src], dst))
        src, w, first = src[by], w[by], np.r_[0, np.cumsum(degree)]
        rows = max(1, MOVED // width)
        hubs = int(np.searchsorted(-degree, -HUB, "left"))
        cut = [slice(k, min(k + rows, first[i + 1])) for i in range(hubs) for k in range(first[i], first[i + 1], rows)]
        self.hubs = [(int(np.searchsorted(first, x.start, "right")) - 1, src[x], w[x, None]) for x in cut]
        self.parts, self.room = [], np.empty((rows, width))
        for at in range(hubs, nodes, rows):
            own, slots = degree[at : at + rows], []
            for j in range(own[0]):
                edges = first[at : at + int(np.searchsorted(-own, -j, "left"))] + j
                slots.append((src[edges], w[edges, None]))
            self.parts.append((at, at + len(own), slots))

    def move(self, f: np.ndarray, out: np.ndarray, alpha: float) -> None:
        """Into out, alpha times the sums of the weights f that each node's edges bring, a row a node."""
        out[: self.parts[0][0] if self.parts else len(out)] = 0
        for i, src, w in self.hubs:
            out[i] += alpha * (f[src] * w).sum(axis=0)
        for at, to, slots in self.parts:
            own = out[at:to]
            own[len(slots[0][0]) if slots else 0 :] = 0
            for j, (src, w) in enumerate(slots):
                x = self.room[: len(src), : f.shape[1]] if j else own[: len(src)]
                np.take(f, src, axis=0, out=x, mode="clip")
                x *= w
                if j:
                    own[: len(src)] += x
            own *= alpha


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys that Spark's hash deals to n partitions, one to each, where numbers in a row would meet in some and leave others empty."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    return [r.key for r in spark.range(64 * n).groupBy(at.alias("at")).agg(F.min("id").cast("int").alias("key")).orderBy("at").collect()]


def best_of_blocks(edges: DataFrame, start: DataFrame, labels: int, nodes: int, alpha: float, rounds: int, tolerance: float) -> DataFrame:
    """node, label, weight and total of the best label in each share of labels: spread() for graphs that may be sent to several tasks.

    A share is some blocks of labels, one after the other in one task, so that the graph is not sent to each block.
    """
    kinds = {f.name: f.dataType.simpleString() for f in start.schema.fields}
    width = max(1, min(WIDE, CELLS // max(1, nodes)))
    blocks = max(1, -(-labels // width))
    shares = min(blocks, max(SHARES * edges.sparkSession.sparkContext.defaultParallelism, -(-blocks // BLOCKS)))
    names = F.array(*map(F.lit, partition_keys(edges.sparkSession, shares)))
    dealt = start.withColumn("share", names[F.pmod(F.xxhash64("label"), F.lit(shares)).cast("int")]).repartition(shares, "share")
    sent = edges.withColumn("share", F.explode(names)).repartition(shares, "share")
    schema = f"kind int, k int, node {kinds['node']}, label {kinds['label']}, weight double, total double"

    def sharewise(last: int) -> DataFrame:
        def run(graph: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
            if not len(seeds):
                return pd.DataFrame({c: [] for c in ("kind", "k", "node", "label", "weight", "total")})
            names, at = np.unique(np.r_[graph["src"].to_numpy(), graph["dst"].to_numpy(), seeds["node"].to_numpy()], return_inverse=True)
            src, dst, own = np.split(at, [len(graph), 2 * len(graph)])
            found, column = np.unique(seeds["label"].to_numpy(), return_inverse=True)
            own_graph = Graph(src, dst, graph["w"].to_numpy(), len(names), width)
            cells, cell = np.unique(column * len(names) + own_graph.place[own], return_inverse=True)  # by label
            column, row, weight = cells // len(names), cells % len(names), np.bincount(cell, weights=seeds["weight"].to_numpy())
            best, top, total, change = np.zeros(len(names), dtype=np.int64), np.zeros(len(names)), np.zeros(len(names)), np.zeros(last + 1)
            step = -(-len(found) // -(-len(found) // width))  # blocks of one size, about
            for of in range(0, len(found), step):
                some = slice(*np.searchsorted(column, [of, of + step]).tolist())
                at, seed = (row[some], column[some] - of), weight[some]
                f = np.zeros((len(names), min(step, len(found) - of)))
                f[at] = seed
                new = np.empty_like(f)
                for k in range(1, last + 1):
                    own_graph.move(f, new, alpha)
                    new[at] += (1 - alpha) * seed
                    if k % LOOK == 0:
                        change[k] += sum(np.abs(new[i : i + MOVED] - f[i : i + MOVED]).sum() for i in range(0, len(f), MOVED))
                    f, new = new, f
                most = f.argmax(axis=1)
                weights = f[np.arange(len(f)), most]
                total += f.sum(axis=1)
                over = weights > top  # equal ones go by the label
                best[over], top[over] = most[over] + of, weights[over]
            good = np.flatnonzero(top > 0)
            looks = np.arange(LOOK, last + 1, LOOK)
            rows = pd.DataFrame({"kind": 0, "k": 0, "node": names[own_graph.order[good]], "label": found[best[good]], "weight": top[good], "total": total[good]})
            looks = pd.DataFrame({"kind": 1, "k": looks, "node": names[:1].repeat(len(looks)), "label": found[:1].repeat(len(looks)), "weight": change[looks], "total": 0.0})
            return pd.concat([rows, looks], ignore_index=True)

        return written(sent.groupBy("share").cogroup(dealt.groupBy("share")).applyInPandas(run, schema))

    out = sharewise(rounds)
    seen = {r.k: r.change for r in out.filter("kind = 1").groupBy("k").agg(F.sum("weight").alias("change")).collect()}  # a row every LOOK rounds
    last = next((k for k in sorted(seen) if seen[k] < tolerance), rounds)
    if last < rounds:
        discard(out)
        out = sharewise(last)
    return out.filter("kind = 0").drop("kind", "k")


def best_labels(edges: DataFrame, start: DataFrame, nodes: DataFrame, key: str, default: object, alpha: float = 1.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE, sent: int | None = None) -> DataFrame:
    """labelled(spread()): by blocks of labels, if there are no more than sent edges (SENT_EDGES)."""
    edges, start = written(edges), written(start)
    count, many, labels = edges.count(), edges.select("src").distinct().count(), start.select("label").distinct().count()
    if count > (SENT_EDGES if sent is None else sent) or not labels:
        return labelled(spread(edges, start, alpha, rounds, tolerance), nodes, key, default)
    parts = best_of_blocks(edges, start, labels, many, alpha, rounds, tolerance)
    best = parts.groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("minus"), "label")).alias("b"), F.sum("total").alias("all"))
    best = best.select("node", F.col("b.label").alias("label"), F.try_divide(-F.col("b.minus"), F.col("all")).alias("weight"))
    return labelled(best, nodes, key, default)


def labelled(weights: DataFrame, nodes: DataFrame, key: str, default: object) -> DataFrame:
    """key, label and probability (the largest weight) of each node; those that no label reaches have the default at 0."""
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "label")
    best = weights.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1 and weight > 0")
    rows = nodes.select(key).join(best, F.col(key) == F.col("node"), "left")
    return rows.select(key, F.coalesce("label", F.lit(default)).alias("label"), F.coalesce("weight", F.lit(0.0)).alias("probability"))


def propagate(features: DataFrame, labels: DataFrame, key: str = "scaffold", vector: str = "features", label: str = "label", alpha: float = 1.0, default: object = NO_INDEX, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """key, label and probability of each row of features, from the labels that some have."""
    edges = graph(nearest(features, key, vector, neighbours))
    return best_labels(edges, seeds(labels, key, label), features, key, default, alpha, rounds)
