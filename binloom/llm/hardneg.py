"""Hard negatives by bit-sliced integer products.

Components become integers, floor(SCALE * x). Blocks of rows are stored in slices: a plane
of bits for each binary digit of the components, in two's complement, 64 components to a
word. An anchor's product with a block is built plane by plane, the most significant first.
What the planes still to come can add is bounded by the sums of the anchor's negative and
positive components, so every product has an interval that narrows with each plane; a row
is dropped as soon as its interval can't reach the least score that still counts, or lies
above the greatest. While many rows are left a plane is one matrix product of the block;
then the pairs that are left go on by counts of common bits with the anchor's own planes.
Scores are whole numbers and exact, up to 64 bits; beyond these they count as the largest or least.

First each anchor's best rows of its label are found, its positives; then, for each
positive, the best rows of other labels between two shares of the positive's score. Anchors
and rows meet in blocks, packed where they are read; only blocks and the best rows of each
block are shuffled, never by label. The work is anchors times rows.

Rows with a null id, label, vector or component, a component that isn't finite, or one of
2**52 or more in size take no part; neither do empty vectors. Vectors of different lengths
are never compared. A row is no positive of an anchor that has its id. Repeated rows are
candidates each; anchors that are equal in id, label and vector count once, others of one
id are anchors each. An empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.session import written

#: Anchors of a part, rows of a block and of a chunk of blocks, all about; rows looked at together; share of pairs left below which they go on one by one.
ANCHORS, BLOCK, CHUNK, SLICE, FEW = 4096, 4096, 16_384, 1024, 1 / 8
NONE = -(1 << 62)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float(1 << 52)), F.lit(False))), F.lit(False))


def sliced(values: np.ndarray) -> np.ndarray:
    """(planes, rows, words): the bits of each digit, the last plane that of the sign."""
    n, dim = values.shape
    depth = max(1, *(int(v).bit_length() + 1 for v in (values.min(initial=0), values.max(initial=0))))
    out = np.zeros((depth, n, 8 * -(-dim // 64)), dtype=np.uint8)
    for k in range(depth):
        bits = np.packbits((values >> k & 1).astype(np.uint8), axis=1, bitorder="little")
        out[k, :, : bits.shape[1]] = bits
    return out.view("<u8")


def unpacked(plane: np.ndarray, dim: int, kind: type) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")[:, :dim].astype(kind)


def exact(depth: int, values: np.ndarray) -> type:
    """The cheapest numbers in which no sum on the way is rounded."""
    most = int(np.abs(values).sum(axis=1, dtype=object).max()) << (depth + 1) if len(values) else 0
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def qualified(values: np.ndarray, own: np.ndarray, planes: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and product of the allowed pairs whose product lies from least to most of the anchor."""
    depth, dim = len(planes), values.shape[1]
    kind = exact(depth, values)
    a, plus, minus = values.astype(kind), np.maximum(values, 0).sum(axis=1).astype(kind), np.minimum(values, 0).sum(axis=1).astype(kind)
    least, most = least.astype(kind), most.astype(kind)
    alive, so_far = allowed.copy(), np.zeros(allowed.shape, dtype=kind)
    for k in range(depth - 1, -1, -1):
        so_far += (a * (-(1 << k) if k == depth - 1 else 1 << k)) @ unpacked(planes[k], dim, kind).T
        rest = (1 << k) - 1  # what the planes below k can add is between these sums times rest
        alive &= so_far >= (least - rest * plus)[:, None]
        alive &= so_far <= (most - rest * minus)[:, None]
        left = np.count_nonzero(alive)
        if not left or kind is not object and left <= FEW * alive.size:
            break
    i, j = np.nonzero(alive)
    score = so_far[i, j] if kind is object else so_far[i, j].astype(np.int64)
    for k in range(k - 1, -1, -1):
        if not len(i):
            break
        common = np.zeros(len(i), dtype=np.int64)
        for b in range(len(own)):
            count = np.bitwise_count(planes[k][j] & own[b][i]).sum(axis=1, dtype=np.int64)
            common += count * (-(1 << b) if b == len(own) - 1 else 1 << b)
        score += common * (-(1 << k) if k == depth - 1 else 1 << k)
        rest = (1 << k) - 1
        keep = (score + rest * plus[i] >= least[i]) & (score + rest * minus[i] <= most[i])
        i, j, score = i[keep], j[keep], score[keep]
    return i, j, np.clip(score, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def best(slot: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most best rows of each slot: greatest scores, then least ids."""
    order = np.lexsort((ids, ~score, slot))
    slot, ids, score = slot[order], ids[order], score[order]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < most
    return slot[keep], ids[keep], score[keep]


def packed(rows: DataFrame, chunks: int) -> DataFrame:
    """Blocks of rows (id, label, vector) in slices, without a shuffle: each task packs what it reads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        task, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            planes = sliced(x)
            made += 1
            row = [(task * 7919 + made) % chunks, dim, len(planes), ids.tobytes(), labels.tobytes(), planes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, BLOCKS.types, strict=True)], schema=BLOCKS)

        for batch in batches:
            ids, labels, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "dim"))
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                x = integers(batch.column("vector").take(pa.array(of)), dim)
                held.setdefault(dim, []).append((ids[of], labels[of], x))
                if sum(len(h[0]) for h in held[dim]) >= BLOCK:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "chunk int, dim int, depth int, ids binary, labels binary, planes binary")


BLOCKS = pa.schema([("chunk", pa.int32()), ("dim", pa.int32()), ("depth", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "planes"))])


def integers(vectors: pa.Array, dim: int, scale: int = 256) -> np.ndarray:
    return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, dim)


def grouped(anchors: DataFrame, parts: int, extra: list[str]) -> DataFrame:
    """Anchors (id, key, label, vector and lists of numbers of one length) packed by parts."""

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        x = integers(table["vector"].combine_chunks(), dim)
        columns = [table[c].to_numpy().tobytes() for c in ("id", "key", "label")] + [x.tobytes()] + [table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in extra]
        return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([dim], pa.int32())] + [pa.array([c], pa.binary()) for c in columns], names=["part", "dim", "id", "key", "label", "x", *extra])

    kinds = ", ".join(f"{c} binary" for c in ["id", "key", "label", "x", *extra])
    dealt = anchors.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    return dealt.repartition(parts, "part", "dim").groupBy("part", "dim").applyInArrow(run, f"part int, dim int, {kinds}")


def met(anchors: DataFrame, blocks: DataFrame, parts: int, chunks: int, find: Callable, schema: str) -> DataFrame:
    """find(anchors' columns, blocks) for each part of the anchors and chunk of the blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in schema.split(",")]
        none = pa.table([pa.array([], pa.int64())] * len(names), names=names)
        if not left.num_rows or not right.num_rows:
            return none
        one = {c: np.frombuffer(left[c][0].as_py(), dtype=np.int64) for c in left.column_names if c not in ("part", "dim", "chunk")}
        dim = left["dim"][0].as_py()
        one["x"] = one["x"].reshape(-1, dim)

        def slices() -> Iterator[tuple[np.ndarray, ...]]:
            for r in range(right.num_rows):
                ids, labels = (np.frombuffer(right[c][r].as_py(), dtype=np.int64) for c in ("ids", "labels"))
                planes = np.frombuffer(right["planes"][r].as_py(), dtype="<u8").reshape(right["depth"][r].as_py(), len(ids), -1)
                at = 0
                while at < len(ids):  # the first few tell what the others have to reach
                    to = at + (SLICE if at else SLICE // 4)
                    yield ids[at:to], labels[at:to], planes[:, at:to]
                    at = to

        found = find(one, sliced(one["x"]), slices())
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    pairs = max(1, min(4 * parts * chunks, 50_000))
    left = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(pairs, "part", "chunk", "dim")
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(pairs, "part", "chunk", "dim")
    return left.groupBy("part", "chunk", "dim").cogroup(right.groupBy("part", "chunk", "dim")).applyInArrow(run, schema)


def positives(one: dict[str, np.ndarray], own: np.ndarray, slices: Iterator, most: int) -> list[np.ndarray]:
    n = len(one["id"])
    slot, ids, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    least, top = np.full(n, NONE), np.full(n, -NONE)
    for c_ids, c_labels, planes in slices:
        allowed = (one["label"][:, None] == c_labels) & (one["id"][:, None] != c_ids)
        i, j, s = qualified(one["x"], own, planes, allowed, least, top)
        slot, ids, score = best(np.concatenate([slot, i]), np.concatenate([ids, c_ids[j]]), np.concatenate([score, s]), most)
        full = np.flatnonzero(np.bincount(slot, minlength=n) == most)
        least[full] = score[np.searchsorted(slot, full, "right") - 1]
    return [one["id"][slot], one["key"][slot], ids, score]


def negatives(one: dict[str, np.ndarray], own: np.ndarray, slices: Iterator, most: int, low: int, high: int) -> list[np.ndarray]:
    n = len(one["id"])
    p_id, p_score = one["p_id"].reshape(n, -1), one["p_score"].reshape(n, -1)
    places = p_id.shape[1]
    real = p_score != NONE
    wide = p_score.astype(object)  # a hundred scores may be too much for 64 bits
    floor, cap = (-(-low * wide // 100)).astype(np.int64), (high * wide // 100).astype(np.int64)  # whole scores from floor to cap qualify
    real &= floor <= cap
    need = np.where(real, floor, -NONE)
    slot, ids, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    for c_ids, c_labels, planes in slices:
        allowed = one["label"][:, None] != c_labels
        i, j, s = qualified(one["x"], own, planes, allowed, need.min(axis=1, initial=-NONE), np.where(real, cap, NONE).max(axis=1, initial=NONE))
        for p in range(places):
            fits = (s >= need[i, p]) & (s <= cap[i, p]) & real[i, p]
            slot, ids, score = np.concatenate([slot, i[fits] * places + p]), np.concatenate([ids, c_ids[j[fits]]]), np.concatenate([score, s[fits]])
        slot, ids, score = best(slot, ids, score, most)
        full = np.flatnonzero(np.bincount(slot, minlength=n * places) == most)
        need.ravel()[full] = score[np.searchsorted(slot, full, "right") - 1]
    a, p = slot // places, slot % places
    return [one["id"][a], one["key"][a], p, p_id[a, p], p_score[a, p], ids, score]


def mine(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, owner: str = "query",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each row that anchors selects and each of its n_positives best rows of its label, the
    n_negatives best rows of other labels whose score is from low to high hundredths of the
    positive's. Labels are whole numbers.
    """
    good = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    named = [F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")]
    rows = good.select(*named).withColumn("dim", F.size("vector"))
    asked = good.filter(anchors).select(*named).withColumn("dim", F.size("vector")).withColumn("key", F.xxhash64("id", "label", "vector")).dropDuplicates(["id", "key"])
    asked = written(asked, owner)
    parts, chunks = max(1, -(-asked.count() // ANCHORS)), max(1, -(-rows.count() // CHUNK))
    blocks = written(packed(rows, chunks), owner)
    found = met(grouped(asked, parts, []), blocks, parts, chunks, lambda *a: positives(*a, n_positives), "anchor_id long, key long, positive_id long, positive_score long")
    of_anchor = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(of_anchor)).filter(F.col("place") <= n_positives)
    lists = first.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    filled = lambda c: F.transform(F.sequence(F.lit(1), F.lit(n_positives)), lambda k: F.coalesce(F.try_element_at("p", k)[c], F.lit(NONE)))
    with_positives = asked.join(lists.withColumnRenamed("anchor_id", "id"), ["id", "key"]).withColumns({"p_id": filled("positive_id"), "p_score": filled("positive_score")}).drop("p")
    got = met(
        grouped(with_positives, parts, ["p_id", "p_score"]), blocks, parts, chunks, lambda *a: negatives(*a, n_negatives, low, high),
        "anchor_id long, key long, place long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    of_positive = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    return got.withColumn("rank", F.row_number().over(of_positive)).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in SQL, with all products of anchors and rows at once.
ORACLE = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
 where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 a as (select * from v where vec_id % 100 = 0),
 s as (select a.vec_id anchor_id, v.vec_id, a.label = v.label as same, cast(list_inner_product(a.e, v.e) as bigint) score from a, v where a.vec_id <> v.vec_id),
 p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
 select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as int) rank, vec_id negative_id, positive_score, score negative_score
 from p join s on s.anchor_id = p.anchor_id where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
 qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 10"""
