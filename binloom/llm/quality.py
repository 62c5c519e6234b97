"""Quality classifier on random-indexing word vectors.

Tokens are runs of letters, digits or symbols, as written. Each has a sparse index vector,
SIGNS entries of +1 or -1 drawn from its hash; a token's word vector is the sum of the
index vectors of the tokens up to WINDOW places away, over the whole corpus. The OWN most
frequent tokens of the corpus have a word vector each, told by their hash; the others
share BUCKETS vectors by hash, so that the table can be sent to all tasks at any input. A
document's features are the mean and spread of its tokens' unit vectors and how alike
neighbours are; a two-layer network with a calibrated temperature scores them.

Word vectors come from all documents, the network from a sample of at most BOUND labelled
ones. Null and empty texts have zero features and a score like any other text. Rows are
scored one by one, equal texts alike; an empty table gives no rows; of several labels of
an id the largest counts; a column named as the score is replaced, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import learning, textbytes
from binloom.session import discard, written

OWN, BUCKETS, DIMENSIONS, SIGNS, WINDOW, BOUND = 1 << 15, 8192, 32, 2, 2, 20_000
#: Distinct tokens that a task holds before it hands on their counts.
HELD = 1 << 20
FEATURES = 2 * DIMENSIONS + 3
#: Text bytes pooled at once: a vector stands for each token.
POOLED_BYTES = 1 << 20

KIND = np.full(256, 3, dtype=np.uint8)  # symbols
KIND[np.flatnonzero(textbytes.SPACE)] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each token."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    kind = KIND[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    edge[n] = True
    cuts = np.flatnonzero(edge)
    solid = kind[cuts[:-1]] > 0
    starts, ends = cuts[:-1][solid], cuts[1:][solid]
    return textbytes.word_hash(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def own_tokens(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of the most frequent tokens: as many whole ranges of counts, 64 to a doubling, as keep to OWN tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            h, back = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(back, weights=n, minlength=len(h)).astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            for _, data, offsets in textbytes.chunks(batch, text):
                held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
                if sum(len(x[0]) for x in held) > HELD:
                    yield merged()
        if held:
            yield merged()

    counts = docs.select(text).mapInArrow(textbytes.trimmed(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = written(counts.filter("n > 1").withColumn("range", F.floor(F.log2("n") * 64)))
    least, total = None, 0
    for r, words in counts.groupBy("range").count().orderBy(F.desc("range")).collect():  # some thousands at most
        total += words
        if total > OWN:
            break
        least = r
    found = counts.filter(F.col("range") >= least if least is not None else F.lit(False)).select("hash").toArrow()["hash"].to_numpy()
    discard(counts)
    return np.sort(found.view(np.uint64))


def slots(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each token's vector: its own, or one of the shared ones behind them."""
    shared = len(own) + (h % np.uint64(BUCKETS)).astype(np.int64)
    if not len(own):
        return shared
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return np.where(own[at] == h, at, shared)


def word_vectors(docs: DataFrame, text: str, own: np.ndarray) -> np.ndarray:
    """A word vector of length 1 for each place of slots() (0 where no token was)."""
    sent, places = docs.sparkSession.sparkContext.broadcast(own), len(own) + BUCKETS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places * DIMENSIONS)
        for batch in batches:
            for _, data, offsets in textbytes.chunks(batch, text):
                h, doc = tokens(data, offsets)
                slot = slots(sent.value, h) * DIMENSIONS
                drawn = textbytes.mix(h)
                for s in range(SIGNS):
                    place = ((drawn >> np.uint64(16 * s)) % np.uint64(DIMENSIONS)).astype(np.int64)
                    sign = 1.0 - 2.0 * ((drawn >> np.uint64(16 * s + 12)) & np.uint64(1)).astype(np.float64)
                    for away in range(1, WINDOW + 1):
                        near = doc[away:] == doc[:-away]
                        for a, b in ((slice(away, None), slice(None, -away)), (slice(None, -away), slice(away, None))):
                            np.add.at(total, slot[a][near] + place[b][near], sign[b][near])
        rows = total.reshape(places, DIMENSIONS)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))] + [pa.array(rows[used, k].astype(np.float32)) for k in range(DIMENSIONS)], names=["slot", *(f"d{k}" for k in range(DIMENSIONS))])

    schema = T.StructType([T.StructField("slot", T.IntegerType())] + [T.StructField(f"d{k}", T.FloatType()) for k in range(DIMENSIONS)])
    rows = docs.select(text).mapInArrow(textbytes.trimmed(run), schema).groupBy("slot").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIMENSIONS)]).toArrow()
    out = np.zeros((places, DIMENSIONS))
    if rows.num_rows:
        out[rows["slot"].to_numpy()] = np.stack([rows[f"d{k}"].to_numpy() for k in range(DIMENSIONS)], axis=1)
    sent.destroy()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(own: np.ndarray, vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document."""
    h, doc = tokens(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(h):
        return out
    count = np.bincount(doc, minlength=n)
    has = np.flatnonzero(count)
    first = (np.cumsum(count) - count)[has]
    v = vectors[slots(own, h)]
    mean = np.add.reduceat(v, first, axis=0, dtype=np.float64) / count[has, None]
    square = np.add.reduceat(v * v, first, axis=0, dtype=np.float64) / count[has, None]
    alike = np.zeros(len(h))
    alike[1:] = np.where(doc[1:] == doc[:-1], np.einsum("ij,ij->i", v[1:], v[:-1]), 0)
    same = np.zeros(len(h))
    same[2:] = (doc[2:] == doc[:-2]) & ((h[2:] == h[1:-1]) | (h[2:] == h[:-2]))
    out[has, :DIMENSIONS] = mean
    out[has, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean**2, 0))
    out[has, -3] = np.add.reduceat(alike, first) / count[has]
    out[has, -2] = np.add.reduceat(same, first) / count[has]
    out[has, -1] = np.log1p(count[has])
    return out


@dataclass
class Model:
    own: np.ndarray
    vectors: np.ndarray
    network: learning.TwoLayers


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = BOUND) -> Model:
    """The model; labels holds only the rows that may be learned from."""
    own = own_tokens(docs, text)
    vectors = word_vectors(docs, text, own)
    sent = docs.sparkSession.sparkContext.broadcast((own, vectors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text", POOLED_BYTES):
                x = pooled(*sent.value, data, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float32())), part.column("_label"), part.column("_fold")], names=["x", "y", "fold"])

    rows = learning.joined(docs, learning.sample(labels, doc_id, label, bound), doc_id, text).mapInArrow(textbytes.trimmed(run), "x array<float>, y int, fold int").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    y = rows["y"].to_numpy()
    order = np.lexsort((*x.T[:4], y))  # so that the fit doesn't depend on the order in which tasks end
    return Model(own, vectors, learning.TwoLayers(x[order], y[order], rows["fold"].to_numpy()[order]))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """The rows with the score as one more column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() != to.lower()]
    schema = T.StructType([*kept, T.StructField(to, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, text, POOLED_BYTES):
                got = m.network.predict(pooled(m.own, m.vectors, data, offsets)).round(10)  # the same in every batch
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(got)], names=schema.names)

    return docs.mapInArrow(textbytes.trimmed(run), schema)
