"""Counts and spectra of k-mers.

histogram() is the relational form, a row for each k-mer of a sequence. counted() gives
dense vectors in one pass over the text without a shuffle: letters become digits by a
lookup table, a window's digits its rank, and one bincount a batch counts all sequences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.functions.sequences import Kmers, folded, kmer_rank, kmers

#: Cells of the counts that a batch holds at once, and letters, whose codes, ranks and rows take some 40 bytes each.
CELLS, LETTERS = 1 << 22, 1 << 18


def histogram(df: DataFrame, key: str, sequence: str, by: Kmers) -> DataFrame:
    """key, kmer, n: k-mers that occur."""
    return df.select(key, F.explode(kmers(F.col(sequence), by)).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def folded_histogram(df: DataFrame, key: str, sequence: str, by: Kmers) -> DataFrame:
    """The same with each k-mer and its reversal counted as one."""
    return df.select(key, F.explode(kmers(F.col(sequence), by)).alias("kmer")).groupBy(key, folded(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def frequencies(counts: DataFrame, key: str) -> DataFrame:
    """Counts of a histogram divided by the sequence's total, as column freq."""
    total = counts.groupBy(key).agg(F.sum("n").alias("_total"))
    return counts.join(total, key).withColumn("freq", F.try_divide("n", "_total")).drop("_total")


def _letters_at_once(data: np.ndarray, offsets: np.ndarray, by: Kmers) -> np.ndarray:
    """The same as _count_batch, over LETTERS letters at a time; pieces overlap by k - 1 letters, so that each k-mer is in one."""
    out = np.zeros((len(offsets) - 1, by.size), dtype=np.int64)
    for at in range(0, max(0, len(data) - by.k + 1), LETTERS):
        to = min(len(data), at + LETTERS + by.k - 1)
        low, high = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "left")
        out[low:high] += _count_batch(data[at:to], np.clip(offsets[low : high + 1], at, to) - at, by)
    return out


def _count_batch(data: np.ndarray, offsets: np.ndarray, by: Kmers) -> np.ndarray:
    n, k = len(by.alphabet), by.k
    rows = len(offsets) - 1
    digit = np.full(256, -1, dtype=np.int8)
    for i, a in enumerate(by.alphabet):
        digit[[ord(a), ord(a.lower())]] = i
    out = np.zeros((rows, by.size), dtype=np.int64)
    m = len(data) - k + 1
    if m <= 0:
        return out
    known = digit[data] >= 0
    good = known[:m].copy()
    for j in range(1, k):
        good &= known[j : j + m]
    at = np.flatnonzero(good)  # ranks only where all letters are known
    row = np.repeat(np.arange(rows), np.diff(offsets))
    at = at[row[at] == row[at + k - 1]]
    rank = np.zeros(len(at), dtype=np.int64)
    for j in range(k):
        rank = rank * n + digit[data[at + j]]
    return np.bincount(row[at] * by.size + rank, minlength=rows * by.size).reshape(rows, by.size)


def counted(df: DataFrame, sequence: str, by: Kmers, to: str = "counts", strict: bool = True) -> DataFrame:
    """The rows with one more column: a dense vector of counts.

    A sequence with fewer letters than k raises, or with strict off has a NULL vector, as a NULL sequence has.
    """
    return _vectors(df, sequence, by, {"counts": to}, strict)


def _vectors(df: DataFrame, sequence: str, by: Kmers, to: dict[str, str], strict: bool) -> DataFrame:
    """to: names of the new columns, of "counts", of "shares" (counts by their sum, NULL where it is 0), or of both."""
    kept = [f for f in df.schema.fields if f.name not in to.values()]
    schema = T.StructType([*kept, *[T.StructField(name, T.ArrayType(T.LongType() if what == "counts" else T.DoubleType())) for what, name in to.items()]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // by.size)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [None if t is None else t.encode("latin-1", "replace") for t in part.column(sequence).to_pylist()]  # one byte a letter
                if strict and any(t is not None and len(t) < by.k for t in texts):
                    raise ValueError(f"a sequence has fewer than {by.k} letters")
                offsets = np.cumsum([0, *(len(t or b"") for t in texts)])
                found = _letters_at_once(np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8), offsets, by)
                short = np.array([t is None or len(t) < by.k for t in texts], dtype=bool)
                vectors = []
                for what in to:
                    if what == "counts":
                        vectors.append(pa.array([None if s else v for s, v in zip(short, found, strict=True)], type=pa.list_(pa.int64())))
                    else:
                        total = found.sum(axis=1)
                        shares = found / np.maximum(total, 1)[:, None]
                        vectors.append(pa.array([None if s else v for s, v in zip(short | (total == 0), shares, strict=True)], type=pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + vectors, names=schema.names)

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def spectra(df: DataFrame, sequence: str, by: Kmers, to: str = "spectrum", strict: bool = True) -> DataFrame:
    """The rows with one more column: k-mer frequencies; NULL where no k-mer is known."""
    return _vectors(df, sequence, by, {"shares": to}, strict)


def profiles(df: DataFrame, sequence: str, by: Kmers) -> DataFrame:
    """Counts, spectrum, and _head and _tail, the first and last k - 1 letters, in place of the sequence; all NULL where it is, and without the first two where it has fewer letters than k."""
    rows = _vectors(df, sequence, by, {"counts": "_counts", "shares": "spectrum"}, strict=False)
    return rows.select("*", F.left(F.col(sequence), F.lit(by.k - 1)).alias("_head"), F.right(F.col(sequence), F.lit(by.k - 1)).alias("_tail")).drop(sequence)


def folded_places(by: Kmers) -> list[list[int]]:
    """For each class of a k-mer and its reversal, in order of its first, the places of a spectrum."""
    place = {w: i for i, w in enumerate(by.all())}
    return [sorted({i, place[w[::-1]]}) for w, i in place.items() if place[w[::-1]] >= i]


def folded_counts(counts: str, by: Kmers) -> F.Column:
    """Dense counts of the classes, from dense counts."""
    return F.array(*[sum((F.col(counts)[i] for i in places[1:]), F.col(counts)[places[0]]) for places in folded_places(by)])


def folded_spectra(df: DataFrame, sequence: str, by: Kmers, to: str = "spectrum", strict: bool = True) -> DataFrame:
    """The rows with one more column: frequencies of the classes of a k-mer and its reversal; NULL where no k-mer is known."""
    rows = counted(df, sequence, by, "_counts", strict).withColumn("_total", F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x))
    total = F.col("_total")  # a column of its own: within the lambda it would be summed again for each class
    return rows.withColumn(to, F.when(total > 0, F.transform(folded_counts("_counts", by), lambda x: x / total))).drop("_counts", "_total")


def ranked(df: DataFrame, kmer: str, by: Kmers) -> DataFrame:
    return df.withColumn("rank", kmer_rank(F.col(kmer), by))


def all_kmers(spark: object, by: Kmers) -> DataFrame:
    """rank and kmer of all k-mers in order."""
    n = len(by.alphabet)
    digit = lambda j: F.substring(F.lit(by.alphabet), (F.floor(F.col("id") / n ** (by.k - 1 - j)) % n + 1).cast("int"), F.lit(1))
    return spark.range(by.size).select(F.col("id").alias("rank"), F.concat(*[digit(j) for j in range(by.k)]).alias("kmer"))


def without_reversed(words: DataFrame, kmer: str = "kmer") -> DataFrame:
    """The k-mers that don't come after their reversal."""
    return words.filter(F.col(kmer) <= F.reverse(kmer))


def concatenated(df: DataFrame, key: str, order: str, sequence: str) -> DataFrame:
    """key and the sequences of each key end to end, by order."""
    parts = F.array_sort(F.collect_list(F.struct(order, sequence)))
    return df.filter(F.col(sequence).isNotNull()).groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[sequence]), "").alias(sequence))


def cells(rows: DataFrame, by: Kmers) -> DataFrame:
    """_key, _place and _n: k-mers of all sequences of a key, counted where they are; from (_key, _text). A key without any has one row without place."""
    return summed(counted(rows.select("_key", "_text"), "_text", by, "_counts", strict=False), by)


def summed(rows: DataFrame, by: Kmers) -> DataFrame:
    """cells() from (_key, _counts): a batch's vectors of one key are added before they become rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, vectors = batch.column("_key").dictionary_encode(null_encoding="encode"), batch.column("_counts")
            full, code = vectors.is_valid().to_numpy(zero_copy_only=False), coded.indices.to_numpy()
            sums = np.zeros((len(coded.dictionary), by.size), dtype=np.int64)
            np.add.at(sums, code[full], vectors.flatten().to_numpy().reshape(-1, by.size))
            none, some = np.setdiff1d(code, code[full]), np.unique(code[full])  # keys without a vector have one row without place
            keys = pa.array(np.r_[np.repeat(some, by.size), none])
            place = pa.array([*np.tile(np.arange(by.size), len(some)).tolist(), *[None] * len(none)], type=pa.int32())
            n = pa.array([*sums[some].ravel().tolist(), *[None] * len(none)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(keys), place, n], names=["_key", "_place", "_n"])

    schema = T.StructType([rows.schema["_key"], T.StructField("_place", T.IntegerType()), T.StructField("_n", T.LongType())])
    return rows.select("_key", "_counts").mapInArrow(run, schema).groupBy("_key", "_place").agg(F.sum("_n").alias("_n"))


def ends(rows: DataFrame, by: Kmers) -> DataFrame:
    """_key, _at, _head and _tail: the first and last k - 1 letters of each sequence; from (_key, _at, _text)."""
    span = F.lit(by.k - 1)
    return rows.filter(F.length("_text") > 0).select("_key", "_at", F.left(F.col("_text"), span).alias("_head"), F.right(F.col("_text"), span).alias("_tail"))


def seams(found: DataFrame, by: Kmers) -> DataFrame:
    """_key and _text: the letters around each place where two sequences of a key meet, as far as a k-mer reaches; sequences at one place come by their first letters."""
    so_far = Window.partitionBy("_key").orderBy("_at", "_head", "_tail").rowsBetween(-(by.k - 1), -1)
    context = F.right(F.array_join(F.collect_list("_tail").over(so_far), ""), F.lit(by.k - 1))
    return found.select("_key", F.concat(context, F.col("_head")).alias("_text"))


def of_cells(counts: DataFrame, key: str, by: Kmers, to: str = "spectrum") -> DataFrame:
    """key and the k-mer frequencies of summed cells; a key whose sequences have fewer than k letters together raises."""
    sums = counts.groupBy("_key", "_place").agg(F.sum("_n").alias("_n"))
    found = sums.groupBy("_key").agg(F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "_n")))).alias("_cells"))
    whole = F.when(F.size("_cells") > 0, F.transform("_cells", lambda c: c["_n"])).otherwise(F.raise_error(F.lit(f"a sequence has fewer than {by.k} letters")))
    total = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("_key").alias(key), whole.alias("_counts")).select(key, F.when(total > 0, F.transform("_counts", lambda x: x / total)).alias(to))


def joined_spectra(df: DataFrame, key: str, order: str, sequence: str, by: Kmers, to: str = "spectrum") -> DataFrame:
    """key and the k-mer frequencies of its sequences end to end, by order: spectra() of concatenated(), without building the texts.

    Each sequence is counted where it is; only the ends of sequences pass through the window of a key.
    A key whose sequences have fewer than k letters together raises; NULL and empty sequences count nothing.
    """
    rows = df.filter(F.col(sequence).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.col(sequence).alias("_text"))
    counts = cells(rows, by)
    if by.k > 1:
        counts = counts.unionByName(cells(seams(ends(rows, by), by), by))
    return of_cells(counts, key, by, to)
