"""Local alignment search: sequences like each query's, with scores in bits and expected numbers.

Words of the queries, at every position, and of the targets, at every stride-th, meet in an
equality join; with a substitution matrix a query's word stands for all words near it. What
a word pair leaves is its diagonal, the difference of its places; diagonals of a query and
target are counted before they are shuffled, those near each other make a band, and a band
with enough word pairs is a candidate. Only candidates are aligned: a query against the part
of the target along the band, row by row, the candidates of a batch side by side in numpy,
with affine gaps. The best alignment of each query and target is kept.

Exact words alone find every place that shares 2 * word + stride - 1 letters in a row with
the query, if two pairs are asked for. An alignment that leaves its band by more than the
padding is found as far as the band goes. Letters in lower case are those in upper case.
Null and short sequences, below a word's length, have no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.sources.files import HITS

#: Cells of all bands aligned side by side; bits of a cell's number below its score.
CELLS, NUMBER = 1 << 18, 40


@dataclass(frozen=True)
class Scoring:
    """Scores of letter pairs and gaps (a gap of n letters costs opening + n * extension), and what makes a candidate.

    matrix has scores of pairs of letters; without one, equal letters score match, others mismatch. With a threshold a query's
    word stands for all words of the matrix's letters that score so much against it, or only for itself.
    rate and factor are those of the statistics; without a rate it is found from the letters of the targets.
    """

    match: int = 2
    mismatch: int = -3
    opening: int = 5
    extension: int = 2
    word: int = 11
    stride: int = 11
    pairs: int = 2
    padding: int = 16
    rate: float | None = None
    factor: float = 0.41
    threshold: int | None = None
    matrix: dict[tuple[str, str], int] | None = field(default=None, hash=False)

    def table(self) -> np.ndarray:
        """The score of each pair of bytes."""
        out = np.full((256, 256), self.mismatch, dtype=np.int64)
        np.fill_diagonal(out, self.match)
        if self.matrix:
            out[:] = min(self.matrix.values())
            for (a, b), s in self.matrix.items():
                out[ord(a.upper()), ord(b.upper())] = out[ord(b.upper()), ord(a.upper())] = s
        return out


def read_matrix(lines: Iterable[str]) -> dict[tuple[str, str], int]:
    """A substitution matrix from the lines of its usual text form: letters, then a letter and its scores a line; # begins a remark."""
    rows = [line.split() for line in lines if line.strip() and not line.startswith("#")]
    return {(r[0], a): int(s) for r in rows[1:] for a, s in zip(rows[0], r[1:], strict=True)}


def letters(sequence: Column) -> Column:
    return F.translate(sequence, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("binary")


def words(rows: DataFrame, length: int, stride: int) -> DataFrame:
    """id, place and word, from (id, letters), at every stride-th place."""
    places = F.sequence(F.lit(0), F.length("letters") - length, F.lit(stride))
    cut = F.transform(places, lambda i: F.struct(i.alias("place"), F.substring(F.col("letters"), i + 1, F.lit(length)).alias("word")))
    return rows.filter(F.length("letters") >= length).select("id", F.explode(cut).alias("w")).select("id", "w.place", "w.word")


def neighbourhood(found: DataFrame, scoring: Scoring) -> DataFrame:
    """The rows (id, place, word) for each word of the matrix's letters that scores the threshold against the row's."""
    table = scoring.table()
    alphabet = np.array(sorted({ord(a.upper()) for pair in scoring.matrix or {} for a in pair}), dtype=np.uint8)

    def near(word: bytes) -> list[bytes]:
        score = table[np.frombuffer(word, dtype=np.uint8)][:, alphabet]
        after = np.r_[np.cumsum(score.max(axis=1)[::-1])[::-1][1:], 0]  # the most that the letters to come can add
        total, made = np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.uint8)
        for k in range(len(word)):
            more = total[:, None] + score[k]
            row, letter = np.nonzero(more + after[k] >= scoring.threshold)
            total, made = more[row, letter], np.c_[made[row], alphabet[letter]]
        return [m.tobytes() for m in made]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[bytes]] = {}
        for batch in batches:
            lists = [known.setdefault(w, known.get(w) or near(w)) for w in batch.column("word").to_pylist()]
            if len(known) > 1 << 16:
                known.clear()
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("place").take(at), pa.array([w for x in lists for w in x], pa.binary())], names=["id", "place", "word"])

    return found.mapInArrow(run, found.select("id", "place", "word").schema)


def candidates(queries: DataFrame, targets: DataFrame, scoring: Scoring) -> DataFrame:
    """query, target and the first and last diagonal of each band; queries and targets are (id, letters)."""
    asked, there = words(queries, scoring.word, 1), words(targets, scoring.word, scoring.stride)
    if scoring.threshold is not None:
        asked = neighbourhood(asked, scoring)
    met = asked.select(F.col("id").alias("query"), F.col("place").alias("at"), "word").join(there.select(F.col("id").alias("target"), "place", "word"), "word")
    counted = met.groupBy("query", "target", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("n"))
    along = Window.partitionBy("query", "target").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > scoring.padding, F.lit(True))
    bands = counted.withColumn("new", apart.cast("int")).withColumn("band", F.sum("new").over(along))
    found = bands.groupBy("query", "target", "band").agg(F.sum("n").alias("n"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
    return found.filter(F.col("n") >= scoring.pairs).select("query", "target", "first", "last")


def aligned(queries: list[bytes], targets: list[bytes], first: np.ndarray, last: np.ndarray, scoring: Scoring) -> np.ndarray:
    """Score, begin and end in the query, begin and end in the target of the best local alignment of each pair within diagonals first to last."""
    out = np.zeros((len(queries), 5), dtype=np.int64)
    table, m, width = scoring.table(), np.array([len(q) for q in queries]), last - first + 1
    order = np.lexsort((m, width))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * width[order[to]] <= CELLS:
            to += 1
        some = order[at:to]
        out[some] = _rows([queries[i] for i in some], [targets[i] for i in some], first[some], int(width[some].max()), table, scoring)
        at = to
    return out


def _rows(queries: list[bytes], targets: list[bytes], first: np.ndarray, width: int, table: np.ndarray, scoring: Scoring) -> np.ndarray:
    """Rows of the query in turn; a cell holds its score and, below, the number of the cell where its alignment begins, so that the greatest wins with its beginning."""
    n, deep = len(queries), max(map(len, queries))
    long = np.array([len(t) for t in targets])
    q = np.zeros((n, deep), dtype=np.uint8)
    t = np.zeros((n, int(long.max()) + 1), dtype=np.uint8)
    for i, (a, b) in enumerate(zip(queries, targets, strict=True)):
        q[i, : len(a)], t[i, : len(b)] = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    rows = np.array([len(a) for a in queries])
    unit, low = 1 << NUMBER, -(1 << 62)
    opening, extension = scoring.opening * unit, scoring.extension * unit
    ramp = np.arange(width, dtype=np.int64) * extension
    held, gap = np.zeros((n, width), dtype=np.int64), np.full((n, width + 1), low, dtype=np.int64)
    best, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    column = first[:, None] + np.arange(width)
    for i in range(deep):
        j = column + i
        good = (j >= 0) & (j < long[:, None]) & (i < rows)[:, None]
        score = table[q[:, i][:, None], np.take_along_axis(t, np.where(good, j, 0), 1)]
        fresh = np.arange(i * width, (i + 1) * width, dtype=np.int64)
        straight = np.where(good, np.maximum(held, fresh) + score * unit, low)
        gap[:, :-1] = np.maximum(gap[:, 1:], np.c_[held[:, 1:], np.full(n, low)] - opening) - extension  # letters of the query without one of the target
        now = np.maximum(np.maximum(straight, gap[:, :-1]), 0)
        run = np.maximum.accumulate(now + ramp, axis=1)  # letters of the target without one of the query
        now[:, 1:] = np.maximum(now[:, 1:], run[:, :-1] - ramp[1:] - opening)
        held = now
        top = held.argmax(axis=1)
        value = held[np.arange(n), top]
        better = value >> NUMBER > best >> NUMBER
        best[better], place[better] = value[better], (i * width + top)[better]
    start, some = best & (unit - 1), best >> NUMBER > 0
    a, b = start // width, place // width
    found = np.stack([best >> NUMBER, a, b + 1, first + a + start % width, first + b + place % width + 1], axis=1)
    return np.where(some[:, None], found, 0)


def letter_counts(rows: DataFrame) -> np.ndarray:
    """How often each byte stands in letters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for value in batch.column("letters"):
                if value.is_valid:
                    total += np.bincount(np.frombuffer(value.as_buffer(), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["letter", "n"])

    out = np.zeros(256, dtype=np.int64)
    for r in rows.select("letters").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r["letter"]] = r["n"]
    return out


def rate_of(counts: np.ndarray, table: np.ndarray) -> float:
    """The positive rate at which the expected exponential of a random pair's score is 1; a scoring without one raises."""
    p = counts / max(counts.sum(), 1)
    seen = np.flatnonzero(p)
    weight, score = np.outer(p[seen], p[seen]), table[np.ix_(seen, seen)]
    if not len(seen) or (weight * score).sum() >= 0 or score.max() <= 0:
        raise ValueError("scores of random letters have to be negative on average, and some positive")
    low, high = 0.0, 1.0
    while (weight * np.exp(high * score)).sum() < 1:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (weight * np.exp(middle * score)).sum() < 1 else (low, middle)
    return high


def search(queries: DataFrame, targets: DataFrame, query: str, query_sequence: str, target: str, target_sequence: str, scoring: Scoring | None = None, evalue: float = 0.001) -> DataFrame:
    """query, target, score, bits, evalue and the places (from 0, ends excluded) of the best alignment of each query and target, those expected up to evalue times by chance.

    Ids stand once each; rows without id are left out.
    """
    scoring = scoring or Scoring()
    table = scoring.table()
    asked = queries.filter(F.col(query).isNotNull()).select(F.col(query).alias("id"), letters(F.col(query_sequence)).alias("letters"))
    there = targets.filter(F.col(target).isNotNull()).select(F.col(target).alias("id"), letters(F.col(target_sequence)).alias("letters"))
    counts = letter_counts(there)
    if not counts.sum():
        rate, size = scoring.rate or 1.0, 1
    else:
        rate, size = scoring.rate or rate_of(counts, table), int(counts.sum())
    found = candidates(asked, there, scoring).join(asked.select(F.col("id").alias("query"), F.col("letters").alias("q")), "query").join(there.select(F.col("id").alias("target"), F.col("letters").alias("t")), "target")
    begin = F.greatest(F.lit(0), F.col("first") - scoring.padding)
    end = F.least(F.length("t"), F.col("last") + scoring.padding + F.length("q"))
    rows = found.select("query", "target", "q", F.substring("t", begin + 1, end - begin).alias("t"), begin.alias("begin"), (F.col("first") - scoring.padding - begin).alias("first"), (F.col("last") + scoring.padding - begin).alias("last"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query", "target")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = (batch.column(c).to_pylist() for c in ("q", "t"))
            first, last, begin = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "begin"))
            got = aligned(q, t, first, last, scoring) if len(q) else np.zeros((0, 5), dtype=np.int64)
            got[:, 3:] += begin[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("target"), pa.array(np.array([len(x) for x in q], dtype=np.int64)), *(pa.array(got[:, k]) for k in range(5))], names=["query", "target", "m", "score", "q_start", "q_end", "t_start", "t_end"])

    got = rows.mapInArrow(run, ", ".join([*kinds, *(f"{c} long" for c in ("m", "score", "q_start", "q_end", "t_start", "t_end"))]))
    bits = (F.lit(rate) * F.col("score") - math.log(scoring.factor)) / math.log(2)
    best = got.groupBy("query", "target", "m").agg(F.min(F.struct((-F.col("score")).alias("lost"), "t_start", "q_start", "t_end", "q_end")).alias("b"))
    told = best.select("query", "target", "m", (-F.col("b.lost")).alias("score"), "b.q_start", "b.q_end", "b.t_start", "b.t_end").withColumn("bits", bits)
    told = told.withColumn("evalue", F.col("m") * F.lit(float(size)) * F.pow(F.lit(2.0), -F.col("bits")))
    return told.filter((F.col("evalue") <= evalue) & (F.col("score") > 0)).select("query", "target", "score", "bits", "evalue", "q_start", "q_end", "t_start", "t_end")


def hit_lists(found: DataFrame, titles: DataFrame, key: str = "gene_id", n: int = 5) -> DataFrame:
    """key and the first n hits of each query, the least expected first, as a table of results holds them; titles are (target, title)."""
    order = Window.partitionBy("query").orderBy("evalue", F.desc("score"), "target")
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).join(titles.select("target", "title"), "target")
    hit = F.struct("place", F.struct("title", "evalue", F.col("score").cast("double").alias("score"), "bits").alias("hit"))
    return first.groupBy(F.col("query").alias(key)).agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["hit"]).cast(HITS).alias("hits"))
