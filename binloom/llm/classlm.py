"""Language-model scoring by Brown classes.

Types are the OWN most frequent words, the other words by the last three bytes of their
form (SHAPES types), and the text's end. Exchange clustering moves types between CLASSES
classes while that raises the likelihood of the class bigrams. Then every other word seen
LEAST times or more is clustered by itself: the classes before and after it are counted over
all texts, and it goes from its shape's class to the one that these counts make likeliest.
Only rarer and unseen words keep their shape's class. Words of the lookup move all at once,
and stay if that does not raise the likelihood; the others move after them, one by one
against the classes so found (two of them side by side see each other's shape's class). A
token's probability is that of its class after the class before, times that of the word in
its class; of each class, the share of words seen once is kept for unseen ones.

Words are counted over all training texts by 64-bit hash. The words with the largest
counts, at most FREQUENT, are sent to all tasks; occurrences of the others are joined to
their counts by hash. A word of that join is rare in training by construction, and rows
of different documents are never gathered in one place.

Null and empty texts have one token, their end. Without training texts all counts are 0.
Rows with the same id are scored one by one, and ids may be of any type or null; an empty
table gives no rows. Only the columns named are read, so that others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm import textbytes
from binloom.session import written

#: Words sent to all tasks at most, words that are types of their own, shapes, classes, sweeps of the clustering.
FREQUENT, OWN, SHAPES, CLASSES, SWEEPS = 1 << 18, 640, 255, 48, 6
#: Count from which a word is clustered by itself.
LEAST = 3
#: Words of the lookup whose contexts travel together.
BUCKET = 4096
END = 0  # the type and class of the text's end
TYPES = 1 + OWN + SHAPES
#: Distinct words that a task holds before it hands on their counts.
HELD = 1 << 21


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and document of each word, A-Z in lower case."""
    low = textbytes.LOWER[data]
    starts, ends, doc = textbytes.words(low, offsets)
    word = textbytes.word_hash(low, starts, ends)
    tail = np.zeros(len(starts), dtype=np.uint64)  # the last three bytes, as a number
    for k in (3, 2, 1):
        tail = (tail << np.uint64(8)) | np.where(ends - k >= starts, low[np.maximum(ends - k, 0)], 0).astype(np.uint64) if len(starts) else tail
    return word, (textbytes.mix(tail) % np.uint64(SHAPES)).astype(np.int16), doc


def word_counts(training: DataFrame, text: str) -> DataFrame:
    """hash, shape and count of each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            word, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            word, first, back = np.unique(word, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(shape[first]), pa.array(np.bincount(back, weights=n, minlength=len(word)).astype(np.int64))], names=["hash", "shape", "n"])

        for batch in batches:
            for _, data, offsets in textbytes.chunks(batch, text):
                word, shape, _ = tokens(data, offsets)
                if len(word):
                    word, first, n = np.unique(word, return_index=True, return_counts=True)
                    held.append((word, shape[first], n))
                if sum(len(x[0]) for x in held) > HELD:
                    yield merged()
        if held:
            yield merged()

    found = training.select(text).mapInArrow(textbytes.trimmed(run), "hash long, shape short, n long")
    return found.groupBy("hash").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class Lookup:
    """Values of the frequent words by hash, and the types of the few that have their own."""

    hashes: np.ndarray  # sorted, unsigned
    counts: np.ndarray
    own: np.ndarray  # the type of its own, 0 for none

    def of(self, word: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not a frequent word) and type of each word."""
        if not len(self.hashes):
            return np.full(len(word), -1, dtype=np.int64), 1 + OWN + shape.astype(np.int64)
        distinct, back = np.unique(word, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        hit = self.hashes[at] == distinct
        count, own = np.where(hit, self.counts[at], -1)[back], np.where(hit, self.own[at], 0)[back]
        return count, np.where(own > 0, own, 1 + OWN + shape.astype(np.int64))


def frequent_words(counts: DataFrame) -> Lookup:
    """The words of the largest counts: as many whole ranges of counts, 64 to a doubling, as keep to FREQUENT words."""
    ranged = counts.withColumn("range", F.floor(F.log2("n") * 64))
    least, total = None, 0
    for r, words in ranged.groupBy("range").count().orderBy(F.desc("range")).collect():  # some thousands at most
        total += words
        if total > FREQUENT:
            break
        least = r
    rows = ranged.filter(F.col("range") >= least if least is not None else F.lit(False)).select("hash", "n").toArrow()
    hashes, n = rows["hash"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    own = np.zeros(len(n), dtype=np.int64)
    top = np.lexsort((hashes, -n))[:OWN]
    own[top] = 1 + np.arange(len(top))
    return Lookup(hashes, n, own)


def chained(kinds: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each token and the token itself, texts' ends included; kinds are of words."""
    length = np.bincount(doc, minlength=docs) + 1
    stop = np.cumsum(length) - 1
    row = np.full(int(length.sum()), END, dtype=np.int64)
    inner = np.ones(len(row), dtype=bool)
    inner[stop] = False
    row[inner] = kinds
    before = np.empty_like(row)
    before[1:], before[:1] = row[:-1], END
    return before, row


def type_bigrams(training: DataFrame, text: str, lookup: Lookup) -> np.ndarray:
    """Counts of each type after each type: TYPES x TYPES, whatever the input's size."""
    sent = training.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TYPES * TYPES, dtype=np.int64)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, text):
                word, shape, doc = tokens(data, offsets)
                before, after = chained(sent.value.of(word, shape)[1], doc, part.num_rows)
                total += np.bincount(before * TYPES + after, minlength=TYPES * TYPES)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = training.select(text).mapInArrow(textbytes.trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TYPES * TYPES, dtype=np.float64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(TYPES, TYPES)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type: type END alone in class END, the others moved while the likelihood of class bigrams rises."""

    n = pairs.sum(axis=0)
    order = np.argsort(-n[1:], kind="stable") + 1
    where = np.zeros(len(n), dtype=np.int64)
    where[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.zeros((len(n), classes))
    one[np.arange(len(n)), where] = 1
    to, back = pairs @ one, pairs.T @ one  # of each type: counts of the classes after and before it
    table, size = one.T @ to, one.T @ n
    for _ in range(sweeps):
        moved = 0
        for w in order[n[order] > 0].tolist():
            a, right, left, own = where[w], to[w].copy(), back[w].copy(), pairs[w, w]
            right[a] -= own
            left[a] -= own  # neighbours other than the type itself
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            size[a] -= n[w]
            base_rows, base_columns = f(table).sum(axis=1), f(table).sum(axis=0)
            rows, columns = table + right, table + left[:, None]  # row (column) k: if w joins class k
            gain = f(rows).sum(axis=1) - base_rows + f(columns).sum(axis=0) - base_columns
            k = np.arange(classes)
            both = table[k, k] + right + left + own
            gain += f(both) - f(rows[k, k]) - f(columns[k, k]) + f(table[k, k])
            gain -= 2 * (f(size + n[w]) - f(size))
            gain[END] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            size[b] += n[w]
            if b != a:
                moved += 1
                where[w] = b
                to[:, a] -= pairs[:, w]
                to[:, b] += pairs[:, w]
                back[:, a] -= pairs[w]
                back[:, b] += pairs[w]
        if not moved:
            break
    return where


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the classes' bigrams and their words, but for what doesn't depend on the classes."""
    return float(f(table).sum() - f(table.sum(axis=0)).sum() - f(table.sum(axis=1)).sum())


def likeliest(table: np.ndarray, word: np.ndarray, cell: np.ndarray, count: np.ndarray, was: np.ndarray) -> np.ndarray:
    """The class of each word, from counts of its cells (a class before it, CLASSES + a class after it), sorted by word; was: the classes so far."""
    gain = np.zeros((len(was), CLASSES))
    total = np.bincount(word[cell < CLASSES], weights=count[cell < CLASSES], minlength=len(was))
    both = np.concatenate([table, table.T])  # row: a cell; column: the word's class
    for at in range(0, len(word), 1 << 15):
        w, n = word[at : at + (1 << 15)], count[at : at + (1 << 15), None].astype(np.float64)
        old = both[cell[at : at + (1 << 15)]]
        change = f(old + n) - f(old)
        k, own = np.arange(len(w)), was[w]
        here = old[k, own]
        change[k, own] = f(here) - f(np.maximum(here - n[:, 0], 0))
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[first]] += np.add.reduceat(change, first)
    size, k = table.sum(axis=0), np.arange(len(was))
    more = f(size[None] + total[:, None]) - f(size)[None]
    more[k, was] = f(size[was]) - f(np.maximum(size[was] - total, 0))
    gain -= 2 * more
    gain[:, END] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[k, best] > gain[k, was] + 1e-9, best, was)


def word_classes(training: DataFrame, text: str, lookup: Lookup, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word of the lookup, -1 for its shape's: those of LEAST or more that aren't types of their own are moved at once."""
    out = np.where(lookup.own > 0, classes[lookup.own], -1)
    if not len(out):
        return out
    sent = training.sparkSession.sparkContext.broadcast((lookup.hashes, np.flatnonzero((lookup.counts >= LEAST) & (lookup.own == 0)), lookup, classes))

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, free, known, of_type = sent.value
        slot = np.full(len(hashes), -1, dtype=np.int64)
        slot[free] = np.arange(len(free))
        total = np.zeros(len(free) * 2 * CLASSES, dtype=np.int32)
        shapes = np.zeros(len(free), dtype=np.int16)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, text):
                word, shape, doc = tokens(data, offsets)
                if not len(word):
                    continue
                before, row = chained(of_type[known.of(word, shape)[1]], doc, part.num_rows)
                at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
                mine = np.where(hashes[at] == word, slot[at], -1)
                place = np.arange(len(word)) + doc  # of each word in row: one end for each document before it
                some = np.flatnonzero(mine >= 0)
                cells = np.r_[mine[some] * 2 * CLASSES + before[place[some]], mine[some] * 2 * CLASSES + CLASSES + row[place[some] + 1]]
                cells, n = np.unique(cells, return_counts=True)
                total[cells] += n.astype(np.int32)
                shapes[mine[some]] = shape[some]
        for bucket in range(0, len(free), BUCKET):
            part = total[bucket * 2 * CLASSES : (bucket + BUCKET) * 2 * CLASSES]
            cells = np.flatnonzero(part)
            if len(cells):
                kinds = shapes[bucket : bucket + BUCKET]
                yield pa.RecordBatch.from_arrays([pa.array([bucket // BUCKET]), *(pa.array([x.tobytes()], type=pa.binary()) for x in (cells.astype(np.int32), part[cells], kinds))], names=["bucket", "cells", "n", "shapes"])

    found = training.select(text).mapInArrow(textbytes.trimmed(contexts), "bucket long, cells binary, n binary, shapes binary").repartition("bucket").sortWithinPartitions("bucket")

    def moved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free, of_type, now, total, shapes = sent.value[1], sent.value[3], None, None, None

        def done() -> pa.RecordBatch:
            cells = np.flatnonzero(total)
            new = likeliest(table, cells // (2 * CLASSES), cells % (2 * CLASSES), total[cells], of_type[1 + OWN + shapes.astype(np.int64)])
            at = free[now * BUCKET : (now + 1) * BUCKET]
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(new[: len(at)].astype(np.int64))], names=["at", "class"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now:
                    if now is not None:
                        yield done()
                    now, total, shapes = r["bucket"], np.zeros(BUCKET * 2 * CLASSES, dtype=np.int64), np.zeros(BUCKET, dtype=np.int16)
                total[np.frombuffer(r["cells"], dtype=np.int32)] += np.frombuffer(r["n"], dtype=np.int32)
                seen = np.frombuffer(r["shapes"], dtype=np.int16)
                shapes[: len(seen)] = np.maximum(shapes[: len(seen)], seen)
        if now is not None:
            yield done()

    rows = found.mapInArrow(textbytes.trimmed(moved), "at long, class long").toArrow()
    out[rows["at"].to_numpy()] = rows["class"].to_numpy()
    return out


def final_classes(training: DataFrame, text: str, lookup: Lookup, of_word: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """Counts of each class after each class, the lookup's words in their classes; and (hash, was, pairs) of the other words of LEAST or more: their shapes' class, and CLASSES x the class before + the class after each time."""
    sent = training.sparkSession.sparkContext.broadcast((lookup, of_word, classes))
    others = bool(len(lookup.counts)) and int(lookup.counts.min()) > LEAST or not len(lookup.counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, text):
                word, shape, doc = tokens(data, offsets)
                count, kind = placed(sent.value, word, shape)
                before, row = chained(kind, doc, part.num_rows)
                total += np.bincount(before * CLASSES + row, minlength=len(total))
                rare = np.flatnonzero(count < 0)
                if others and len(rare):
                    at = rare + doc[rare]
                    yield pa.RecordBatch.from_arrays([pa.array(word[rare].view(np.int64)), pa.array(kind[rare].astype(np.int16)), pa.array((before[at] * CLASSES + row[at + 1]).astype(np.int16)), pa.array(np.ones(len(rare), dtype=np.int64))], names=["hash", "was", "pair", "n"])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.int64()), pa.nulls(len(cells), pa.int16()), pa.array(cells.astype(np.int16)), pa.array(total[cells])], names=["hash", "was", "pair", "n"])

    rows = written(training.select(text).mapInArrow(textbytes.trimmed(run), "hash long, was short, pair short, n long"))
    cells = rows.filter("hash is null").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[cells["pair"].to_numpy()] = cells["n"].to_numpy()
    rare = rows.filter("hash is not null").groupBy("hash").agg(F.min("was").alias("was"), F.collect_list("pair").alias("pairs")).filter(F.size("pairs") >= LEAST)
    return out.reshape(CLASSES, CLASSES), rare


def placed(sent: tuple[Lookup, np.ndarray, np.ndarray], word: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count (-1: not in the lookup) and class of each word."""
    lookup, of_word, classes = sent
    by_shape = classes[1 + OWN + shape.astype(np.int64)]
    if not len(lookup.hashes):
        return np.full(len(word), -1, dtype=np.int64), by_shape
    at = np.minimum(np.searchsorted(lookup.hashes, word), len(lookup.hashes) - 1)
    hit = lookup.hashes[at] == word
    return np.where(hit, lookup.counts[at], -1), np.where(hit & (of_word[at] >= 0), of_word[at], by_shape)


def rare_classes(rare: DataFrame, table: np.ndarray) -> DataFrame:
    """(hash, class, was, pairs) of final_classes' words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("pairs")
            pair, word = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            key, n = np.unique(np.r_[word * 2 * CLASSES + pair // CLASSES, word * 2 * CLASSES + CLASSES + pair % CLASSES], return_counts=True)
            new = likeliest(table, key // (2 * CLASSES), key % (2 * CLASSES), n, batch.column("was").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(new.astype(np.int16)), batch.column("was"), lists], names=["hash", "class", "was", "pairs"])

    return rare.mapInArrow(textbytes.trimmed(run), "hash long, class short, was short, pairs array<short>")


def class_shifts(rare: DataFrame) -> np.ndarray:
    """What the words of rare_classes add to the classes' bigrams by leaving their shapes' classes: one table from each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES), dtype=np.int64)
        for batch in batches:
            lists = batch.column("pairs")
            pair, times = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
            for name, sign in (("class", 1), ("was", -1)):
                k = np.repeat(batch.column(name).to_numpy().astype(np.int64), times)
                np.add.at(total, (pair // CLASSES, k), sign)
                np.add.at(total, (k, pair % CLASSES), sign)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "n"])

    rows = rare.select("class", "was", "pairs").mapInArrow(textbytes.trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


@dataclass
class Model:
    """What scoring needs, all of bounded size."""

    lookup: Lookup
    classes: np.ndarray  # of types
    follows: np.ndarray  # log10 of a class after a class
    seen: np.ndarray  # log10 of what a class's word has for each of its count
    unseen: np.ndarray  # log10 of an unseen word in a class
    train_tokens: int
    distinct: int
    ends: int
    of_word: np.ndarray  # classes of the lookup's words, -1: its shape's
    clustered: float  # share of the training words' occurrences that are of words clustered by themselves


def fit(training: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the words' counts (hash, n) with the class of those clustered by themselves that aren't in the lookup."""
    counts = written(word_counts(training, text))
    lookup = frequent_words(counts)
    sums = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("n") >= LEAST, F.col("n")))).first()
    once = np.zeros(SHAPES)
    for shape, n in counts.filter("n = 1").groupBy("shape").count().collect():
        once[shape] = n
    pairs = type_bigrams(training, text, lookup)
    ends = int(pairs[:, END].sum())
    classes = exchange(pairs)
    one = np.zeros((TYPES, CLASSES))
    one[np.arange(TYPES), classes] = 1
    table = one.T @ pairs @ one
    start = np.where(lookup.own > 0, classes[lookup.own], -1)
    of_word = word_classes(training, text, lookup, classes, table)
    moved, rare = final_classes(training, text, lookup, of_word, classes)
    if likelihood(moved) < likelihood(table):
        of_word = start
        moved, rare = final_classes(training, text, lookup, of_word, classes)
    table = moved
    rare = written(rare_classes(rare, table))
    table += class_shifts(rare)
    table, size = np.maximum(table, 0), table.sum(axis=0)
    share = (size + 0.5) / (size + 0.5).sum()
    follows = np.log10((table + share) / (table.sum(axis=1, keepdims=True) + 1))
    singles = np.minimum((one[1 + OWN :].T @ once + 0.5) / (size + 1), 0.5)
    seen = np.log10((1 - singles) / np.maximum(size, 1))
    seen[END] = -math.log10(ends) if ends else 0.0
    return Model(lookup, classes, follows, seen, np.log10(singles), int(sums[0] or 0) + ends, int(sums[1]) + (ends > 0), ends, of_word, (sums[2] or 0) / max(1, sums[0] or 0)), counts.select("hash", "n").join(rare.select(F.col("hash").alias("_h"), F.col("class").alias("own_class")), F.col("hash") == F.col("_h"), "left").drop("_h")


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    all_ = model.train_tokens + model.distinct + 1
    schema = f"row long, doc_id {docs.schema[doc_id].dataType.simpleString()}, key long, class short, at long, before short, after short, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row0 = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, text):
                n = part.num_rows
                word, shape, doc = tokens(data, offsets)
                count, classes = placed((m.lookup, m.of_word, m.classes), word, shape)
                here = count >= 0
                # what touches a word of the join is added when its class is known
                before, after = chained(np.where(here, classes, -1), doc, n)
                length = np.bincount(doc, minlength=n) + 1
                path = np.add.reduceat(np.where((before >= 0) & (after >= 0), m.follows[before, after], 0.0), np.cumsum(length) - length)
                d = doc[here]
                base = np.bincount(d, weights=np.log10((count[here] + 1) / all_), minlength=n) + math.log10((m.ends + 1) / all_)
                word_part = np.bincount(d, weights=np.log10(count[here]) + m.seen[classes[here]], minlength=n) + (math.log10(m.ends) + m.seen[END] if m.ends else m.unseen[END])
                rows = row0 + np.arange(n)
                row0 += n
                ids = part.column(doc_id)
                own = textbytes.mix(rows.astype(np.uint64)).view(np.int64)  # spreads the documents' own rows, which no word's hash should meet
                rare = np.flatnonzero(~here)
                at = rare + doc[rare]
                zero, none, unset = np.zeros(len(rare), dtype=np.int64), np.zeros(len(rare)), np.full(n, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[rows, rows[doc[rare]]]), pa.concat_arrays([ids, pa.nulls(len(rare), ids.type)]), pa.array(np.r_[own, word[rare].view(np.int64)]),
                        pa.array(np.r_[unset, classes[rare]].astype(np.int16)), pa.array(np.r_[unset, at]), pa.array(np.r_[unset, before[at]].astype(np.int16)), pa.array(np.r_[unset, after[at + 1]].astype(np.int16)),
                        pa.array(np.r_[length, zero].astype(np.int64)), pa.array(np.r_[np.bincount(d, minlength=n) + (m.ends > 0), zero].astype(np.int64)),
                        pa.array(np.r_[base, none]), pa.array(np.r_[path + word_part, none]),
                    ],
                    names=["row", "doc_id", "key", "class", "at", "before", "after", "n_tokens", "n_known", "base", "score"],
                )

    rows = docs.select(doc_id, text).mapInArrow(textbytes.trimmed(run), schema)
    joined = rows.join(counts, rows["key"] == counts["hash"], "left").withColumn("class", F.when(F.col("class") >= 0, F.coalesce("own_class", "class")).otherwise(F.col("class")))
    # a word before one of the join that is itself of the join is the row before it
    joined = joined.withColumn("before", F.when(F.col("before") >= 0, F.col("before")).otherwise(F.lag("class").over(Window.partitionBy("row").orderBy("at"))))
    rare, n = F.col("class") >= 0, F.coalesce("n", F.lit(0))
    by_class = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("class").cast("int") + 1)
    follows = F.array(*[F.lit(float(v)) for v in model.follows.ravel()])
    step = lambda a, b: F.element_at(follows, F.col(a).cast("int") * CLASSES + F.col(b).cast("int") + 1)
    joined = joined.select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + F.when(rare & (n > 0), 1).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(rare, F.log10((n + 1) / F.lit(float(all_)))).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(rare, step("before", "class") + F.when(F.col("after") >= 0, step("class", "after")).otherwise(0.0) + F.when(n > 0, F.log10(n.cast("double")) + by_class(model.seen)).otherwise(by_class(model.unseen))).otherwise(0.0)).alias("score"),
    )
    total = joined.groupBy("row").agg(F.max("doc_id").alias(doc_id), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return total.drop("row")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
