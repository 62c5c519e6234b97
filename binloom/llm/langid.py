"""Language identification by unigrams of pieces, summed over all segmentations.

A text's words are its runs of letters: ASCII ones, which count in lower case, and all bytes
from 128 on; a space stands before each. Pieces are those of a fixed public vocabulary that
such words can hold. In a language a word's probability is the sum, over all ways to cut it
into pieces, of the product of the pieces' probabilities, which a forward pass finds; a
text's is the product over its words. All bytes are pieces, so no word is impossible. A run
of more than STRETCH bytes is read in stretches of so many, which pieces don't cross.

Each language's piece probabilities are learned by expectation and maximisation from the
counts of its words over all texts that may be learned from: a forward and a backward pass
give the expected number of each piece in each word, in whole 65536ths, so that sums don't
depend on how tasks are cut. A language's counts are smoothed by those of all languages.
A text's score is the probability of the language predicted, given that it is one of those
learned, each as likely as its share of texts.

Null texts and texts without a letter are `und`, with a score of 0, and so is every text if
nothing was learned. Rows are predicted one by one, equal texts alike; of languages equally
likely the first by name is taken. Texts without a language and languages without a text
teach nothing. Columns named as the results are replaced, whatever their case, others may
have any name; an empty table gives no rows. The model grows with the number of languages,
some 0.2 MB each, not with the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import bpe, textbytes
from binloom.session import discard, written

#: Rounds of learning; texts' worth of counts that all languages lend to each; the least probability; bytes of a stretch; cells held at once; parts of an expected count.
ROUNDS, LENT, LEAST, STRETCH, CELLS, PARTS = 4, 200.0, 1e-9, 47, 1 << 21, 1 << 16
#: Longest words, with their space, that are read side by side; each byte is worth SCALE more, so that no product underflows.
WIDTHS, SCALE = (4, 6, 8, 10, 12, 16, 24, 48), 1000.0

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Pieces:
    """The vocabulary's pieces as a trie: of each length, sorted (node of the prefix, last byte), and which of these are pieces."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        fits = lambda p: p and all(LETTER[b] and b == textbytes.LOWER[b] for b in (p[1:] if p[0] == 32 else p))
        single = {bytes([b]) for b in range(256) if LETTER[b] and b == textbytes.LOWER[b]} | {b" "}
        self.all = sorted({p for p in vocabulary if fits(p)} | single)
        number = {p: i for i, p in enumerate(self.all)}
        self.keys, self.piece = [], []
        nodes = {b"": 0}
        for length in range(1, max(map(len, self.all)) + 1):
            found = {(nodes[p[: length - 1]] << 8 | p[length - 1], p[:length]) for p in self.all if len(p) >= length}
            ordered = sorted(found)
            self.keys.append(np.array([k for k, _ in ordered], dtype=np.int64))
            self.piece.append(np.array([number.get(p, -1) for _, p in ordered], dtype=np.int64))
            nodes = {p: i for i, (_, p) in enumerate(ordered)}


@dataclass
class Lattice:
    """Words side by side and where pieces lie in them: for each length, where those of each start begin, their words and the pieces."""

    rows: np.ndarray
    length: np.ndarray
    width: int
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def forward(self, weights: list[np.ndarray]) -> np.ndarray:
        """[start, word, ...]: the sum over all cuts of what stands before; weights are those of the edges of each length."""
        out = np.zeros((self.width + 1, len(self.rows), *weights[0].shape[1:]))
        out[0] = 1
        for s in range(self.width):
            for length, ((cut, word, _), w) in enumerate(zip(self.edges, weights, strict=True), 1):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    out[s + length, word[a:b]] += out[s, word[a:b]] * w[a:b]
        return out

    def backward(self, weights: list[np.ndarray]) -> np.ndarray:
        """[start, word]: the sum over all cuts of what stands from there on."""
        out = np.zeros((self.width + 1, len(self.rows)))
        out[self.length, np.arange(len(self.rows))] = 1
        for s in range(self.width - 1, -1, -1):
            for length, ((cut, word, _), w) in enumerate(zip(self.edges, weights, strict=True), 1):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    out[s, word[a:b]] += out[s + length, word[a:b]] * w[a:b]
        return out


def lattices(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, tail: int) -> Iterator[Lattice]:
    """Lattices of the words [start, end), with a space before those that opens marks; tail numbers a cell."""
    total = ends - starts + opens
    below = 0
    for width in WIDTHS:
        chosen = np.flatnonzero((total > below) & (total <= width))
        below, step = width, max(1, CELLS // ((width + 1) * tail))
        for part in (chosen[k : k + step] for k in range(0, len(chosen), step)):
            n, at = len(part), np.arange(width)[:, None] - opens[part]
            inside = (at >= 0) & (at < (ends - starts)[part])
            flat = np.where(inside, textbytes.LOWER[data[np.clip(starts[part] + at, 0, len(data) - 1)]], 0).astype(np.int64)
            flat[0, opens[part] == 1] = 32
            flat = flat.ravel()
            live, node, edges = np.arange(width * n), np.zeros(width * n, dtype=np.int64), []
            for length, (keys, piece) in enumerate(zip(pieces.keys, pieces.piece, strict=True)):
                reach = live + length * n < width * n
                live, node = live[reach], node[reach]
                key = node << 8 | flat[live + length * n]
                node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known = keys[node] == key
                live, node = live[known], node[known]
                if not len(live):
                    break
                has = piece[node] >= 0
                edges.append((np.searchsorted(live[has], np.arange(width + 1) * n), live[has] % n, piece[node[has]]))
            yield Lattice(part, total[part], width, edges)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document, hash and space before (1 or 0) of each stretch of letters."""
    n = len(data)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    letter = LETTER[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    open_, close = letter.copy(), letter.copy()
    open_[1:] &= ~letter[:-1] | edge[1:n]
    close[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    count = -(-(ends - starts) // STRETCH)
    if count.max(initial=1) > 1:
        first = np.cumsum(count) - count
        k = np.arange(count.sum()) - np.repeat(first, count)
        starts, ends = np.repeat(starts, count) + k * STRETCH, np.repeat(ends, count)
        ends, opens = np.minimum(ends, starts + STRETCH), (k == 0).astype(np.int64)
    else:
        opens = np.ones(len(starts), dtype=np.int64)
    h = textbytes.word_hash(textbytes.LOWER[data], starts, ends) ^ (opens.astype(np.uint64) * np.uint64(textbytes.GOLDEN))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, h, opens


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word (with its space) and n, over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text"):
                coded = part.column("_lang").dictionary_encode()
                starts, ends, doc, h, opens = words(data, offsets)
                code = coded.indices.to_numpy().astype(np.int64)[doc]
                _, first, back = np.unique(h ^ textbytes.mix(code), return_index=True, return_inverse=True)
                raw, s, e, o = textbytes.LOWER[data].tobytes(), starts[first].tolist(), ends[first].tolist(), opens[first].tolist()
                word = [b" " * space + raw[a:b] for a, b, space in zip(s, e, o, strict=True)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(word, pa.binary()), pa.array(np.bincount(back, minlength=len(first)))], names=["lang", "word", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).filter("_lang is not null and _text is not null")
    return rows.mapInArrow(textbytes.trimmed(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    pieces: Pieces
    langs: list[str]
    prior: np.ndarray  # log of each language's share of texts
    weights: np.ndarray  # [piece, language], times SCALE for each byte


def scaled(pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    return np.maximum(probability, LEAST) * SCALE ** np.array([len(p) for p in pieces.all])[:, None]


def expected(counts: DataFrame, pieces: Pieces, langs: list[str], weights: np.ndarray) -> np.ndarray:
    """[piece, language]: how often each piece stands in each language's words, over all cuts."""
    sent = counts.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, weight = sent.value
        total = np.zeros(weight.size, dtype=np.int64)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "word", textbytes.CHUNK_BYTES // 4):
                lang, n = (part.column(c).to_numpy() for c in ("code", "n"))
                for lattice in lattices(trie, data, offsets[:-1], offsets[1:], np.zeros(len(n), dtype=np.int64), 2):
                    code = lang[lattice.rows]
                    by = [weight[piece, code[word]] for _, word, piece in lattice.edges]
                    before, after = lattice.forward(by), lattice.backward(by)
                    for length, ((cut, word, piece), w) in enumerate(zip(lattice.edges, by, strict=True), 1):
                        start = np.repeat(np.arange(lattice.width), np.diff(cut))
                        share = before[start, word] * w * after[start + length, word] / after[0, word]
                        whole = np.rint(share * PARTS).astype(np.int64) * n[lattice.rows][word]
                        np.add.at(total, piece * weight.shape[1] + code[word], whole)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    code = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    rows = counts.select(code.cast("int").alias("code"), "word", "n").mapInArrow(textbytes.trimmed(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(weights.size)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    sent.destroy()
    return out.reshape(weights.shape) / PARTS


def fit(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS, owner: str = "query") -> Model:
    """The model of all languages in docs, which holds only rows that may be learned from; vocabulary is the path of a file of ranks."""
    with open(vocabulary, "rb") as f:
        pieces = Pieces(bpe.token_bytes(f.read()))
    texts = {r["lang"]: r["n"] for r in docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(texts)
    if not langs:
        return Model(pieces, [], np.zeros(0), np.zeros((len(pieces.all), 0)))
    share = np.array([texts[x] for x in langs], dtype=np.float64)
    counts = written(word_counts(docs, text, lang), owner)
    weights = scaled(pieces, np.full((len(pieces.all), len(langs)), 1 / len(pieces.all)))
    for _ in range(rounds):
        found = expected(counts, pieces, langs, weights)
        overall = found.sum(axis=1) + 0.5
        lent = LENT * np.outer(overall / overall.sum(), np.ones(len(langs)))
        weights = scaled(pieces, (found + lent) / (found.sum(axis=0) + LENT))
    discard(counts)
    return Model(pieces, langs, np.log(share / share.sum()), weights)


def likelihoods(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[document, language]: the log probability of each text."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    starts, ends, doc, h, opens = words(data, offsets)
    if not len(h):
        return out
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    starts, ends, opens = starts[first], ends[first], opens[first]
    word = np.zeros((len(first), len(model.langs)))
    for lattice in lattices(model.pieces, data, starts, ends, opens, len(model.langs)):
        ahead = lattice.forward([model.weights[piece] for _, _, piece in lattice.edges])
        word[lattice.rows] = np.log(ahead[lattice.length, np.arange(len(lattice.rows))]) - (lattice.length * np.log(SCALE))[:, None]
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(doc, weights=word[back, k], minlength=len(out))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with the language predicted and its probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in (to.lower(), score.lower())]
    names = [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)] + [T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "t"):
                told = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
                pred, p = np.full(part.num_rows, "und", dtype=object), np.zeros(part.num_rows)
                if told.any():
                    found = (likelihoods(m, data, offsets) + m.prior)[told].round(6)
                    top = found.argmax(axis=1)
                    pred[told] = np.array(m.langs, dtype=object)[top]
                    p[told] = (1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)).round(10)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(pred, pa.string()), pa.array(p)], names=schema.names)

    rows = docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names, strict=True)], F.col(text).alias("t"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(textbytes.trimmed(run), schema).toDF(*[f.name for f in kept], to, score)
