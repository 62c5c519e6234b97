"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A disguised token (digits or symbols inside a word, letters said many times over, letters
spaced out one by one) is a lattice: each character stands for itself, for the letters it
may replace, for a word's edge where it is a separator, or for nothing. Viterbi's algorithm
finds the likeliest letters and edges under a character bigram model of all documents, with
a channel cost for each change. Tokens and runs of spaced letters may have any length.

Words with letters outside ASCII are read as they look as well: without accents and
invisible characters, wide and styled letters as plain ones, look-alikes of other scripts as
Latin ones; so is v twice as w. Two words are also looked up as one, where neither of them
says anything and not both are usual in clean texts (`worth less`). Plain words and restored ones are then looked up, whole and by their first bytes, among
features that toxic training texts have and others lack. Between letters that separators
part, the likeliest edges may be wrong, so words from any separator to any other are looked
up as well, and those that say most without overlap are taken. What a text's strongest
features say goes through a logistic regression.

The character model counts all documents; the features and the regression come from a
sample of at most BOUND labelled documents. Nulls and empty texts hold no features and get
the score of a text without any. Rows are scored one by one, equal texts alike; an empty
table gives no rows; a column named as the score is replaced, others may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import learning, textbytes

BOUND = 40_000
#: Toxic texts of the sample that must hold a feature; bytes of a word's beginnings that are features.
SUPPORT, STEMS = 3, (4, 5, 6)
#: Words of clean texts that are known as words of their own, the most frequent ones.
USUAL = 200_000
#: Characters of the lattice: 0 is a word's edge, 1-26 a-z, 27 a byte outside ASCII.
SYMBOLS, OTHER = 28, 27
#: Letters that a character may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
#: Log costs of the channel: a letter for a digit or symbol, a dropped one of those, a dropped separator, a dropped repetition of three or more, of two, another dropped letter.
REPLACED, DROPPED, SEPARATOR, REPEATED, DOUBLED, LOST = -1.0, -5.0, -0.5, -0.5, -5.0, -30.0
#: Letters up to which the parts of a token are joined to look for words between any of its separators; single parts may be longer.
JOINED = 40
#: Characters of the tokens that are restored at once, and tokens of fewer that are remembered.
CELLS, SHORT = 1 << 15, 256
#: Characters that count as one of three when they stand more often in a row, spaced out or not.
SAID_OVER = re.compile(r"([^0-9@$!|+(<])\1{3,}|(?<!\S)([^\s0-9@$!|+(<])(?: \2){3,}(?!\S)")
DISGUISED = re.compile(r"(?i)[a-z\x80-\U0010ffff][0-9@$!|+(<*_.\-'~^#]+[a-z\x80-\U0010ffff]|(?:^|[^a-z])[0-9@$!|+(<][a-z]{2}|([a-z])\1\1|[a-z]{2}[0-9@$]+$")
#: The same as a filter on bytes: three equal letters, or a letter beside a digit or symbol.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACED = LETTER & (np.arange(256) < 128)
SPACED[[ord(c) for c in STANDS_FOR]] = True
CODE = np.zeros(256, dtype=np.int64)
CODE[97:123] = np.arange(1, 27)
CODE[65:91] = np.arange(1, 27)
CODE[128:] = OTHER
NUMBERS = 5  # features of a text that go into the regression


def letter_bigrams(docs: DataFrame, text: str) -> np.ndarray:
    """Log probabilities of each symbol after each symbol, edges of words included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in textbytes.chunks(batch, text):
                if len(data):
                    code = CODE[data]
                    first = np.zeros(len(data) + 1, dtype=bool)
                    first[offsets] = True
                    total += np.bincount(np.where(first[:-1], 0, np.r_[0, code[:-1]]) * SYMBOLS + code, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = docs.select(text).mapInArrow(textbytes.trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(SYMBOLS * SYMBOLS, 0.5)
    table[rows["cell"].to_numpy()] += rows["n"].to_numpy()
    table = table.reshape(SYMBOLS, SYMBOLS)
    return np.log(table / table.sum(axis=1, keepdims=True))


#: Rows of the lattice's costs of taking a character for a symbol: symbols, a separator, the space of spaced letters, the end of shorter tokens, STANDS_FOR.
SPLIT, GAP, PAST = SYMBOLS, SYMBOLS + 1, SYMBOLS + 2
KIND = {c: SYMBOLS + 3 + i for i, c in enumerate(STANDS_FOR)}
EMIT = np.full((SYMBOLS + 3 + len(KIND), SYMBOLS), -np.inf)
EMIT[np.arange(1, SYMBOLS), np.arange(1, SYMBOLS)] = 0.0
EMIT[SPLIT, 0], EMIT[GAP, 0] = SEPARATOR, 0.0
for _c, _letters in STANDS_FOR.items():
    EMIT[KIND[_c], [ord(x) - 96 for x in _letters]] = REPLACED


def decoded(tokens: list[str], bigrams: np.ndarray) -> list[str]:
    """The likeliest letters of each token, with a space for a word's edge and NUL for a dropped separator; all tokens together, a character of each in every step."""
    if not tokens:
        return []
    plain = [SAID_OVER.sub(lambda m: 3 * m[1] if m[1] else " ".join(3 * m[2]), t.lower()) for t in tokens]
    width, n = max(map(len, plain)), len(plain)
    kind = np.full((n, width), PAST, dtype=np.int16)
    skip = np.zeros((n, width))  # cost of dropping a character
    for i, t in enumerate(plain):
        solid = t.replace(" ", "")
        at = 0  # in solid
        for k, c in enumerate(t):
            if c == " ":
                kind[i, k] = GAP
                continue
            if "a" <= c <= "z" or ord(c) > 127:
                kind[i, k] = ord(c) - 96 if c <= "z" else OTHER
                again = at > 0 and solid[at - 1] == c
                skip[i, k] = (REPEATED if solid[at + 1 : at + 2] == c or solid[max(0, at - 2) : at] == 2 * c else DOUBLED) if again else LOST
            else:
                kind[i, k] = KIND.get(c, SPLIT)
                skip[i, k] = SEPARATOR if c not in STANDS_FOR else DROPPED if len(solid) == len(t) else LOST  # spaced out, it is meant as a letter
            at += 1
    best = np.full((n, SYMBOLS), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((n, width, SYMBOLS), dtype=np.int8)  # the symbol before, -1: the character was dropped
    for k in range(width):
        through = best[:, :, None] + bigrams[None]
        source = through.argmax(axis=1)
        taken = np.take_along_axis(through, source[:, None], axis=1)[:, 0] + EMIT[kind[:, k]]
        left = best + skip[:, k, None]
        came[:, k] = np.where(taken > left, source, -1)
        best = np.maximum(taken, left)
    last = (best + bigrams[:, 0]).argmax(axis=1)
    out = []
    for i, t in enumerate(plain):
        state, letters = int(last[i]), []
        for k in range(len(t) - 1, -1, -1):
            if (before := int(came[i, k, state])) >= 0:
                letters.append(" " if state == 0 else t[k] if state == OTHER else chr(96 + state))
                state = before
            elif kind[i, k] in (SPLIT, GAP):
                letters.append("\0")
        out.append("".join(reversed(letters)))
    return out


def restore(tokens: list[str], bigrams: np.ndarray) -> list[str]:
    """The likeliest letters of each token, with a space at word edges inside it."""
    return [" ".join(t.replace("\0", "").split()) for t in decoded(tokens, bigrams)]


def lowered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of some byte strings, A-Z in lower case."""
    return textbytes.LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.cumsum([0, *map(len, texts)])


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, hashes of it and of its beginnings: a row for each kind, 0 where it is too short."""
    rows = [textbytes.word_hash(data, starts, ends)]
    for k in STEMS:
        cut = starts + k
        rows.append(np.where(cut < ends, textbytes.mix(textbytes.word_hash(data, starts, np.minimum(cut, ends)) + np.uint64(k)), np.uint64(0)))
    return np.stack(rows)


def compact(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case and white space only."""
    keep = LETTER[data] | textbytes.SPACE[data]
    return textbytes.LOWER[data[keep]], np.r_[0, np.cumsum(keep)][offsets]


#: Latin letters that letters of other scripts look like, and letters without a decomposition.
LOOKS_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɡ": "g", "ɑ": "a", "ƒ": "f",
}
DOUBLE_V = ord("v")


def plain_letters(token: str) -> str:
    """The token in letters of one script: compatible forms decomposed, marks and invisible characters dropped, look-alikes replaced."""
    letters = (c for c in unicodedata.normalize("NFKD", token).lower() if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return "".join(LOOKS_LIKE.get(c, c) for c in letters)


def seen(token: bytes) -> bytes:
    """The token in lower-case letters as it looks, empty if that is no Latin word."""
    out = plain_letters(token.decode(errors="replace")).replace("vv", "w")
    return out.encode() if out.isascii() and out.isalpha() else b""


def look_alikes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """What words with letters outside ASCII, or v twice, look like, where that is a Latin word, and their documents."""
    spot = data >= 128
    spot[:-1] |= (data[:-1] == DOUBLE_V) & (data[1:] == DOUBLE_V)
    marks = np.r_[0, np.cumsum(spot)]
    raw, found, docs = data.tobytes(), [], []
    known: dict[bytes, bytes] = {}
    for i in np.flatnonzero(marks[ends] > marks[starts]).tolist():
        word = raw[starts[i] : ends[i]]
        if word not in known:
            known[word] = seen(word)
        if known[word]:
            found.append(known[word])
            docs.append(int(doc[i]))
    return found, np.array(docs, dtype=np.int64)


def rejoined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, keys: np.ndarray, values: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that a white space parts: hashes of the joined neighbours that have a value while neither of them has and not both are usual words, and their documents."""
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(starts) < 2 or not len(keys):
        return none
    solid = ~textbytes.SPACE[data]
    at = np.r_[0, np.cumsum(solid)]
    first, last, low = at[starts], at[ends], data[solid]
    pair = np.flatnonzero((doc[1:] == doc[:-1]) & (last[1:] - first[:-1] <= JOINED))
    joined = textbytes.word_hash(low, first[pair], last[pair + 1])
    good = look_up(keys, values, joined) > 0
    pair, joined = pair[good], joined[good]
    sides = [look_up(keys, values, word_features(data, starts[pair + k], ends[pair + k])).max(axis=0, initial=0.0) for k in (0, 1)]
    known = [np.isin(textbytes.word_hash(data, starts[pair + k], ends[pair + k]), usual) for k in (0, 1)]
    apart = (sides[0] <= 0) & (sides[1] <= 0) & ~(known[0] & known[1])
    return joined[apart], doc[pair[apart]]


def disguised(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct disguised tokens of each document, and their documents."""
    if not len(data):
        return [], np.zeros(0, dtype=np.int64)
    low = textbytes.LOWER[data]
    starts, ends, doc = textbytes.words(data, offsets)
    letter = LETTER[data]
    spot = np.zeros(len(data), dtype=bool)
    spot[:-2] = letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    spot[:-1] |= letter[1:] & ~letter[:-1] & ~textbytes.SPACE[data[:-1]]
    spot[1:] |= letter[:-1] & (data[1:] >= 48) & (data[1:] < 58)
    marks = np.r_[0, np.cumsum(spot)]
    odd = np.flatnonzero(marks[ends] > marks[starts])
    single = (ends - starts == 1) & SPACED[data[starts]]
    found: dict[tuple[int, str], None] = {}
    raw = data.tobytes()
    for i in odd.tolist():
        t = raw[starts[i] : ends[i]].decode(errors="replace")
        for t in (t,) if t.isascii() else (t, plain_letters(t)):
            if DISGUISED.search(t):
                found[int(doc[i]), t] = None
    # letters spaced out one by one: at least three tokens of one letter, or what may stand for one, in a row
    row = np.flatnonzero(single[:-2] & single[1:-1] & single[2:] & (doc[:-2] == doc[2:])) if len(single) > 2 else np.zeros(0, dtype=np.int64)
    if len(row):
        cuts = np.flatnonzero(np.diff(row) > 1) + 1
        for part in np.split(row, cuts):
            t = " ".join(chr(data[starts[i]]) for i in range(part[0], part[-1] + 3))
            if any(c.isalpha() for c in t):
                found[int(doc[part[0]]), t] = None
    return [t for _, t in found], np.array([d for d, _ in found], dtype=np.int64)


class Restorer:
    """Restores tokens, as decoded() does, and remembers short ones, up to a fixed number."""

    def __init__(self, bigrams: np.ndarray) -> None:
        self.bigrams, self.known = bigrams, {}

    def __call__(self, tokens: list[str]) -> list[str]:
        if len(self.known) > 200_000:
            self.known.clear()
        new = sorted({t for t in tokens if t not in self.known}, key=lambda t: (len(t), t))
        long, at = {}, 0
        while at < len(new):
            to = at + 1
            while to < min(len(new), at + 512) and (to + 1 - at) * len(new[to]) <= CELLS:
                to += 1
            for t, said in zip(new[at:to], decoded(new[at:to], self.bigrams), strict=True):
                (self.known if len(t) <= SHORT else long)[t] = said
            at = to
        return [self.known[t] if t in self.known else long[t] for t in tokens]


def parted(said: list[str], keys: np.ndarray, values: np.ndarray) -> list[list[str]]:
    """The words of each restored token: the likeliest, unless words from one separator to another say more."""
    usual = [t.replace("\0", "").split() for t in said]
    if not len(keys):
        return usual
    several = [i for i, t in enumerate(said) if "\0" in t or " " in t]
    parts = {i: [p for p in re.split("[ \0]+", said[i]) if p] for i in several}
    stretches: dict[int, list[tuple[int, int, str]]] = {}
    for i, own in parts.items():
        stretches[i] = []
        for a in range(len(own)):
            word, b = own[a], a + 1
            stretches[i].append((a, b, word))
            while b < len(own) and len(word) + len(own[b]) <= JOINED:
                word, b = word + own[b], b + 1
                stretches[i].append((a, b, word))
    distinct = sorted({w for x in stretches.values() for _, _, w in x} | {w for i in several for w in usual[i]})
    if not distinct:
        return usual
    data, edges = lowered([w.encode() for w in distinct])
    worth = dict(zip(distinct, look_up(keys, values, word_features(data, edges[:-1], edges[1:])).max(axis=0).tolist(), strict=True))
    for i in several:
        good = [(a, b, w) for a, b, w in stretches[i] if worth[w] > 0]
        if not good:
            continue
        ending: dict[int, list[tuple[int, str]]] = {}
        for a, b, w in good:
            ending.setdefault(b, []).append((a, w))
        most, how = [0.0], [None]
        for b in range(1, len(parts[i]) + 1):
            most.append(most[-1])
            how.append(None)
            for a, w in ending.get(b, []):
                if most[a] + worth[w] > most[b]:
                    most[b], how[b] = most[a] + worth[w], (a, w)
        if most[-1] > sum(worth[w] for w in usual[i]) + 1e-9:
            b, words = len(parts[i]), []
            while b:
                b, word = how[b] or (b - 1, "")
                words.append(word)
            usual[i] = [w for w in reversed(words) if w]
    return usual


def document_words(data: np.ndarray, offsets: np.ndarray, restorer: Restorer, keys: np.ndarray | None = None, values: np.ndarray | None = None, usual: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words of a chunk (a column each), and word and document of each occurrence, restored words included.

    With the features' values, restored tokens are parted by them where they hold several words.
    """
    plain, at = compact(data, offsets)
    starts, ends, doc = textbytes.words(plain, at)
    tokens, token_doc = disguised(data, offsets)
    none = np.zeros(0, dtype=np.uint64)
    keys, values, usual = (none if x is None else x for x in (keys, values, usual))
    words = parted(restorer(tokens), keys, values)
    said, token_doc = [w.encode() for own in words for w in own], np.repeat(token_doc, [len(own) for own in words])
    alike, alike_doc = look_alikes(plain, starts, ends, doc)
    parts, part_doc = rejoined(plain, starts, ends, doc, keys, values, usual)
    more, edges = lowered(said + alike)
    both = np.concatenate([plain, more])
    starts = np.r_[starts, edges[:-1] + len(plain)].astype(np.int64)
    ends = np.r_[ends, edges[1:] + len(plain)].astype(np.int64)
    doc = np.r_[doc, token_doc, alike_doc].astype(np.int64)
    some = ends > starts
    starts, ends, doc = starts[some], ends[some], doc[some]
    _, first, back = np.unique(textbytes.word_hash(both, starts, ends), return_index=True, return_inverse=True)
    features = word_features(both, starts[first], ends[first])
    if len(parts):  # whole words only: their beginnings say nothing
        features = np.concatenate([features, np.concatenate([parts[None], np.zeros((len(STEMS), len(parts)), dtype=np.uint64)])], axis=1)
        back, doc = np.r_[back, np.arange(features.shape[1] - len(parts), features.shape[1])], np.r_[doc, part_doc]
    return features, back, doc


def doc_features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a chunk."""
    features, word, doc = document_words(data, offsets, restorer)
    pair_doc, pair_word = np.unique(np.stack([doc, word]), axis=1) if len(doc) else (doc, word)
    d, f = np.repeat(pair_doc, len(features)), features[:, pair_word].T.ravel()
    d, f = d[f != 0], f[f != 0]
    order = np.lexsort((f, d))
    d, f = d[order], f[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])][: len(d)]
    return d[new], f[new]


def look_up(keys: np.ndarray, values: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The value of each feature, 0 for one that isn't a key; keys are sorted."""
    if not len(keys):
        return np.zeros(features.shape)
    at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
    return np.where(keys[at] == features, values[at], 0.0)


def numbers(data: np.ndarray, offsets: np.ndarray, restorer: Restorer, keys: np.ndarray, values: np.ndarray, usual: np.ndarray | None = None) -> np.ndarray:
    """A row of NUMBERS for each document: its strongest word, strong words, their sum, and both by length."""
    features, word, doc = document_words(data, offsets, restorer, keys, values, usual)
    n = len(offsets) - 1
    out = np.zeros((n, NUMBERS))
    if not len(doc):
        return out
    value = look_up(keys, values, features).max(axis=0)[word]
    length = np.log1p(np.bincount(doc, minlength=n))
    strong = np.flatnonzero(value > 0)
    np.maximum.at(out[:, 0], doc[strong], value[strong])
    out[:, 1] = np.log1p(np.bincount(doc[strong], minlength=n))
    out[:, 2] = np.log1p(np.bincount(doc[strong], weights=value[strong], minlength=n))
    out[:, 3] = out[:, 1] / np.maximum(length, 1)
    out[:, 4] = out[:, 2] / np.maximum(length, 1)
    return out


@dataclass
class Model:
    bigrams: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    usual: np.ndarray  # hashes of usual words
    regression: learning.Logistic


def usual_words(rows: DataFrame) -> np.ndarray:
    """Hashes, in order, of the words in most of these texts: in SUPPORT of them, and USUAL words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in textbytes.chunks(batch, "_text"):
                plain, at = compact(data, offsets)
                starts, ends, doc = textbytes.words(plain, at)
                word, back = np.unique(textbytes.word_hash(plain, starts, ends), return_inverse=True)
                own = np.unique(back * len(at) + doc) // len(at)  # once a text
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(own, minlength=len(word)))], names=["word", "n"])

    counts = rows.mapInArrow(textbytes.trimmed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(counts.filter(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "word").limit(USUAL).select("word").toArrow()["word"].to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = BOUND) -> Model:
    """The model; labels holds only the rows that may be learned from.

    Features are weighed on three of four folds to fit the regression on the fourth, then on all.
    """
    context = docs.sparkSession.sparkContext
    bigrams = letter_bigrams(docs, text)
    rows = learning.joined(docs, learning.sample(labels, doc_id, label, bound), doc_id, text)

    def toxic_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(bigrams)
        for batch in batches:
            for _, data, offsets in textbytes.chunks(batch, "_text"):
                f, n = np.unique(doc_features(data, offsets, restorer)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n)], names=["feature", "n"])

    found = rows.filter("_label = 1").mapInArrow(textbytes.trimmed(toxic_features), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    candidates = np.sort(found.filter(F.col("n") >= SUPPORT).select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    usual = usual_words(rows.filter("_label = 0"))
    sent, known = context.broadcast(candidates), context.broadcast(usual)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, keys = Restorer(bigrams), sent.value
        total = np.zeros((4, max(1, len(keys))), dtype=np.int64)  # label, and whether the fold is the last
        texts = np.zeros(4, dtype=np.int64)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text"):
                kind = part.column("_label").to_numpy() * 2 + (part.column("_fold").to_numpy() == 3)
                texts += np.bincount(kind, minlength=4)
                d, f = doc_features(data, offsets, restorer)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                    hit = keys[at] == f
                    total += np.bincount(kind[d[hit]] * total.shape[1] + at[hit], minlength=total.size).reshape(total.shape)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[cells, -1 - np.arange(4)]), pa.array(np.r_[total.ravel()[cells], texts])], names=["cell", "n"])

    counts = rows.mapInArrow(textbytes.trimmed(counted), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = counts["cell"].to_numpy(), counts["n"].to_numpy()
    total, texts = np.zeros(4 * max(1, len(candidates))), np.zeros(4)
    total[cell[cell >= 0]] = n[cell >= 0]
    texts[-1 - cell[cell < 0]] = n[cell < 0]
    total = total.reshape(4, -1)[:, : len(candidates)]

    def weighed(folds: list[int]) -> np.ndarray:
        clean, toxic = total[folds].sum(axis=0), total[[2 + f for f in folds]].sum(axis=0)
        odds = np.log((toxic + 0.2) / (texts[[2 + f for f in folds]].sum() + 0.4)) - np.log((clean + 0.2) / (texts[folds].sum() + 0.4))
        return np.where((odds > 1.5) & (toxic >= SUPPORT), odds - 1.5, 0.0)

    some, every = weighed([0]), weighed([0, 1])
    part_values = context.broadcast(some)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(bigrams)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text"):
                x = numbers(data, offsets, restorer, sent.value, part_values.value, known.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float64())), part.column("_label")], names=["x", "y"])

    fitted = rows.filter("_fold = 3").mapInArrow(textbytes.trimmed(summed), "x array<double>, y int").toArrow()
    x, y = np.array(fitted["x"].to_pylist(), dtype=np.float64).reshape(-1, NUMBERS), fitted["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # so that the fit doesn't depend on the order in which tasks end
    used = every > 0
    return Model(bigrams, candidates[used], every[used], usual, learning.Logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """The rows with the score as one more column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() != to.lower()]
    schema = T.StructType([*kept, T.StructField(to, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        restorer = Restorer(m.bigrams)
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, text):
                got = m.regression.predict(numbers(data, offsets, restorer, m.keys, m.values, m.usual)).round(10)  # the same in every batch
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(got)], names=schema.names)

    return docs.mapInArrow(textbytes.trimmed(run), schema)
