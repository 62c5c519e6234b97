"""Byte-level BPE encoding and decoding.

Texts are split into units (a run of visible characters with at most one space before
it, or white space), units into the matches of the tokenizer's pattern, and each distinct
match is encoded once: its bytes become a row of a padded numpy matrix in the bucket of
its length. In each round every row merges its leftmost pair of least rank and is
compacted by one column. Pair ranks come from an open-addressing hash table; they are
kept beside the ids and only the two pairs next to a merge are looked up again.

A unit ends only before white space, and no match of the pattern goes from a visible
character over to white space, so splitting units one by one gives the text's matches.
Matches of over LONGEST bytes would make rounds quadratic: those take the same merges
from a heap ordered by (rank, position).

Nulls and empty texts have no ids. Ids and decoded texts are binary columns: ids as
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from binloom.llm import textbytes

#: The characters of Unicode's White_Space property.
WHITE = r"\t-\r \x85\xa0  -     　"
UNIT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Rank of a pair that never merges, and the id of a cell that holds nothing.
NEVER, NOTHING = np.int32(2**31 - 1), np.int32(-1)
#: Bucket edges in bytes. Longer matches use the heap.
BUCKETS = (4, 8, 16, 32, 64, 128)
LONGEST = BUCKETS[-1]
#: Cells of one matrix, distinct units that a worker remembers, and text bytes that it encodes at a time.
CELLS, REMEMBERED, AT_ONCE = 1 << 18, 250_000, 1 << 18


class Vocabulary:
    """Ids of tokens by their bytes, and the rank of each pair that merges in a hash table."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        """ranks: the content of a rank file, a line for each token: its bytes in base64, and its rank."""
        by_bytes = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.by_bytes, self.pattern = by_bytes, regex.compile(pattern)
        self.byte_ids = np.array([by_bytes[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in by_bytes.items():
            for cut in range(1, len(token)):
                left, right = by_bytes.get(token[:cut]), by_bytes.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = pairs
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NEVER, dtype=np.int32)
        new = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        rank, slot = np.array(list(pairs.values()), dtype=np.int32), self._slot(np.array([(a << 32) | b for a, b in pairs], dtype=np.int64))
        while len(new):
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = new[put], rank[put]
            left = self.keys[slot] != new
            new, rank, slot = new[left], rank[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(textbytes.GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER where the pair doesn't merge or a cell holds nothing."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, NEVER, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.ravel()[at]
        slot, flat = self._slot(key), out.ravel()
        while len(at):
            found = self.keys[slot]
            hit = found == key
            flat[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as bytes, of pieces of at most width bytes."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.full((len(pieces), width), NOTHING, dtype=np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pair = np.full((len(pieces), width), NEVER, dtype=np.int32)
        pair[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        rows = np.arange(len(pieces))  # those still merging
        done = ids
        while len(rows):
            at = pair.argmin(axis=1)  # the leftmost of the least
            rank = pair[np.arange(len(rows)), at]
            more = rank != NEVER
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, pair, at, rank = rows[more], ids[more], pair[more], at[more], rank[more]
                if not len(rows):
                    break
            # close the gap that each merge leaves
            shift = column[None, :] > at[:, None]
            ids[:, :-1] = np.where(shift[:, :-1], ids[:, 1:], ids[:, :-1])
            pair[:, :-1] = np.where(shift[:, :-1], pair[:, 1:], pair[:, :-1])
            ids[:, -1], pair[:, -1] = NOTHING, NEVER
            k = np.arange(len(rows))
            ids[k, at] = rank
            after = np.where(at + 1 < width, ids[k, np.minimum(at + 1, width - 1)], NOTHING)
            pair[k, at] = self.pair_ranks(rank, after)
            has = at > 0
            pair[k[has], at[has] - 1] = self.pair_ranks(ids[k[has], at[has] - 1], rank[has])
        count = (done != NOTHING).sum(axis=1)
        flat = done[done != NOTHING].astype("<u4").tobytes()
        ends = np.cumsum(count) * 4
        return [flat[e - 4 * c : e] for e, c in zip(ends.tolist(), count.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: linked cells, and a heap of pairs by rank, then position."""
        ids, n = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of((rank, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if (h := before[i]) >= 0 and (r := rank_of((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of each piece; pieces are the matches of the pattern."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        below = 0
        for width in BUCKETS:
            chosen = np.flatnonzero((lengths > below) & (lengths <= width))
            for at in range(0, len(chosen), CELLS // width):
                some = chosen[at : at + CELLS // width].tolist()
                for i, ids in zip(some, self.merge_rows([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
            below = width
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            out[i] = self.merge_long(pieces[i])
        return out


class Encoder:
    """Encodes texts and remembers units, up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [UNIT.findall(t or "") for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({u for units in split for u in units if u not in known})
        pattern = self.vocabulary.pattern
        matches = [pattern.findall(u) for u in new]
        distinct = list(dict.fromkeys(m for found in matches for m in found))
        ids = dict(zip(distinct, self.vocabulary.encode_pieces([m.encode() for m in distinct]), strict=True))
        known.update((u, b"".join(map(ids.__getitem__, found))) for u, found in zip(new, matches, strict=True))
        return [b"".join(map(known.__getitem__, units)) for units in split]


def token_bytes(ranks: bytes) -> list[bytes]:
    """The bytes of each id, all that decoding needs."""
    return _by_rank({base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)})


def _by_rank(by_bytes: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(by_bytes.values()) + 1)
    for token, rank in by_bytes.items():
        out[rank] = token
    return out


def decoded(ids: bytes | None, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


_loaded: dict[tuple[int, str], Encoder] = {}
textbytes.CACHES.append(_loaded)


def loaded(ranks: bytes, pattern: str) -> Encoder:
    """A worker's encoder of this vocabulary."""
    key = hash(ranks), pattern
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(ranks, pattern))
    return _loaded[key]


def _mapped(df: DataFrame, column: str, to: dict[str, str], tokenizer: str, pattern: str) -> DataFrame:
    """to: the names of the new columns, "ids" of the texts in the column, what is "decoded" from them (without "ids", from the column), or both."""
    with open(tokenizer, "rb") as f:  # here on the driver: executors need no such file
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    taken = {name.lower() for name in to.values()}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *[T.StructField(name, T.BinaryType()) for name in to.values()]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(ranks.value, pattern) if "ids" in to else None
        if "decoded" in to:
            tokens = _by_rank(encoder.vocabulary.by_bytes) if encoder else token_bytes(ranks.value)
        for batch in batches:
            for part, _, _ in textbytes.chunks(batch, column, AT_ONCE):
                ids = part.column(column).to_pylist()
                if encoder:
                    ids = encoder.encode(ids)
                made = [pa.array(ids if what == "ids" else [decoded(v, tokens) for v in ids], type=pa.binary()) for what in to]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + made, names=schema.names)

    return df.select(*[f"`{f.name}`" for f in kept] if column.lower() not in taken else "*").mapInArrow(textbytes.trimmed(run), schema)


def encode(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """The rows with one more column: the ids of the text. A column of that name is replaced."""
    return _mapped(docs, text, {"ids": to}, tokenizer, pattern)


def decode(rows: DataFrame, tokenizer: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with one more column: the bytes that the ids stand for. A column of that name is replaced."""
    return _mapped(rows, ids, {"decoded": to}, tokenizer, pattern)


def encode_decode(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with two more columns, the ids of the text and the bytes decoded from them: decode() of encode() by one Python worker a task, not two."""
    return _mapped(docs, text, {"ids": ids, "decoded": to}, tokenizer, pattern)
