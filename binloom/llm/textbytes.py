"""Vectorised handling of text as the bytes of Arrow buffers.

A chunk is (data, offsets): the UTF-8 bytes of a few thousand documents end to end,
and where each begins. Nulls count as empty. A span's hash comes from the difference of
two prefix sums of a random value for each byte, times a power of a base. Two such sums
with different bases, modulo the prime 2**31 - 1, make up the 62 bits that tell spans
apart; modulo a power of two, sequences like Thue and Morse's collide whatever the base.
The quick sums, modulo 2**64, only ever choose places (equal spans have equal values);
nothing is taken as equal because of them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: The constants of the splitmix64 generator, the prime and bases of the span hashes, and the odd base of the quick ones.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PRIME, BASES = (1 << 31) - 1, (1_347_683_021, 907_133_923)
BASE = 0xD1342543DE82EF95

#: Values that are summed at a time, so that they stay in the cache.
CACHED = 1 << 14

#: Text bytes that one chunk holds at most (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: each bit of the result depends on all bits of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed))


def residues(x: np.ndarray) -> np.ndarray:
    """Values below 2**63, in place, modulo PRIME."""
    for _ in range(3):
        high = x >> np.uint64(31)
        x &= np.uint64(PRIME)
        x += high
    x[x == PRIME] = 0
    return x


BYTE_VALUES = np.stack([residues(seeded(256, seed) >> np.uint64(1)) for seed in (11, 13)])
QUICK_VALUES = seeded(256, 11)
_powers: dict[object, np.ndarray] = {}


def powers(n: int, which: int, down: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo PRIME."""
    out = _powers.get((which, down), np.ones(1, dtype=np.uint32))
    if len(out) < n:
        base = pow(BASES[which], -1, PRIME) if down else BASES[which]
        while len(out) < max(n, CHUNK_BYTES // 4):
            out = np.concatenate([out, residues(out * np.uint64(pow(base, len(out), PRIME))).astype(np.uint32)])
        _powers[which, down] = out
    return out[:n]


def quick_powers(n: int, down: bool = False) -> np.ndarray:
    """The first n powers of BASE, or of its inverse, modulo 2**64."""
    if len(_powers.get(down, ())) < n:
        full = np.full(max(n, CHUNK_BYTES // 4), pow(BASE, -1, 1 << 64) if down else BASE, dtype=np.uint64)
        full[0] = 1
        _powers[down] = np.multiply.accumulate(full)
    return _powers[down][:n]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a record batch whose text has limit bytes or less, each with its bytes and offsets."""
    data, offsets = joined(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes that are not white space."""
    n = len(data)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    open_, close = solid.copy(), solid.copy()
    open_[1:] &= ~solid[:-1] | edge[1:n]
    close[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(symbols: np.ndarray, values: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Two rows of prefix sums; values gives each block of symbols their values below PRIME for a row."""
    n = len(symbols)
    out = np.zeros((2, n + 1), dtype=np.uint32)
    for k in (0, 1):
        by, carry = powers(n, k), 0
        for at in range(0, n, CACHED):
            x = values(symbols[at : at + CACHED], k) * by[at : at + CACHED]
            high = x >> np.uint64(31)
            x &= np.uint64(PRIME)
            x += high
            x[0] += np.uint64(carry)
            np.cumsum(x, out=x)
            for _ in (0, 1):
                np.right_shift(x, np.uint64(31), out=high)
                x &= np.uint64(PRIME)
                x += high
            out[k, at + 1 : at + 1 + len(x)] = x
            carry = int(x[-1])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """The prefix sums of bytes."""
    return prefix_sums(data, lambda part, k: BYTE_VALUES[k][part])


def span_residues(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits of each span [start, end), the same for equal spans of one length."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in (0, 1):
        x = h[k][ends].astype(np.uint64)
        x += np.uint64(2 * PRIME) - h[k][starts]
        high = x >> np.uint64(31)
        x &= np.uint64(PRIME)
        x += high
        x *= powers(h.shape[1], k, down=True)[starts]
        out = (out << np.uint64(31)) | residues(x)
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), the same wherever equal bytes stand."""
    return mix(span_residues(h, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


#: Bytes of the longest spans that word_hash() reads eight at a time.
SHORT_SPAN = 64


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of short spans such as words, the same wherever equal bytes stand: eight bytes at a time are mixed into the hash of the length; long spans go by their sums."""
    length = ends - starts
    out = mix(length.astype(np.uint64) * np.uint64(GOLDEN))
    if not len(out):
        return out
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    some = np.flatnonzero((length > 0) & (length <= SHORT_SPAN))
    at, left = starts[some], length[some]
    while len(some):
        past = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)  # bits of the next bytes, which don't belong to the span
        out[some] = mix(out[some] ^ ((eight[at] << past) >> past))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(length > SHORT_SPAN)
    if len(long):
        to = np.cumsum(length[long])
        h = prefix_hash(np.concatenate([data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]))
        out[long] = span_hash(h, to - length[long], to)
    return out


def quick_hash(data: np.ndarray, length: int) -> np.ndarray:
    """A value for each span of this length, to choose places by: different spans may well share one."""
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(QUICK_VALUES[data] * quick_powers(len(data)), out=h[1:])
    n = len(data) - length + 1
    return mix((h[length:] - h[:n]) * quick_powers(n, down=True) + np.uint64(length))


def gram_hash(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes."""
    if len(word) < n:
        return np.zeros(0, dtype=np.uint64)
    by = seeded(n, 29) | np.uint64(1)
    total = word[: len(word) - n + 1] * by[0]
    for k in range(1, n):
        total = total + word[k : len(word) - n + 1 + k] * by[k]
    return mix(total)


#: What workers remember from batch to batch, and drop at the end of a task.
CACHES: list[dict] = [_powers]


def release() -> None:
    """Hand memory back to the system: a worker that waits for its next task keeps none of the last one's arrays and caches."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory at the end of its task."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def trimmed_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow, after each group of some size."""

    def inner(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > CHUNK_BYTES // 4:
            release()
        return out

    return inner
