"""Media columns: telephony audio.

store() keeps bytes as the samples of a telephony WAV file: 8-bit mu-law, 8-bit A-law, or
IMA ADPCM, whose unit is the 4-bit code. read() takes the codes back out of the stored
file, decodes them to 16-bit PCM and resamples that to twice the rate. Mu-law and A-law
expand by a lookup table; ADPCM is decoded for all blocks of a batch at once, one code of
every block in each step. The resampled PCM is stored in its turn, as a WAV file of
16-bit samples in the column pcm, out of which pcm_samples() takes them.

Resampling keeps each sample and sets a band-limited one between it and the next: a
half-band filter of TAPS samples on either side, in whole numbers, so that it gives the
same bytes everywhere. Before its first and after its last sample a recording stays as it is there.

Nothing is lost: the codes read back are the payload. Null and empty texts become one
unit of zero bytes, and equal texts equal files, repeated rows too. A stored file that
isn't one of these (null, cut, other tag) gives null for everything read from it. Columns
named as a result's are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import textbytes

RATE, UNIT = 8000, 64
#: Format tags of WAV files.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
NAMES = {tag: name for name, tag in TAGS.items()}
#: Step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: A block: first sample, step index, a reserved byte, then UNIT bytes of two codes each.
BLOCK = 4 + UNIT


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 85
    low, part = (code & 15).astype(np.int32) << 4, ((code >> 4) & 7).astype(np.int32)
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks: a row of samples for each row of BLOCK bytes, all blocks together."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * codes.shape[0], len(blocks)), dtype=np.int16)
    for k in range(len(out)):
        code = (codes[k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + CHANGES[code & 7], 0, len(STEPS) - 1)
        out[k] = value
    return np.ascontiguousarray(out.T)


#: Samples on either side of a new one that it is made from, and the unit of their weights.
TAPS, UNITY = 8, 1 << 13


def half_band() -> np.ndarray:
    """The weights of the nearest, next, ... samples on one side: a sinc under a Hann window, rounded so that both sides sum to UNITY."""
    away = np.arange(TAPS) + 0.5
    weights = np.sinc(away) * np.cos(np.pi * away / (2 * TAPS)) ** 2
    out = np.rint(weights / weights.sum() * (UNITY // 2)).astype(np.int32)
    out[0] += UNITY // 2 - out.sum()
    return out


HALF_BAND = half_band()


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice as many samples: each, and the band-limited one between it and the next."""
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[0::2] = pcm
    if len(pcm):
        n, wide = len(pcm), np.pad(pcm.astype(np.int32), TAPS, mode="edge")
        total = np.full(n, UNITY // 2, dtype=np.int32)
        for k, w in enumerate(HALF_BAND.tolist()):
            total += w * (wide[TAPS - k : TAPS - k + n] + wide[TAPS + 1 + k : TAPS + 1 + k + n])
        total //= UNITY
        out[1::2] = np.clip(total, -32768, 32767, out=total)
    return out


def wav(name: str, payload: bytes) -> bytes:
    """A WAV file whose samples are the payload's bytes, a multiple of UNIT of them."""
    if name == "adpcm":
        data = np.zeros((len(payload) // UNIT, BLOCK), dtype=np.uint8)
        data[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
        body, align, bits, more = data.tobytes(), BLOCK, 4, struct.pack("<HH", 2, 2 * UNIT)
        rate = RATE * BLOCK // (2 * UNIT)
    else:
        body, align, bits, more, rate = payload, 1, 8, struct.pack("<H", 0), RATE
    fmt = struct.pack("<HHIIHH", TAGS[name], 1, RATE, rate, align, bits) + more
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(body)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body


def pcm_wav(pcm: bytes) -> bytes:
    """A WAV file of 16-bit samples at twice the rate."""
    fmt = struct.pack("<HHIIHH", 1, 1, 2 * RATE, 4 * RATE, 2, 16)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(pcm)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm


def opened(media: bytes | None) -> tuple[str, np.ndarray] | None:
    """Format and body of a stored file, None if it isn't one."""
    if not media or len(media) < 28 or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        return None
    long = struct.unpack_from("<I", media, 16)[0]
    name = NAMES.get(struct.unpack_from("<H", media, 20)[0])
    if name is None or media[20 + long : 24 + long] != b"data":
        return None
    size = struct.unpack_from("<I", media, 24 + long)[0]
    body = np.frombuffer(media, dtype=np.uint8)[28 + long : 28 + long + size]
    return (name, body) if len(body) == size and size % (BLOCK if name == "adpcm" else UNIT) == 0 else None


def features(name: str, pcm: np.ndarray, double: np.ndarray) -> str:
    """Whole numbers only, so that they are the same everywhere."""
    level = np.abs(pcm.astype(np.int32))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{name};rate={2 * RATE};samples={len(double)};level={int(level.sum()) // max(1, len(pcm))};peak={int(level.max(initial=0))};turns={turns};pcm={zlib.crc32(double.tobytes()):08x}"


def payload(text: Column) -> Column:
    """UTF-8 bytes and as many bytes 0 as make them a positive multiple of UNIT."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    to = F.greatest(F.ceil(F.length(data) / UNIT), F.lit(1)) * UNIT
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (to - F.length(data)).cast("int"))))


def store(rows: DataFrame, column: str, to: str = "media") -> DataFrame:
    """The rows with one more column: the stored file of a binary column of whole units.

    The format follows the checksum of the bytes. A null stays null.
    """
    kept = [f for f in rows.schema.fields if f.name.lower() != to.lower()]
    schema = T.StructType([*kept, T.StructField(to, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(TAGS)
        for batch in batches:
            for part, _, _ in textbytes.chunks(batch, column):
                made = [None if v is None else wav(names[zlib.crc32(v) % 3], v) for v in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(made, type=pa.binary())], names=schema.names)

    return rows.mapInArrow(textbytes.trimmed(run), schema)


def read(rows: DataFrame, media: str = "media", with_pcm: bool = False) -> DataFrame:
    """The rows with what their stored files hold: codes, feature and, if asked for, pcm, a stored file of the resampled samples."""
    new = [T.StructField("codes", T.BinaryType()), T.StructField("feature", T.StringType())] + [T.StructField("pcm", T.BinaryType())] * with_pcm
    kept = [f for f in rows.schema.fields if f.name.lower() not in {n.name for n in new}]
    schema = T.StructType([*kept, *new])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in textbytes.chunks(batch, media, limit=1 << 18):
                files = [opened(v) for v in part.column(media).to_pylist()]
                packed = [f[1].reshape(-1, BLOCK) for f in files if f and f[0] == "adpcm"]
                samples = adpcm(np.concatenate(packed)) if packed else np.zeros((0, 2 * UNIT), dtype=np.int16)
                at, found = 0, []
                for f in files:
                    if f is None:
                        found.append((None,) * 3)
                        continue
                    name, body = f
                    if name == "adpcm":
                        n = len(body) // BLOCK
                        pcm, codes = samples[at : at + n].ravel(), body.reshape(-1, BLOCK)[:, 4:].tobytes()
                        at += n
                    else:
                        pcm, codes = TABLES[name][body], body.tobytes()
                    double = resampled(pcm)
                    found.append((codes, features(name, pcm, double), pcm_wav(double.tobytes()) if with_pcm else None))
                columns = [pa.array([x[k] for x in found], type=kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + columns[: len(new)], names=schema.names)

    return rows.mapInArrow(textbytes.trimmed(run), schema)


#: Bytes before the samples of a stored PCM file.
PCM_HEAD = 44


def pcm_samples(stored: Column) -> Column:
    """The samples of a stored PCM file, as little-endian bytes; null if it isn't whole."""
    size = F.conv(F.concat(*[F.hex(F.substring(stored, at, 1)) for at in (44, 43, 42, 41)]), 16, 10).cast("long")  # little-endian
    whole = (F.substring(stored, 9, 8) == F.lit(b"WAVEfmt ")) & (F.substring(stored, 37, 4) == F.lit(b"data")) & (size == F.length(stored) - PCM_HEAD)
    return F.when(whole, F.substring(stored, PCM_HEAD + 1, 1 << 30))


#: The padded bytes of each text in DuckDB's SQL.
ORACLE = f"""
with docs as (select doc_id, encode(coalesce(text, '')) as t from documents),
sized as (select *, greatest((octet_length(t) + {UNIT - 1}) // {UNIT}, 1) * {UNIT} as size from docs),
padded as (select doc_id, octet_length(t) as n, t || from_hex(repeat('00', cast(size - octet_length(t) as bigint))) as p from sized)
select doc_id, cast(n as bigint) as n_bytes, cast(octet_length(p) as bigint) as payload_bytes, sha256(p) as payload_sha256 from padded
"""
