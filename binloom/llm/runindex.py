"""Suffix-array dedup on a run-length index: bytes covered by long strings that stand elsewhere too.

A string of WINDOW bytes has a canonical anchor, the first of its substrings of GRAM bytes
whose hash is least, so equal strings have equal anchors at equal places. Each document is
cut into runs of consecutive windows with one anchor at one place; a run's context is the
text that its windows cover. Equal runs that follow each other (periodic text) are one row.
Runs are grouped by (anchor, context): an anchor that stands once holds no repeat, a
context that stands twice is all repeated, and what is left are anchors with different
contexts. Those contexts go, by anchor, into shards of a bounded size.

A shard's index is the Burrows-Wheeler transform of its distinct contexts in runs, with
the suffix-array entries at both ends of each run. A suffix's longest match elsewhere in
the shard is with its neighbour in suffix order before or after it; between runs that
length is compared directly, inside a run it is one less than for the suffix one byte
earlier. So matching statistics follow from the sampled run ends in one pass over the
text, and windows whose statistic reaches WINDOW are marked.

Anchors with more than GROUP contexts (the edges of a passage that very many documents
share) are not indexed in one shard: their windows are counted by hash, which spreads
them evenly over all tasks. Anchors, contexts and windows are told apart by 64-bit hashes.

The same statistics tell of matches of SHORT bytes or more, down from WINDOW. They are
reported, never removed, and not all: those whose two places have an anchor in common,
which strings of 320 bytes in different surroundings have about four times in five.
Contexts that follow each other overlap by less than WINDOW; so that the same bytes are
not a match of SHORT with themselves, suffixes are compared only if their places differ
(of suffixes that share a long match and stand side by side at different places, one at
least is of each place).

Passages of some number of words can be removed besides: the same index, over texts in which
CODE bytes of its hash stand for each word, finds the strings of so many words that stand
elsewhere, however few bytes they have and whatever white space parts their words. There
words are told apart by 32 bits, so a passage may reach one word too far with a chance of
2^-32 at either end.

Null and empty texts hold no bytes. Texts below WINDOW bytes have no repeats. Rows that
agree in id and text are places of their own that hold the same spans. An empty table
gives no rows. Columns of any name are kept, but for those of the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import textbytes
from binloom.session import discard, written

WINDOW, SHORT, GRAM = 400, 256, 32
#: Bytes that stand for a word where passages are told by words.
CODE = 4
#: Bytes of the contexts of a shard, about; contexts of one anchor that a shard takes at most (its arrays take some 100 bytes for each byte of text).
SHARD_BYTES, GROUP = 1 << 18, 2048
#: Shards of a task, one after the other.
SHARDS = 4


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, context hash, document, start in the document and length of each run of windows, how often it follows itself, and how far that reaches."""
    none = (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 5
    if len(data) < window:
        return none
    h = textbytes.prefix_hash(data)
    low = np.uint64(32)
    hashes = textbytes.quick_hash(data, gram) >> low << low
    hashes |= np.arange(len(hashes), dtype=np.uint64)
    place = window_minima(hashes, window - gram + 1) & np.uint64(2**32 - 1)  # the first of the least
    del hashes
    inside = np.zeros(len(data) - window + 1, dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= window:
            inside[a : b - window + 1] = True
    p = np.flatnonzero(inside)
    if not len(p):
        return none
    place = place[p].astype(np.int64)
    new = np.r_[True, place[1:] != place[:-1]]
    first = np.flatnonzero(new)
    start, end = p[first], p[np.r_[first[1:] - 1, len(p) - 1]] + window
    anchor, ctx, doc = textbytes.span_hash(h, place[first], place[first] + gram), textbytes.span_hash(h, start, end), np.searchsorted(offsets, start, "right") - 1
    row = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[row[1:], len(start)] - 1
    return anchor[row], ctx[row], doc[row], start[row] - offsets[doc[row]], end[row] - start[row], last - row + 1, end[last] - start[row]


class RunIndex:
    """The Burrows-Wheeler transform of some texts in runs, with the suffix-array entries at the runs' ends."""

    def __init__(self, texts: list[bytes]) -> None:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8).astype(np.int64) + len(texts)
        symbols[self.starts + lengths] = np.arange(len(texts))  # each text ends with a symbol of its own
        self.symbols, self.lengths = symbols, lengths
        order = self._suffixes(symbols)
        before = symbols[order - 1]
        cut = np.r_[True, (before[1:] != before[:-1]) | (before[1:] < len(texts))]
        self.run_starts = np.flatnonzero(cut)
        self.heads = before[self.run_starts]
        self.first = order[self.run_starts]
        self.last = order[np.r_[self.run_starts[1:] - 1, len(order) - 1]]

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
        n, bits = len(symbols), int(symbols.max(initial=0) + 1).bit_length()
        depth = max(1, 62 // bits)
        key = symbols + 1
        for k in range(1, depth):
            key = key << bits
            key[: n - k] |= symbols[k:] + 1 if n > k else 0
        tied = np.argsort(key).astype(np.int32)
        sorted_key, base = key[tied], np.zeros(n, dtype=np.int32)
        del key
        rank = np.zeros(n + 1, dtype=np.int32)
        rank[n] = -1
        while True:
            new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
            place = np.flatnonzero(new).astype(np.int32)
            group = np.cumsum(new, dtype=np.int32) - 1
            old = np.r_[True, base[1:] != base[:-1]]  # base: rank of the group that was split
            old_start = np.flatnonzero(old).astype(np.int32)[np.cumsum(old, dtype=np.int32) - 1]
            rank[tied] = base + place[group] - old_start
            size = np.diff(np.r_[place, len(tied)])
            more = size[group] > 1
            tied = tied[more]
            if not len(tied):
                break
            pair = rank[tied].astype(np.int64) * (n + 1) + rank[np.minimum(tied + depth, n)] + 1
            order = np.argsort(pair)
            tied, sorted_key = tied[order], pair[order]
            base = rank[tied]
            depth *= 2
        out = np.empty(n, dtype=np.int32)
        out[rank[:n]] = np.arange(n, dtype=np.int32)
        return out

    def matching_statistics(self, least: int = 1, places: np.ndarray | None = None) -> np.ndarray:
        """For each symbol the longest match of what follows with what follows any other, if it is of length least or more.

        A match inside a run goes back to a longer one at a run's end, so shorter ones can be left out there.
        With the texts' places, neighbours at one place are no match; then the longest at any suffix of a place is that place's.
        """
        n = len(self.symbols)
        left, right = self.last[:-1].astype(np.int64), self.first[1:].astype(np.int64)  # neighbours in suffix order, in different runs
        h = textbytes.prefix_sums(self.symbols, lambda part, k: textbytes.residues(textbytes.mix(part.astype(np.uint64) + np.uint64(k * textbytes.GOLDEN % 2**64)) >> np.uint64(1)))

        def same(x: np.ndarray, y: np.ndarray, length: np.ndarray | int) -> np.ndarray:
            return textbytes.span_residues(h, x, x + length) == textbytes.span_residues(h, y, y + length)

        fits = np.flatnonzero((left + least <= n) & (right + least <= n))
        if places is not None:
            at = np.repeat(places - self.starts.astype(np.uint64), self.lengths + 1) + np.arange(n, dtype=np.uint64)
            fits = fits[at[left[fits]] != at[right[fits]]]
        fits = fits[same(left[fits], right[fits], least)]
        left, right = left[fits], right[fits]
        common, most = np.full(len(left), least, dtype=np.int64), int(self.lengths.max(initial=0)) + 1
        step = 1 << max(0, most.bit_length() - 1)
        while step:
            to = common + step
            fits = np.flatnonzero((left + to <= n) & (right + to <= n))
            fits = fits[same(left[fits], right[fits], to[fits])]
            common[fits] = to[fits]
            step >>= 1
        del h
        reach = np.zeros((2, n), dtype=np.int32)
        reach[0, right] = common + right
        reach[1, left] = common + left
        return np.maximum.accumulate(reach, axis=1).max(axis=0) - np.arange(n, dtype=np.int32)

    def long_matches(self, *windows: int, places: np.ndarray | None = None) -> list[list[list[int]]]:
        """For each length and each text, starts and ends of what windows of this length with a match elsewhere cover."""
        found = self.matching_statistics(min(windows), places)
        return [self._covered(found, w) for w in windows]

    def _covered(self, found: np.ndarray, window: int) -> list[list[int]]:
        hit = found >= window
        room = np.zeros(len(hit), dtype=bool)
        for a, length in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            room[a : a + max(0, length - window + 1)] = True
        hit &= room
        edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
        from_, to = edge[0::2], edge[1::2]  # windows from_ .. to - 1
        text = np.searchsorted(self.starts, from_, "right") - 1
        out: list[list[int]] = [[] for _ in self.lengths]
        for t, a, b in zip(text.tolist(), (from_ - self.starts[text]).tolist(), (to - self.starts[text] + window - 1).tolist(), strict=True):
            out[t] += [a, b]
        return out


def runs(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, ctx, _id, _h, start, length, times and reach of each run, from (_id, _h, _text)."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("ctx", T.LongType()), keyed.schema["_id"], T.StructField("_h", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("times", T.IntegerType()), T.StructField("reach", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text", 1 << 18):
                anchor, ctx, doc, start, length, times, reach = anchored_runs(data, offsets, window, gram)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), part.column("_id").take(at), part.column("_h").take(at), *(pa.array(x.astype(np.int32)) for x in (start, length, times, reach))], names=schema.names)

    return keyed.mapInArrow(textbytes.trimmed(run), schema)


def word_codes(keyed: DataFrame) -> DataFrame:
    """(_id, _h, _text) with CODE bytes of each word's hash, one after the other, for the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text"):
                starts, ends, doc = textbytes.words(data, offsets)
                codes = textbytes.word_hash(data, starts, ends).astype("<u4")  # the low bits
                at = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32) * np.int32(CODE)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_h"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at), pa.py_buffer(codes)])], names=["_id", "_h", "_text"])

    return keyed.select("_id", "_h", "_text").mapInArrow(textbytes.trimmed(run), T.StructType([keyed.schema["_id"], T.StructField("_h", T.LongType()), T.StructField("_text", T.BinaryType())]))


def document() -> Column:
    """The key of a document, from (_id, _h): structs with null ids are equal, so one shuffle serves grouping and joining."""
    return F.struct("_id", "_h").alias("_key")


def contexts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, ctx, several, contexts (of the anchor), place (of a document's byte) and the bytes of each wanted context."""
    by_doc = wanted.groupBy(document()).agg(F.collect_list(F.struct("anchor", "ctx", "several", "contexts", "start", "length")).alias("parts"))
    rows = keyed.select(document(), "_text").join(by_doc, "_key").dropDuplicates(["_key"]).select("_text", "parts", F.xxhash64("_key._id", "_key._h").alias("own"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "_text"):
                lists = part.column("parts")
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start = flat.field("start").to_numpy() + offsets[doc]
                end = start + flat.field("length").to_numpy()
                raw = data.tobytes()
                found = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                place = part.column("own").to_numpy()[doc] + flat.field("start").to_numpy()
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("ctx"), flat.field("several"), flat.field("contexts"), pa.array(place), pa.array(found, type=pa.binary())], names=["anchor", "ctx", "several", "contexts", "place", "bytes"])

    return rows.mapInArrow(textbytes.trimmed(run), "anchor long, ctx long, several boolean, contexts long, place long, bytes binary")


def indexed_matches(found: DataFrame, window: int, short: int, shard_bytes: int, owner: str) -> DataFrame:
    """anchor, ctx, spans and short_spans within the context, for contexts that stand once and hold repeats."""
    total = found.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("ctx", "ascending")])
        long_, short_ = RunIndex(table["bytes"].to_pylist()).long_matches(window, short, places=table["place"].to_numpy().view(np.uint64))
        once = [not s and bool(x) for s, x in zip(table["several"].to_pylist(), short_, strict=True)]
        lists = pa.list_(pa.int32())
        return pa.table([table["anchor"], table["ctx"], pa.array(long_, type=lists), pa.array(short_, type=lists)], names=["anchor", "ctx", "spans", "short_spans"]).filter(pa.array(once))

    rows = found.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(int(min(-(-shards // SHARDS), 1 << 16)), "shard")
    return rows.groupBy("shard").applyInArrow(textbytes.trimmed_group(run), "anchor long, ctx long, spans array<int>, short_spans array<int>")


def counted_matches(found: DataFrame, window: int) -> DataFrame:
    """anchor, ctx and spans for anchors with very many contexts: each window is counted by its hash.

    What stands at two places within a chunk is marked there. Only the other windows are sought by
    their hash, and what very many contexts share is one row of each chunk, not one of each context.
    """
    schema = pa.schema([("window", pa.int64()), ("told", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64()), ("any", pa.bool_()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def rows_of(n: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def spans_of(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array((2 * offsets).astype(np.int32)), pa.array(np.stack([starts, ends], axis=1).astype(np.int32).ravel()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "bytes", 1 << 18):
                anchor, ctx, several = part.column("anchor").to_numpy(), part.column("ctx").to_numpy(), part.column("several").to_numpy(zero_copy_only=False)
                h = textbytes.prefix_hash(data)
                room = np.maximum(np.diff(offsets) - window + 1, 0)
                row = np.repeat(np.arange(part.num_rows), room)
                if not len(row):
                    continue
                at = np.arange(len(row)) - np.repeat(np.cumsum(room) - room, room)
                start, place = offsets[row] + at, part.column("place").to_numpy()[row] + at
                hashes = textbytes.span_hash(h, start, start + window).view(np.int64)
                order = np.argsort(hashes)
                first = np.flatnonzero(np.r_[True, hashes[order[1:]] != hashes[order[:-1]]])
                lo, hi, any_ = (f.reduceat(x[order], first) for f, x in ((np.minimum, place), (np.maximum, place), (np.logical_or, several[row])))
                again = (lo != hi) | any_
                hit = np.empty(len(row), dtype=bool)
                hit[order] = np.repeat(again, np.diff(np.r_[first, len(row)]))
                n = int(again.sum())
                yield rows_of(n, window=hashes[order[first[again]]], told=np.zeros(n, dtype=bool), lo=lo[again], hi=hi[again], any=any_[again])
                k = np.flatnonzero(~hit)
                yield rows_of(len(k), window=hashes[k], told=np.zeros(len(k), dtype=bool), lo=place[k], hi=place[k], any=np.zeros(len(k), dtype=bool), anchor=anchor[row[k]], ctx=ctx[row[k]], spans=spans_of(at[k], at[k] + window, np.arange(len(k) + 1)))
                hit &= ~several[row]
                new = np.r_[True, row[1:] != row[:-1]]
                from_, to = np.flatnonzero(hit & (new | ~np.r_[False, hit[:-1]])), np.flatnonzero(hit & np.r_[new[1:] | ~hit[1:], True])
                k, begin = np.unique(row[from_], return_index=True)
                yield rows_of(len(k), window=ctx[k], told=np.ones(len(k), dtype=bool), anchor=anchor[k], ctx=ctx[k], spans=spans_of(at[from_], at[to] + window, np.r_[begin, len(from_)]))

    rows = found.mapInArrow(textbytes.trimmed(run), "window long, told boolean, lo long, hi long, any boolean, anchor long, ctx long, spans array<int>")
    same = Window.partitionBy("window", "told")
    again = F.col("told") | (F.min("lo").over(same) != F.max("hi").over(same)) | F.max("any").over(same)
    return rows.withColumn("again", again).filter("again and anchor is not null").groupBy("anchor", "ctx").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def marked(keyed: DataFrame, window: int, short: int, gram: int, shard_bytes: int, group: int, owner: str) -> DataFrame:
    """_key of a document and mark (start of a run in it, spans and short_spans from there), from (_id, _h, _text)."""
    anchor = Window.partitionBy("anchor")
    every = written(runs(keyed, window, gram).withColumn("places", F.sum("times").over(anchor)).filter("places > 1").drop("places"), owner)
    pairs = every.groupBy("anchor", "ctx").agg(F.sum("times").alias("n"), F.min(F.struct("_id", "_h", "start", "length")).alias("x"))
    kept = written(pairs.select("anchor", "ctx", (F.col("n") > 1).alias("several"), F.count("*").over(anchor).alias("contexts"), "x.*"), owner)
    found = written(contexts(keyed, kept.filter("contexts > 1")), owner)
    none = F.lit(None).cast("array<int>")
    marks = indexed_matches(found.filter(F.col("contexts") <= group), window, short, shard_bytes, owner)
    crowded = found.filter(F.col("contexts") > group)
    marks = marks.unionByName(counted_matches(crowded, window).withColumn("short_spans", F.col("spans")))
    if short < window:
        marks = marks.unionByName(counted_matches(crowded, short).select("anchor", "ctx", F.array().cast("array<int>").alias("spans"), F.col("spans").alias("short_spans")))
    marks = marks.unionByName(kept.filter("several").select("anchor", "ctx", none.alias("spans"), none.alias("short_spans")))
    marks = written(marks, owner)
    discard(kept, found)
    whole = F.array(F.lit(0), F.col("reach"))
    return every.join(marks, ["anchor", "ctx"]).select(document(), F.struct("start", F.coalesce("spans", whole).alias("spans"), F.coalesce("short_spans", whole).alias("short_spans")).alias("mark"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, short: int = SHORT, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group: int = GROUP, owner: str = "query", words: int = 0) -> DataFrame:
    """The rows with n_bytes, spans (maximal removed byte ranges), kept (the other bytes) and shared (maximal ranges of matches seen of at least short bytes) as more columns.

    With words, passages of so many words that stand elsewhere too are removed as well, and shared. Columns of those names are replaced.
    """
    short = min(short, window)
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(data).alias("_h"), data.alias("_text"))
    found = marked(keyed, window, short, gram, shard_bytes, group, owner)
    lists = [F.collect_set("mark").alias("marks")]
    if words:
        passages = marked(word_codes(keyed), words * CODE, words * CODE, min(gram, words * CODE), shard_bytes, group, owner)
        found = found.withColumn("passage", F.lit(None).cast(found.schema["mark"].dataType)).unionByName(passages.select("_key", F.lit(None).cast(found.schema["mark"].dataType).alias("mark"), F.col("mark").alias("passage")))
        lists.append(F.collect_set("passage").alias("passages"))
    spans = found.groupBy("_key").agg(*lists)

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("shared", span)]
    fields = [f for f in docs.schema.fields if f.name.lower() not in {n.name for n in new}]
    carried = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]  # names of our own, whatever the table's are
    own = F.struct(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(data).alias("_h")).alias("_key")
    here = next((f"c{i}" for i, f in enumerate(fields) if f.name.lower() == text.lower()), None)
    rows = docs.select(*carried, own, *([] if here else [F.col(f"`{text}`").alias("own_text")])).join(spans, "_key", "left")
    rows = rows.withColumn("data", F.coalesce(F.col(here or "own_text"), F.lit("")).cast("binary"))  # after the shuffle, which moves a text once

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "data", 1 << 19):
                base = offsets[:-1] + np.arange(part.num_rows)  # a place for each document's end
                marks = part.column("marks").to_pylist()
                more = passage_turns(part.column("passages").to_pylist(), data, offsets) if words else 0
                gone, gone_spans = marked_spans(turns(marks, "spans", base, len(data) + part.num_rows) + more, base)
                _, shared = marked_spans(turns(marks, "short_spans", base, len(data) + part.num_rows) + more, base)
                inside = np.ones(len(gone), dtype=bool)
                inside[base + np.diff(offsets)] = False
                left = ~gone[inside]
                raw = data[left].tobytes()
                ends = np.r_[0, np.cumsum(left)][offsets]
                kept_bytes = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(f"c{i}") for i in range(len(fields))] + [pa.array(np.diff(offsets)), gone_spans, kept_bytes, shared], names=[f.name for f in fields + new])

    return rows.select(*[f"c{i}" for i in range(len(fields))], "data", "marks", *["passages"][: bool(words)]).mapInArrow(textbytes.trimmed(run), T.StructType([*fields, *new]))


def turns(marks: list, name: str, base: np.ndarray, size: int) -> np.ndarray:
    """At each of size places, and one more, how many marked spans of the documents, beginning at base, start there, less those that end."""
    turn = np.zeros(size + 1, dtype=np.int32)
    for b, own in zip(base.tolist(), marks, strict=True):
        for m in own or []:
            at = np.array(m[name], dtype=np.int64) + (b + m["start"])
            np.add.at(turn, at[0::2], 1)
            np.add.at(turn, at[1::2], -1)
    return turn


def passage_turns(marks: list, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The turns of texts for marks in the codes of their words: a passage goes from its first whole word to its last."""
    turn = np.zeros(len(data) + len(offsets), dtype=np.int32)
    if not any(marks):
        return turn
    starts, ends, doc = textbytes.words(data, offsets)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    base = first[:-1] * CODE + np.arange(len(marks))
    _, spans = marked_spans(turns(marks, "spans", base, len(starts) * CODE + len(marks)), base)
    own = np.repeat(np.arange(len(marks)), np.diff(spans.offsets.to_numpy()))
    a, b = -(-spans.flatten().field("start").to_numpy() // CODE) + first[own], spans.flatten().field("end").to_numpy() // CODE + first[own]
    own, a, b = own[a < b], a[a < b], b[a < b]
    np.add.at(turn, starts[a] + own, 1)
    np.add.at(turn, ends[b - 1] + own, -1)
    return turn


def marked_spans(turn: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """A flag for each place, and for each document, beginning at base, the maximal runs of flagged ones."""
    gone = np.cumsum(turn[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    from_, to = edge[0::2], edge[1::2]
    doc = np.searchsorted(base, from_, "right") - 1
    return gone, pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(base) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(from_ - base[doc]), pa.array(to - base[doc])], names=["start", "end"]))


#: The same digests in DuckDB's SQL: every window's hash is counted.
ORACLE = """
with docs as (select doc_id, encode(coalesce(text, '')) as t from documents),
starts as (select doc_id, t, unnest(range(octet_length(t) - 399)) as i from docs where octet_length(t) >= 400),
windows as (select doc_id, i, hash(t[i + 1:i + 400]) as w from starts),
again as (select doc_id, i from windows where w in (select w from windows group by w having count(*) > 1)),
marked as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as fresh from again),
numbered as (select *, sum(fresh) over (partition by doc_id order by i) as span from marked),
spans as (select doc_id, min(i) as a, max(i) + 400 as b from numbered group by doc_id, span),
pieces as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as f, a as e from spans
  union all select s.doc_id, max(b), max(octet_length(t)) from spans s join docs d on d.doc_id = s.doc_id group by 1),
kept as (select p.doc_id, list_reduce(list(t[f + 1:e] order by f), lambda x, y: x || y) as k from pieces p join docs d on d.doc_id = p.doc_id group by 1),
sums as (select doc_id, sum(b - a) as removed, count(*) as n from spans group by 1)
select d.doc_id, cast(octet_length(t) as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans, sha256(coalesce(k, t)) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id left join sums s on s.doc_id = d.doc_id
"""
