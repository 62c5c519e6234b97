"""Substring dedup by paragraphs: MinHash banding, verification, removal by components.

A paragraph is a stretch of words that the words themselves delimit, whatever the lines and
marks: a text is cut before each word whose value, drawn from it and the next word, is the
least among the NEAR words on either side. So paragraphs have more than NEAR words, 20 on
average, unless the text has fewer, and a passage copied into another text is cut there at
the same words, but for NEAR + 1 at its ends: it brings whole paragraphs with it wherever
it stands. Every word is in a paragraph, and every paragraph counts.

Paragraphs that share no shingle of their prefix with another have their like nowhere and
leave first. The others are grouped by the similarity of their word shingles; of each group the one with
the least (id, number) stays and the others are removed from their documents.

BANDING has two rows a band: random paragraphs share almost no shingles, so selective
bands aren't needed, and of pairs at the least similarity one in 28,000 shares no bucket.

Null texts have no paragraphs and stay null, a text without words is one paragraph, which is like no other. Equal
rows are one document: what is removed is removed from each; rows that share only their id
are documents of their own. Rows without id are left alone. Columns named as a result's are replaced, others are kept whatever their name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import minhash, textbytes
from binloom.session import discard, written

BANDING = minhash.Banding(words=5, percent=80, bands=10, rows=2)
#: Words on either side among which a paragraph's first word has the least value; fixed values: what a word's and the next one's sum of bytes, each times its place, are multiplied by, and the modulus.
NEAR, FACTORS, MODULUS = 9, (7919, 104_729), 1_000_003
#: Words whose bytes are summed at a time.
SUMMED = 1 << 13


def byte_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word the sum of its bytes in lower case, each times its place in the word, modulo MODULUS."""
    out = np.zeros(len(starts), dtype=np.int64)
    for at in range(0, len(starts), SUMMED):
        s, e = starts[at : at + SUMMED], ends[at : at + SUMMED]
        part = textbytes.LOWER[data[s[0] : e[-1]]].astype(np.int64)
        plain = np.r_[0, np.cumsum(part)]
        part *= np.arange(len(part))
        placed = np.r_[0, np.cumsum(part)]
        s, e = s - s[0], e - s[0]
        out[at : at + SUMMED] = (placed[e] - placed[s] - (s - 1) * (plain[e] - plain[s])) % MODULUS
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where paragraphs begin that another precedes in the same text, and where all words begin."""
    starts, ends, doc = textbytes.words(data, offsets)
    n = len(starts)
    if not n:
        return starts, starts
    own = byte_sums(data, starts, ends)
    after = np.zeros(n, dtype=np.int64)
    after[:-1] = np.where(doc[1:] == doc[:-1], own[1:], 0)
    value = ((own * FACTORS[0] + after * FACTORS[1]) % MODULUS).astype(np.int32)
    if n <= 2 * NEAR:
        return starts[:0], starts
    count = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(n) - (np.cumsum(count) - count)[doc]
    inner = np.flatnonzero((place > NEAR) & (place < count[doc] - NEAR))  # both sides are of the same text
    least, span = value, 1  # of each stretch of span words
    while 2 * span <= NEAR:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: n - NEAR + 1], least[NEAR - span :])
    inner = inner[(value[inner] < least[inner - NEAR]) & (value[inner] <= least[inner + 1])]
    return starts[inner], starts


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of all paragraphs with bytes, end to end, of each its document, its number there and its words, and where those begin that another precedes."""
    cut, starts = cuts(data, offsets)
    bounds = np.unique(np.concatenate([offsets, cut]))
    doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
    number = np.searchsorted(cut, bounds[:-1], "right") - np.searchsorted(cut, offsets[doc], "right")
    return bounds, doc, number, np.diff(np.searchsorted(starts, bounds)), cut


def prefixes(data: np.ndarray, bounds: np.ndarray, banding: minhash.Banding) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles in each paragraph's prefix, end to end, and of each its paragraph: of n distinct ones the least n - (least overlap) + 1."""
    gram, at = minhash.shingles(data, bounds, banding)
    n = np.diff(at)
    unit = np.repeat(np.arange(len(n)), n)
    keep = np.arange(len(unit)) - at[unit] < (n - -(-banding.percent * n // 100) + 1)[unit]
    return gram[keep], unit[keep]


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, version (the hash of the whole text) and text of the documents that can have paragraphs."""
    whole = F.col(f"`{text}`")
    return docs.filter(F.col(f"`{doc_id}`").isNotNull() & whole.isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("version"), whole.alias("text"))


def likely(docs: DataFrame, doc_id: str, text: str, banding: minhash.Banding, owner: str) -> DataFrame:
    """doc_id, version and numbers of the paragraphs that share a shingle of their prefix with another.

    A prefix is the least few of a set's hashes: as many as two sets can't both lack of each other if they are similar
    enough, so a paragraph that is left out here has its like nowhere.
    """
    rows = named(docs, doc_id, text)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["version"], T.StructField("number", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "text"):
                bounds, doc, number, _, _ = pieces(data, offsets)
                gram, unit = prefixes(data, bounds, banding)
                some = np.unique(unit)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(unit, some), len(unit)].astype(np.int32)), pa.array(gram.view(np.int64)))
                own = pa.array(doc[some])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("version").take(own), pa.array(number[some].astype(np.int32)), lists], names=schema.names)

    units = written(rows.mapInArrow(textbytes.trimmed(run), schema).withColumn("unit", F.monotonically_increasing_id()), owner)
    keys = units.select("unit", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    found = keys.join(shared, "key", "left_semi").select("unit").distinct()
    numbers = written(units.drop("keys").join(found, "unit", "left_semi").groupBy("doc_id", "version").agg(F.collect_set("number").alias("numbers")), owner)
    discard(units)
    return numbers


def items(docs: DataFrame, doc_id: str, text: str, numbers: DataFrame) -> DataFrame:
    """id (doc_id, number and version) and text of each paragraph with one of its document's numbers."""
    rows = named(docs, doc_id, text).join(numbers, ["doc_id", "version"])
    names = ["doc_id", "number", "version"]
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("id", T.StructType([T.StructField(n, t) for n, t in zip(names, (kind, T.IntegerType(), T.LongType()), strict=True)])), T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "text"):
                bounds, doc, number, _, _ = pieces(data, offsets)
                first, wanted = np.searchsorted(doc, np.arange(part.num_rows)), part.column("numbers")
                some = np.sort(np.repeat(first, wanted.value_lengths().to_numpy()) + wanted.flatten().to_numpy())
                raw, own = data.tobytes(), pa.array(doc[some])
                found = [raw[a:b] for a, b in zip(bounds[some].tolist(), bounds[some + 1].tolist(), strict=True)]
                ids = pa.StructArray.from_arrays([part.column("doc_id").take(own), pa.array(number[some].astype(np.int32)), part.column("version").take(own)], names=names)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, type=pa.string())], names=schema.names)

    return rows.mapInArrow(textbytes.trimmed(run), schema)


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", banding: minhash.Banding = BANDING, owner: str = "query") -> DataFrame:
    """id of each paragraph that may have its like (doc_id, number, and version, the hash of the whole text), n (its shingles) and component: the id of its group's first."""
    numbers = likely(docs, doc_id, text, banding, owner)
    found = written(items(docs, doc_id, text, numbers), owner)
    discard(numbers)
    return minhash.groups(found, banding, owner)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", banding: minhash.Banding = BANDING, owner: str = "query") -> DataFrame:
    """The rows with six more columns.

    removed: numbers of removed paragraphs; shared: numbers of all paragraphs that have their
    like elsewhere, those that stay included; kept_in: ids of documents that keep the like of
    the removed ones; kept_text; n_paragraphs; shared_words: words of the shared paragraphs.
    """
    found = grouped(docs, doc_id, text, banding, owner).filter("n > 0").select("id", "component").distinct()
    several = found.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1").select("component")
    gone = F.col("id") != F.col("component")
    lists = [F.sort_array(F.collect_set(x)).alias(name) for x, name in ((F.when(gone, F.col("id.number")), "removed"), (F.col("id.number"), "shared"), (F.when(gone, F.col("component.doc_id")), "kept_in"))]
    by_doc = found.join(several, "component").groupBy(F.col("id.doc_id").alias("key"), "id.version").agg(*lists)
    new = [T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("shared", T.ArrayType(T.IntegerType())), T.StructField("kept_in", by_doc.schema["kept_in"].dataType), T.StructField("kept_text", T.StringType()), T.StructField("n_paragraphs", T.LongType()), T.StructField("shared_words", T.LongType())]
    fields = [f for f in docs.schema.fields if f.name.lower() not in {n.name for n in new}]
    whole = F.col(f"`{text}`")
    carried = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]  # names of our own, whatever the table's are
    rows = docs.select(*carried, F.col(f"`{doc_id}`").alias("own_id"), whole.alias("whole"))
    rows = rows.join(by_doc, F.col("own_id").eqNullSafe(F.col("key")) & (F.xxhash64("whole") == F.col("version")), "left")
    listed = [F.coalesce(n.name, F.array().cast(n.dataType)).alias(n.name) for n in new[:3]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "whole"):
                bounds, doc, _, words, cut = pieces(data, offsets)
                first = np.searchsorted(doc, np.arange(part.num_rows))

                def at(name: str, first: np.ndarray = first, part: pa.RecordBatch = part) -> np.ndarray:
                    own = part.column(name)
                    return np.repeat(first, own.value_lengths().to_numpy()) + own.flatten().to_numpy()

                shared = np.zeros(len(doc), dtype=np.int64)
                shared[at("shared")] = 1
                stays = np.ones(len(doc), dtype=bool)
                stays[at("removed")] = False
                left = np.repeat(stays, np.diff(bounds))
                raw, ends = data[left].tobytes(), np.r_[0, np.cumsum(left)][offsets].tolist()
                valid = part.column("whole").is_valid().to_numpy(zero_copy_only=False)
                kept = [raw[a:b] if v else None for a, b, v in zip(ends[:-1], ends[1:], valid.tolist(), strict=True)]
                count = np.where(valid, 1 + np.searchsorted(cut, offsets[1:], "right") - np.searchsorted(cut, offsets[:-1], "right"), 0)
                more = [part.column(n.name) for n in new[:3]] + [pa.array(kept, type=pa.string()), pa.array(count), pa.array(np.bincount(doc, weights=words * shared, minlength=part.num_rows).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(f"c{i}") for i in range(len(fields))] + more, names=[f.name for f in fields + new])

    return rows.select(*[f"c{i}" for i in range(len(fields))], "whole", *listed).mapInArrow(textbytes.trimmed(run), T.StructType([*fields, *new]))


#: The same in DuckDB's SQL: all pairs of paragraphs that share a shingle.
ORACLE = rf"""
with recursive split as (select doc_id, text, regexp_extract_all(text, '(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as t from documents),
placed as (select doc_id, len(t) as n, unnest(range(len(t))) as i, unnest(t) as raw from split),
lower_words as (select *, translate(regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from placed),
sums as (select w, list_sum(list_transform(range(octet_length(encode(w))), lambda j: (j + 1) * cast('0x' || hex(encode(w))[2 * j + 1:2 * j + 2] as bigint))) % {MODULUS} as s from (select distinct w from lower_words)),
valued as (select l.*, (s * {FACTORS[0]} + coalesce(lead(s) over (partition by doc_id order by i), 0) * {FACTORS[1]}) % {MODULUS} as v from lower_words l join sums on sums.w = l.w),
cut as (
  select *, i > {NEAR} and i < n - {NEAR} and v < min(v) over (partition by doc_id order by i rows between {NEAR} preceding and 1 preceding)
         and v <= min(v) over (partition by doc_id order by i rows between 1 following and {NEAR} following) as first
  from valued),
numbered as (select *, cast(sum(case when first then 1 else 0 end) over (partition by doc_id order by i) as bigint) as number from cut),
units as (select doc_id, number, string_agg(raw, '' order by i) as text, list(w order by i) as a from numbered group by 1, 2),
docs as (select s.doc_id, s.text, case when count(u.text) > 0 then list(u.text order by u.number) when s.text is not null then [s.text] end as p from split s left join units u on u.doc_id = s.doc_id group by 1, 2),
words as (select doc_id * 1000000 + number as id, a from units),
sizes as (select id, len(a) as w from words),
sets as (select id, case when len(a) >= 5 then list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) else [array_to_string(a, ' ')] end as g from words),
grams as (select id, unnest(g) as g from sets),
pairs as (select x.id as a, y.id as b, count(*) as k from grams x join grams y on x.g = y.g and x.id < y.id group by 1, 2),
links as (select a, b from pairs join sets s on s.id = a join sets t on t.id = b where 100 * k >= 80 * (len(s.g) + len(t.g) - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(id, other) as (select a, a from both_ways union select r.id, e.b from reach r join both_ways e on e.a = r.other),
firsts as (select id, min(other) as first from reach group by id),
by_doc as (
  select id // 1000000 as doc_id, coalesce(list(cast(id % 1000000 as int) order by id) filter (first < id), []) as removed,
         coalesce(list(distinct first // 1000000 order by first // 1000000) filter (first < id), []) as kept_in, count(*) as n_shared, sum(w) as shared_words
  from firsts join sizes using (id) group by 1)
select d.doc_id, cast(coalesce(len(p), 0) as bigint) as n_paragraphs, cast(coalesce(len(removed), 0) as bigint) as n_removed, coalesce(removed, []) as removed, coalesce(kept_in, []) as kept_in,
       cast(coalesce(n_shared, 0) as bigint) as n_shared, cast(coalesce(shared_words, 0) as bigint) as shared_words,
       sha256(coalesce(array_to_string(list_filter(p, lambda x, i: not list_contains(coalesce(removed, []), cast(i - 1 as int))), ''), '')) as kept_sha256
from docs d left join by_doc b on b.doc_id = d.doc_id
"""
