"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A text's set are the hashes of its distinct word shingles. SuperMinHash gives each element
a random permutation of the signature's places, one place a round, and values that grow
with the round; a place keeps the least value that any element gave it. A set is done as
soon as the largest kept value is below the round, so large sets need one round and only
small ones many. Groups of rows of the signature are the bands' keys.

Texts with equal sets are one class. In each bucket of a band, classes are compared with
the one that shares buckets with most others; links are checked on the full sets and
joined to components. Buckets whose classes then still lie in several components are
checked as a whole, in blocks: the sizes of all intersections of a block come from one
matrix product, and only pairs that join components leave the task. So every pair that
shares a bucket and could still matter has been checked, a large group of copies costs
about one comparison a member and bucket, and pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm import textbytes
from binloom.llm.components import components
from binloom.session import discard, written

#: Elements whose permutations are held at once.
HELD = 1 << 16
#: Rows of a block of buckets that are checked as a whole; members of a bucket above which intersections come from a matrix product; its columns.
BLOCK, FEW, COLUMNS = 1024, 32, 4096
#: Elements of the sets of pairs that are compared at once.
PAIRED = 1 << 18
#: Bytes of text whose sets are held at once.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Banding:
    """Words in a shingle, least similarity in percent, bands and rows of the signature in each."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    least_words: int = 1  # texts with fewer words have an empty set

    def missed(self, similarity: float) -> float:
        """The chance that a pair of this similarity shares no bucket."""
        return (1 - similarity**self.rows) ** self.bands


def ordered(own: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Order by document, then by hash: one sort of both in 64 bits, and of the whole hashes where that leaves hashes open."""
    free = max(int(own.max(initial=0)), 1).bit_length()
    key = own.astype(np.uint64) << np.uint64(64 - free) | gram >> np.uint64(free)
    order = np.argsort(key)
    key, then = key[order], gram[order]
    return order if not ((key[1:] == key[:-1]) & (then[1:] < then[:-1])).any() else np.lexsort((gram, own))


def shingles(data: np.ndarray, offsets: np.ndarray, banding: Banding) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document's shingles in order, end to end, and where each document's begin (one more than documents).

    A-Z are taken in lower case. A text of fewer words than a shingle has its whole sequence as one.
    """
    low, size, n = textbytes.LOWER[data], banding.words, len(offsets) - 1
    starts, ends, doc = textbytes.words(low, offsets)
    word = textbytes.word_hash(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    enough = count >= max(1, banding.least_words)
    whole = np.flatnonzero((doc[size - 1 :] == doc[: len(doc) - size + 1]) & enough[doc[size - 1 :]]) if len(doc) >= size else np.zeros(0, dtype=np.int64)
    gram, own = textbytes.gram_hash(word, size)[whole], doc[whole]
    first, alone, short = np.cumsum(count) - count, [], []
    for k in range(1, size):
        some = np.flatnonzero((count == k) & enough)
        if len(some):  # the whole sequence is the one shingle
            sequences = word[(first[some][:, None] + np.arange(k)).ravel()]
            alone.append(textbytes.mix(textbytes.gram_hash(sequences, k)[::k] + np.uint64(k)))
            short.append(some)
    gram, own = np.concatenate([gram, *alone]), np.concatenate([own, *short])
    order = ordered(own, gram)
    gram, own = gram[order], own[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    return gram[new], np.r_[0, np.cumsum(np.bincount(own[new], minlength=n))]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, banding: Banding) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles."""
    gram, at = shingles(data, offsets, banding)
    bounds = at.tolist()
    return [gram[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each document of one side, how many shingles it shares with the document of the same place of the other; both as shingles() gives them."""
    n = len(left[1]) - 1
    own = np.concatenate([np.repeat(np.arange(n), np.diff(at)) for _, at in (left, right)])
    gram = np.concatenate([left[0], right[0]])
    order = ordered(own, gram)
    gram, own = gram[order], own[order]
    return np.bincount(own[1:][(gram[1:] == gram[:-1]) & (own[1:] == own[:-1])], minlength=n)


def _least(values: np.ndarray, places: np.ndarray, given: np.ndarray) -> None:
    np.minimum.at(values, places, given)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures: a row of m values for each set; those of empty sets mean nothing."""
    count = np.array([len(s) for s in sets])
    order = np.argsort(count, kind="stable")
    out = np.full((len(sets), m), np.uint64(2**64 - 1))
    top = np.uint64(56)
    low = np.uint64(8)
    at = 0
    while at < len(order):
        to, total = at, 0
        while to < len(order) and (to == at or total + count[order[to]] <= HELD):
            total += count[order[to]]
            to += 1
        some = order[at:to]
        at = to
        x = np.concatenate([sets[i] for i in some]) if total else np.zeros(0, dtype=np.uint64)
        if not len(x):
            continue
        own = np.repeat(np.arange(len(some)), count[some])
        values = out[some].ravel()
        seed = textbytes.mix(x)
        # round 0 needs no permutation yet
        place = ((textbytes.mix(seed + np.uint64(1)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        _least(values, own * m + place, textbytes.mix(seed) >> low)
        open_ = values.reshape(-1, m).max(axis=1) >= np.uint64(1) << top
        live = np.flatnonzero(open_[own])
        if len(live):
            own, seed = own[live], seed[live]
            state = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(live), 1))
            k = np.arange(len(live))
            state[k, place[live]], state[:, 0] = state[:, 0].copy(), state[k, place[live]].copy()
        for j in range(1, m):
            if not len(live):
                break
            drawn = textbytes.mix(seed + np.uint64(2 * j * textbytes.GOLDEN & (2**64 - 1)))
            other = j + ((drawn >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            chosen = state[k, other]
            state[k, other] = state[:, j]
            _least(values, own * m + chosen, (textbytes.mix(drawn) >> low) + (np.uint64(j) << top))
            open_ = values.reshape(-1, m).max(axis=1) >= np.uint64(j + 1) << top
            stay = open_[own]
            if not stay.all():
                live, own, seed, state = live[stay], own[stay], seed[stay], state[stay]
                k = np.arange(len(live))
        out[some] = values.reshape(-1, m)
    return out


def band_keys(signature: np.ndarray, banding: Banding) -> np.ndarray:
    """A 64-bit key for each row and band."""
    part = signature.reshape(len(signature), banding.bands, banding.rows)
    by = textbytes.seeded(banding.rows, 41) | np.uint64(1)
    return textbytes.mix((part * by).sum(axis=2, dtype=np.uint64) + textbytes.seeded(banding.bands, 43))


def set_sums(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """The sum of each set's salted hashes, which does not depend on their order."""
    out, n = np.zeros(len(sets), dtype=np.uint64), np.array([len(s) for s in sets], dtype=np.int64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(textbytes.mix(np.concatenate(sets) ^ np.uint64(salt)), (np.cumsum(n) - n)[some])
    return out


def described(items: DataFrame, banding: Banding) -> DataFrame:
    """id, th (the text's hash), n (shingles), two digests of the set, and its bands' keys, from (id, th, text)."""
    schema = T.StructType([items.schema["id"], T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "text", CHUNK):
                sets = shingle_sets(data, offsets, banding)
                n = np.array([len(s) for s in sets])
                keys = band_keys(signatures(sets, banding.bands * banding.rows), banding).view(np.int64)
                first, second = set_sums(sets, 0), set_sums(sets, textbytes.GOLDEN)
                size = np.where(n > 0, banding.bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], names=schema.names)

    return items.select("id", "th", "text").mapInArrow(textbytes.trimmed(run), schema)


def linked(pairs: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.chunks(batch, "ta", CHUNK):
                left, right = shingles(data, offsets, banding), shingles(*textbytes.joined(part.column("tb")), banding)
                both, x, y = common(left, right), np.diff(left[1]), np.diff(right[1])
                good = (100 * both >= banding.percent * (x + y - both)) & (x > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good))

    return rows.select("a", "b", "ta", "tb").mapInArrow(textbytes.trimmed(run), "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    n = len(sets)
    token, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(token), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(n), [len(s) for s in sets]), place[back]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    for at in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((n, min(COLUMNS, len(shared) - at)), dtype=np.float32)
        has[row[a:b], column[a:b] - at] = 1
        out += has @ has.T
    return out


class Groups:
    """Groups that links join, by the least number of each."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, g: int) -> int:
        while self.parent[g] != g:
            self.parent[g] = self.parent[self.parent[g]]
            g = self.parent[g]
        return g

    def join(self, g: int, h: int) -> bool:
        """Whether they were apart."""
        g, h = self.find(g), self.find(h)
        self.parent[max(g, h)] = min(g, h)
        return g != h


def bridges(sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that are similar enough and join the groups of a bucket: as many as there are groups to join, not all."""
    size, both = np.array([len(s) for s in sets]), intersections(sets)
    near = (100 * both >= percent * (size[:, None] + size[None] - both)) & (group[:, None] != group[None])
    joined = Groups(int(group.max()) + 1)
    return [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True) if joined.join(int(group[i]), int(group[j]))]


def small_bridges(sets: list[np.ndarray], group: np.ndarray, key: np.ndarray, member: np.ndarray, percent: int) -> set[tuple[int, int]]:
    """The same for all buckets of at most FEW members at once: key and member (a place in sets) of each row, by key.

    A pair is compared once, in however many buckets it meets, and not at all if its groups are joined by then.
    """
    n, size = len(key), np.array([len(s) for s in sets], dtype=np.int64)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[new, n])
    within, left = np.arange(n) - np.repeat(new, count), np.repeat(count, count)
    met = []
    for k in range(1, FEW):
        i = np.flatnonzero((left <= FEW) & (within + k < left))
        if not len(i):
            break
        a, b = member[i], member[i + k]
        near = (group[a] != group[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        met.append(np.minimum(a, b)[near] * len(sets) + np.maximum(a, b)[near])
    pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, dtype=np.int64)
    found: set[tuple[int, int]] = set()
    if not len(pairs):
        return found
    joined, flat, at = Groups(int(group.max()) + 1), np.concatenate(sets), np.r_[0, np.cumsum(size)]

    def side(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.r_[0, np.cumsum(size[some])]
        return flat[np.arange(ends[-1]) + np.repeat(at[some] - ends[:-1], size[some])], ends

    a, b = pairs // len(sets), pairs % len(sets)
    block = np.cumsum(size[a] + size[b]) // PAIRED
    for rows in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(block)) + 1):
        apart = [joined.find(g) != joined.find(h) for g, h in zip(group[a[rows]].tolist(), group[b[rows]].tolist(), strict=True)]
        rows = rows[np.array(apart)]
        if not len(rows):
            continue
        x, y = a[rows], b[rows]
        both = common(side(x), side(y))
        near = 100 * both >= percent * (size[x] + size[y] - both)
        found.update((i, j) for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True) if joined.join(int(group[i]), int(group[j])))
    return found


def bucket_links(left: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Links (a, b) between components of the same bucket, from (key, node, component); enough of them to join what is linked."""
    counted = left.join(left.groupBy("key").agg(F.count("*").alias("m")), "key")
    bins = max(1, -(-left.count() // BLOCK))
    blocks = F.when(F.col("m") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int")
    dealt = counted.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1  # whole buckets share bins; a block of a larger one meets each block of it
    dealt = dealt.select("key", "node", "component", F.when(alone, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("g"), F.when(alone, -1).otherwise(F.least("own", "other")).alias("lo"), F.when(alone, -1).otherwise(F.greatest("own", "other")).alias("hi"))
    rows = dealt.join(texts.hint("merge"), "node")

    def run(table: pa.Table) -> pa.Table:
        key, component = table["key"].to_numpy(), table["component"].to_numpy()
        nodes, first, where = np.unique(table["node"].to_numpy(), return_index=True, return_inverse=True)
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).take(pa.array(first)).to_batches():
            for _, data, offsets in textbytes.chunks(batch, "text", CHUNK):
                sets += shingle_sets(data, offsets, banding)
        group = np.unique(component, return_inverse=True)[1]
        order = np.argsort(key, kind="stable")
        found = small_bridges(sets, group[first], key[order], where[order], banding.percent)
        bounds = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(order)]
        for k in np.flatnonzero(np.diff(bounds) > FEW).tolist():
            rows_ = order[bounds[k] : bounds[k + 1]]
            if len(np.unique(group[rows_])) > 1:
                found.update((int(where[rows_[i]]), int(where[rows_[j]])) for i, j in bridges([sets[d] for d in where[rows_]], group[rows_], banding.percent))
        a, b = (nodes[np.array([p[k] for p in sorted(found)], dtype=np.int64)] for k in (0, 1))
        return pa.table([a, b], names=["a", "b"])

    return rows.select("g", "lo", "hi", "key", "node", "component", "text").groupBy("g", "lo", "hi").applyInArrow(textbytes.trimmed_group(run), "a long, b long")


def groups(items: DataFrame, banding: Banding, owner: str = "query") -> DataFrame:
    """id, th, n (shingles in the set) and component (the least id reachable by links) for each row of (id, text).

    th is the xxhash64 of the text. Null or blank texts have an empty set and are linked with
    nothing. Rows are grouped one by one: rows of one id with different texts may lie in
    different groups. Rows without id are linked with nothing and have no component.

    Rows of equal sets are one class. A class has a number of 64 bits, its node, by which
    pairs, links and components go; the ids, of whatever type, come back at the end.
    """
    items = items.select("id", F.xxhash64("text").alias("th"), "text")
    sets = written(described(items, banding), owner)
    least = [F.min(F.struct("id", "th", "keys")).alias("x"), F.count("*").alias("rows")]
    classes = sets.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(*least).select("s1", "s2", "n", "x.id", "x.th", "x.keys", "rows", F.monotonically_increasing_id().alias("node"))
    classes = written(classes, owner)
    rows = classes.select(F.explode("keys").alias("key"), "node", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = written(rows.join(shared, "key"), owner)
    weight = members.groupBy("node").agg(F.sum("m").alias("w"))
    centers = members.join(weight, "node").groupBy("key").agg(F.min(F.struct(-F.col("w"), "node", "n")).alias("x")).select("key", F.col("x.node").alias("center"), F.col("x.n").alias("center_n"))
    near = F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * banding.percent  # what the sizes allow
    tested = members.join(centers, "key").filter((F.col("node") != F.col("center")) & near).select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
    firsts = classes.select("id", "th", "node").join(weight.select("node"), "node")
    texts = written(items.join(firsts.hint("merge"), ["id", "th"]).groupBy("node").agg(F.min("text").alias("text")), owner)
    links = written(linked(tested, texts, banding), owner)
    found = components(links, owner).withColumnRenamed("node", "member")

    placed = members.join(found, members["node"] == found["member"], "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    left = written(placed.join(mixed, "key"), owner)
    more = written(bucket_links(left, texts, banding), owner)
    if not more.isEmpty():
        found = components(links.unionByName(more), owner).withColumnRenamed("node", "member")

    joined = classes.select("id", "node").join(found, F.col("node") == F.col("member"))
    named = joined.join(joined.groupBy("component").agg(F.min("id").alias("first")), "component").select("member", "first")
    named = classes.select("s1", "s2", "n", "id", "rows", "node").join(named, F.col("node") == F.col("member"), "left").filter("rows > 1 or first is not null")
    named = written(named.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("n").alias("tn"), F.coalesce("first", "id").alias("component")), owner)
    discard(classes, members, texts, links, left, more)
    out = sets.join(named, (sets["s1"] == named["t1"]) & (sets["s2"] == named["t2"]) & (sets["n"] == named["tn"]), "left")
    return out.select("id", "th", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


#: Groups of documents by 4-word shingles in DuckDB's SQL: all pairs that share a shingle.
ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as a
  from documents),
sets as (
  select doc_id, case when len(a) >= 4 then list_distinct(list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' '))) when len(a) > 0 then [array_to_string(a, ' ')] else [] end as g
  from words),
grams as (select doc_id, unnest(g) as g from sets),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as k from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join sets s on s.doc_id = a join sets t on t.doc_id = b where 100 * k >= 80 * (len(s.g) + len(t.g) - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from sets union select r.doc_id, e.b from reach r join both_ways e on e.a = r.other),
found as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, cast(len(g) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from sets s join found f on f.doc_id = s.doc_id
"""
