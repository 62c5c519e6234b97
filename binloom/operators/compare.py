"""Nearest reference by the distance of k-mer spectra."""

from __future__ import annotations

import itertools
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions.arrays import l1
from binloom.functions.sequences import Kmers
from binloom.operators.kmercount import cells, joined_spectra, of_cells, profiles, seams, spectra, summed
from binloom.operators.relational import unassigned
from binloom.schema import NOT_ASSIGNED
from binloom.session import discard, written

log = logging.getLogger(__name__)

#: Bytes of reference vectors up to which they are sent to all tasks; beyond, queries are dealt out with each block of references.
SENT_BYTES, BLOCK_ROWS = 64 << 20, 4096


def absolute_threshold(by: Kmers, distance: float) -> float:
    """Largest distance that is accepted. It is above 2, the largest there is, at the usual settings."""
    return len(by.alphabet) * by.size * distance


def distances(queries: DataFrame, references: DataFrame, query: str, vector: str, name: str, distance: Column | None = None, measure: object = l1) -> DataFrame:
    """query, name and distance of each query and reference.

    References are few (a row for each genus); their size is looked at before they are sent to all tasks.
    """
    right = references.select(name, F.col(vector).alias("_reference"))
    count, wide = right.agg(F.count("*"), F.max(F.size("_reference"))).first()
    if count == 0:
        raise ValueError("there are no references")
    if count * (8 * (wide or 0) + 64) <= SENT_BYTES:
        right = F.broadcast(right)
        rows = queries.select(query, vector).join(right)
    else:
        blocks = -(-count // BLOCK_ROWS)
        left = queries.select(query, vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("_block"))
        rows = left.join(right.withColumn("_block", F.pmod(F.xxhash64(name), F.lit(blocks))), "_block")
    return rows.select(query, name, measure(F.col(vector), F.col("_reference")).alias("distance"))


def nearest_two(found: DataFrame, query: str, name: str) -> DataFrame:
    """query, the nearest name with its distance, and the distance of the second, from rows of distances; equal distances by name."""
    first = found.groupBy(query).agg(F.min(F.struct("distance", name)).alias("_first"))
    others = found.join(first, query).filter(F.struct("distance", name) != F.col("_first")).groupBy(query).agg(F.min("distance").alias("second"))
    return first.join(others, query, "left").select(query, F.col(f"_first.{name}").alias(name), F.col("_first.distance").alias("distance"), "second")


def nearest(queries: DataFrame, references: DataFrame, query: str, vector: str, name: str, measure: object = l1) -> DataFrame:
    """query, the nearest reference with its distance, and the distance of the second.

    References that may be sent to all tasks become one row, so that each query is compared
    with all of them where it is read, without a shuffle; beyond that they are dealt out in blocks.
    """
    known = references.filter(F.col(vector).isNotNull()).select(name, F.col(vector).alias("_reference"))
    count, wide = known.agg(F.count("*"), F.max(F.size("_reference"))).first()
    if count == 0:
        raise ValueError("there are no references")
    if count * (8 * (wide or 0) + 64) > SENT_BYTES:
        return nearest_two(distances(queries, references.filter(F.col(vector).isNotNull()), query, vector, name, measure=measure), query, name)
    packed = known.agg(F.collect_list(F.struct(name, "_reference")).alias("_all"))
    far = F.transform("_all", lambda r: F.struct(measure(F.col(vector), r["_reference"]).alias("distance"), r[name].alias(name)))
    rows = queries.select(query, vector).join(F.broadcast(packed)).select(query, far.alias("_far")).withColumn("_first", F.array_min("_far"))
    second = F.array_min(F.transform(F.filter("_far", lambda x: x != F.col("_first")), lambda x: x["distance"]))
    return rows.select(query, F.col(f"_first.{name}").alias(name), F.col("_first.distance").alias("distance"), second.alias("second"))


def selected(nearest: DataFrame, name: str, largest: float, ratio: float) -> DataFrame:
    """Nearest names that are near enough, and nearer than the second by the ratio; else NOT_ASSIGNED at -1.

    A distance that is NULL or NaN is never accepted; 0 against 0 is.
    """
    d, second = F.col("distance"), F.col("second")
    share = F.when((d == 0) & (second == 0), F.lit(0.0)).otherwise(F.try_divide(d, second))
    good = F.coalesce(~F.isnan(d) & (d <= largest) & (share <= ratio), F.lit(False))
    return nearest.withColumn(name, F.when(good, F.col(name)).otherwise(F.lit(NOT_ASSIGNED))).withColumn("distance", F.when(good, d).otherwise(F.lit(-1.0))).drop("second")


def compare(queries: DataFrame, references: DataFrame, by: Kmers, distance: float = 0.003, ratio: float = 0.8, largest: float | None = None) -> DataFrame:
    """scaffold, genus and distance of each (scaffold, sequence) against (genus, sequence); two references at least."""
    return compare_spectra(queries, spectra(references, "sequence", by), by, distance, ratio, largest)


def compare_spectra(queries: DataFrame, known: DataFrame, by: Kmers, distance: float = 0.003, ratio: float = 0.8, largest: float | None = None) -> DataFrame:
    """The same against (genus, spectrum), which are read more than once."""
    if known.select("genus").limit(2).count() < 2:
        raise ValueError("two references are needed")
    found = nearest(spectra(queries, "sequence", by, strict=False).select("scaffold", "spectrum"), known, "scaffold", "spectrum", "genus")
    return selected(found, "genus", absolute_threshold(by, distance) if largest is None else largest, ratio)


def compare_once(assigned: DataFrame, scaffolds: DataFrame, by: Kmers, distance: float = 0.003, ratio: float = 0.8, largest: float | None = None) -> DataFrame:
    """The comparison of scaffolds that aren't assigned yet with the joined sequences of each genus that is."""
    real = assigned.filter(F.col("genus") != NOT_ASSIGNED)
    named = real.select("scaffold", "genus").join(scaffolds.select("scaffold", "sequence"), "scaffold")
    known = written(joined_spectra(named, "genus", "scaffold", "sequence", by))
    return compare_spectra(unassigned(scaffolds.select("scaffold", "sequence"), assigned, "scaffold"), known, by, distance, ratio, largest)


def compare_all(assigned: DataFrame, scaffolds: DataFrame, by: Kmers, distance: float = 0.003, ratio: float = 0.8, largest: float | None = None, mode: str = "intent", rounds: int | None = None) -> DataFrame:
    """Comparisons repeated with what the last one assigned, until nothing new is; assigned scaffolds count at distance 0.

    Each sequence is read once, where it is, for its counts, its spectrum and its ends; no text is
    shuffled or written. A genus keeps its k-mer counts and the ends of its sequences from round to
    round. A round adds the counts of the sequences just assigned, and compares the scaffolds that
    are left by their spectra, so it reads fewer rows than the one before.

    mode "compat" makes one pass and keeps the rows that weren't assigned.
    """
    table = assigned.select("scaffold", "genus", F.lit(0.0).alias("distance"))
    if mode == "compat":
        return table.unionByName(compare_once(table, scaffolds, by, distance, ratio, largest))
    table = written(table)
    every = written(profiles(scaffolds.select("scaffold", "sequence"), "sequence", by))
    left = written(unassigned(every, table, "scaffold"))
    named = table.filter(F.col("genus") != NOT_ASSIGNED).select("scaffold", "genus").join(every, "scaffold")
    counts = tips = None
    for k in itertools.count() if rounds is None else range(rounds):  # each one assigns a scaffold more at least
        rows = named.filter(F.col("_head").isNotNull()).select(F.col("genus").alias("_key"), F.col("scaffold").alias("_at"), "_counts", "_head", "_tail")
        parts = [summed(rows, by), rows.filter(F.length("_head") > 0).select("_key", "_at", "_head", "_tail")]
        old = counts, tips
        if counts is not None:
            parts = [counts.unionByName(parts[0]).groupBy("_key", "_place").agg(F.sum("_n").alias("_n")), tips.unionByName(parts[1])]
        counts, tips = written(parts[0]), written(parts[1])
        known = written(of_cells(counts.unionByName(cells(seams(tips, by), by)) if by.k > 1 else counts, "genus", by))
        if known.limit(2).count() < 2:
            raise ValueError("two references are needed")
        found = selected(nearest(left.select("scaffold", "spectrum"), known, "scaffold", "spectrum", "genus"), "genus", absolute_threshold(by, distance) if largest is None else largest, ratio)
        new = written(found.filter(F.col("genus") != NOT_ASSIGNED))
        discard(known, *[t for t in old if t is not None])
        if new.isEmpty():
            discard(new)
            break
        log.info("round %d: %d scaffolds were left, %d are assigned", k, left.count(), new.count())
        before = [table, left]
        named = written(new.select("scaffold", "genus").join(left.drop("spectrum"), "scaffold"))
        table, left = written(table.unionByName(new)), written(unassigned(left, new, "scaffold"))
        discard(new, *before)
    discard(every, left, counts, tips)
    return table
