"""Design matrices: spectrum and coverage of each scaffold, columns scaled to mean 0 and deviation 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.arrays import euclidean
from binloom.operators import compare


def scaled(df: DataFrame, key: str, features: str) -> DataFrame:
    """key and the features with the mean of each place taken off and divided by its population deviation; a constant place is 0."""
    places = df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = places.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_stats"))  # a row for each place, not for each sequence
    rows = df.select(key, features).join(F.broadcast(packed))
    z = F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("_stats").alias("t")), lambda v: F.when(v["t"]["s"] > 0, (v["x"] - v["t"]["m"]) / v["t"]["s"]).otherwise(F.lit(0.0)))
    return rows.select(key, z.alias(features))


def largest_log(df: DataFrame, coverage: str) -> DataFrame:
    """The rows with log(coverage) over the log of the largest coverage, without a window."""
    top = df.agg(F.log(F.max(coverage)).alias("_top"))
    return df.join(F.broadcast(top)).withColumn(coverage, F.try_divide(F.log(coverage), F.col("_top"))).drop("_top")


def spectrum_coverage(scaffolds: DataFrame, logarithm: bool = False) -> DataFrame:
    """scaffold and features: spectrum and coverage, raw or as logarithms, scaled."""
    rows = scaffolds.select("scaffold", "spectrum", F.col("coverage").cast("double").alias("coverage"))
    rows = largest_log(rows, "coverage") if logarithm else rows
    return scaled(rows.select("scaffold", F.concat("spectrum", F.array("coverage")).alias("features")), "scaffold", "features")


def genus_distance_coverage(scaffolds: DataFrame, references: DataFrame) -> DataFrame:
    """scaffold and features: Euclidean distance to each genus by name, and log coverage, scaled."""
    if references.isEmpty():
        raise ValueError("there are no genera")
    far = compare.distances(scaffolds.select("scaffold", "spectrum"), references, "scaffold", "spectrum", "genus", measure=euclidean)
    by_genus = far.groupBy("scaffold").agg(F.transform(F.array_sort(F.collect_list(F.struct("genus", "distance"))), lambda x: x["distance"]).alias("near"))
    rows = largest_log(scaffolds.select("scaffold", F.col("coverage").cast("double").alias("coverage")), "coverage").join(by_genus, "scaffold")
    return scaled(rows.select("scaffold", F.concat("near", F.array("coverage")).alias("features")), "scaffold", "features")
