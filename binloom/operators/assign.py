"""Genus of each scaffold from the scores of its genes' hits, and the votes of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions.names import best_hit_name, genus
from binloom.schema import NOT_ASSIGNED


def score_sums(hits: DataFrame, key: str = "scaffold", group: str = "genus", score: str = "bits") -> DataFrame:
    """Sum of the scores of each (key, group)."""
    return hits.groupBy(key, group).agg(F.sum(score).alias(score))


def best_group(sums: DataFrame, key: str = "scaffold", group: str = "genus", score: str = "bits") -> DataFrame:
    """Of each key the group with the largest score, of equal ones the first by name."""
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("a"), F.col(group).alias("b"))).alias("_best"))
    return best.select(key, F.col("_best.b").alias(group), (-F.col("_best.a")).alias(score))


def frequent(assigned: DataFrame, least_score: float = 50, least_count: int = 3, group: str = "genus", score: str = "bits") -> DataFrame:
    """Rows with a score above least_score whose group has least_count rows or more, counted before scores are looked at."""
    counts = assigned.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_count).select(group)
    return assigned.filter(F.col(score) > least_score).join(counts, group).select(*assigned.columns)


def gene_hits(genes: DataFrame, results: DataFrame, markers: DataFrame, strict: bool = True) -> DataFrame:
    """scaffold, genus and bits of the best hit of each gene of a marker family.

    genes: gene_id, cog_id, scaffold; results: gene_id, hits; markers: cog_id.
    """
    best = results.filter(F.size("hits") > 0).select("gene_id", best_hit_name(F.col("hits")[0]["title"], strict).alias("organism"), F.col("hits")[0]["bits"].alias("bits"))
    rows = genes.select("gene_id", "cog_id", "scaffold").join(markers.select("cog_id").distinct(), "cog_id", "left_semi").join(best, "gene_id")
    return rows.filter(F.col("organism").isNotNull()).select("scaffold", genus(F.col("organism")).alias("genus"), "bits")


def assign_genus(hits: DataFrame, least_score: float = 30, least_count: int = 2) -> DataFrame:
    """scaffold, genus and bits of the scaffolds that can be assigned."""
    return frequent(best_group(score_sums(hits)), least_score, least_count)


def majority(rows: DataFrame, key: str, name: Column) -> DataFrame:
    """The most frequent first word of the names of each key, of equal ones the first."""
    counts = rows.groupBy(key, F.split(name, " ")[0].alias("genus")).agg(F.count("*").alias("n"))
    return best_group(counts, key, "genus", "n")


def cluster_votes(members: DataFrame, hits: DataFrame, key: str = "scaffold", cluster: str = "cluster") -> DataFrame:
    """key, cluster and the genus with the largest sum of scores in its cluster; NOT_ASSIGNED for clusters without hits."""
    votes = best_group(score_sums(members.join(hits, key), cluster), cluster).select(cluster, "genus")
    return members.join(votes, cluster, "left").select(key, cluster, F.coalesce("genus", F.lit(NOT_ASSIGNED)).alias("genus"))


def relabelled(label: Column, probability: Column, threshold: float) -> Column:
    """The label where the probability is above the threshold; NaN and NULL are not."""
    return F.when(~F.isnan(probability) & (probability > threshold), label).otherwise(F.lit(NOT_ASSIGNED))


def genus_counts(assigned: DataFrame) -> DataFrame:
    """Rows of each genus, and how many genera there are."""
    return assigned.groupBy("genus").agg(F.count("*").alias("n")).withColumn("genera", F.count("*").over(Window.partitionBy()))
