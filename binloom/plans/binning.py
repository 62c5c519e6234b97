"""The binning engine end to end: ingest, assignment, comparison, clustering, label propagation."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions.sequences import Kmers
from binloom.operators import assign, cluster, compare, labelspread, matrix
from binloom.operators.catalog import Database
from binloom.operators.kmercount import joined_spectra, spectra
from binloom.operators.relational import updated, with_label
from binloom.schema import NO_INDEX, NOT_ASSIGNED
from binloom.session import discard, written
from binloom.sources import files

log = logging.getLogger(__name__)


def create_database(db: Database, genes: str | None = None, proteins: str | None = None, scaffolds: str | None = None, coverage: str | None = None, skip_first_row: bool = True, paragraphs: bool = False) -> None:
    """Tables from those files that are given, in this order; other tables stay."""
    if genes:
        db.replace("Genes", files.genes(db.spark, genes, skip_first_row, paragraphs))
        files.warn_without_cog(db.table("Genes"))
    if proteins:
        db.replace("Sequences", files.proteins(db.spark, proteins))
    if scaffolds:
        db.replace("Scaffolds", files.scaffolds(db.spark, scaffolds))
    if coverage:
        db.exists("Scaffolds", raise_error=True)
        db.replace("Scaffolds", updated(db.table("Scaffolds").drop("coverage"), files.coverage(db.spark, coverage), "scaffold", "coverage", "pos"))


def add_spectra(db: Database, k: int = 4) -> None:
    """The scaffolds' spectra as a column; a sequence without k letters raises."""
    db.replace("Scaffolds", spectra(db.table("Scaffolds"), "sequence", Kmers(k)))


def genera(db: Database, markers: DataFrame, least_score: float = 30, least_count: int = 2) -> None:
    """ScaffoldsAssignments from the hits of marker genes."""
    for name in ("Genes", "BlastResults"):
        db.exists(name, raise_error=True)
    hits = assign.gene_hits(db.table("Genes"), db.table("BlastResults"), markers)
    db.replace("ScaffoldsAssignments", assign.assign_genus(hits, least_score, least_count))


def nearest_genera(db: Database, by: Kmers | None = None, **settings: object) -> None:
    """ScaffoldKmerComparison from the assigned scaffolds."""
    db.replace("ScaffoldKmerComparison", compare.compare_all(db.table("ScaffoldsAssignments"), db.table("Scaffolds"), by or Kmers(4), **settings))


def design(db: Database, kind: str = "coverage") -> DataFrame:
    """The design matrix of the scaffolds: "coverage" (raw), "log" or "genus"."""
    scaffolds = db.table("Scaffolds")
    missing = [c for c in ("spectrum", "coverage") if c not in scaffolds.columns]
    if missing:
        raise ValueError(f"the scaffolds have no {' and no '.join(missing)}")
    if kind != "genus":
        return matrix.spectrum_coverage(scaffolds, logarithm=kind == "log")
    named = db.table("ScaffoldsAssignments").join(scaffolds.select("scaffold", "sequence"), "scaffold")
    k = next(k for k in range(1, 13) if 4**k == scaffolds.select(F.size("spectrum")).first()[0])
    return matrix.genus_distance_coverage(scaffolds, joined_spectra(named, "genus", "scaffold", "sequence", Kmers(k)))


def kmeans(db: Database, n: int) -> None:
    db.replace("KmeansResults", cluster.kmeans(design(db), n))


def mixture(db: Database, n: int) -> None:
    db.replace("DPGMMResults", cluster.dirichlet_mixture(design(db), n))


def label_propagation(db: Database) -> None:
    """Genera spread from the assigned scaffolds; those that none reaches are NOT_ASSIGNED at 0."""
    seeds = db.table("ScaffoldsAssignments").select("scaffold", F.col("genus").alias("label"))
    found = labelspread.propagate(design(db), seeds, default=NOT_ASSIGNED)
    db.replace("LabelPropagationResults", found.select("scaffold", F.col("label").alias("genus"), "probability"))


def kmeans_label_propagation(db: Database, n: int, alpha: float = 0.5) -> None:
    """Clusters spread from k-means; those that none reaches are NO_INDEX at 0."""
    features = written(design(db))
    seeds = cluster.kmeans(features, n).select("scaffold", F.col("cluster").alias("label"))
    found = labelspread.propagate(features, seeds, alpha=alpha, default=NO_INDEX)
    db.replace("KmeansLPResults", found.select("scaffold", F.col("label").cast("long").alias("cluster"), "probability"))


@dataclass(frozen=True)
class Binning:
    """Distance within which scaffolds are one bin, probability from which a label is reliable, rounds of splitting."""

    threshold: float = 0.15
    probability: float = 0.60
    rounds: int = 1
    alpha: float = 1.0


def initial_bins(scaffolds: DataFrame, assigned: DataFrame, settings: Binning) -> DataFrame:
    """scaffold and label: complete-linkage clusters (from 1) of the assigned scaffolds, NO_INDEX for the others."""
    known = scaffolds.join(assigned.select("scaffold").distinct(), "scaffold", "left_semi")
    found = cluster.complete_linkage(matrix.spectrum_coverage(known, logarithm=True), settings.threshold).withColumnRenamed("cluster", "label")
    return with_label(scaffolds.select("scaffold"), found, "scaffold", "label", NO_INDEX)


def split_bins(scaffolds: DataFrame, current: DataFrame, settings: Binning, last_label: int) -> tuple[DataFrame, bool]:
    """scaffold and label after splitting, and whether any bin was split.

    Reliable scaffolds of a bin that complete linkage takes apart get labels above last_label;
    unreliable ones lose theirs. Each bin's matrix is scaled by itself.
    """
    reliable = current.filter(F.col("probability") > settings.probability).filter(F.col("label") != NO_INDEX)
    rows = reliable.join(scaffolds.select("scaffold", "spectrum", F.col("coverage").cast("double").alias("coverage")), "scaffold")
    top = rows.groupBy("label").agg(F.log(F.max("coverage")).alias("_top"))
    rows = rows.join(top, "label").select("label", "scaffold", F.concat("spectrum", F.array(F.coalesce(F.try_divide(F.log("coverage"), F.col("_top")), F.lit(0.0)))).alias("features"))
    places = rows.select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = places.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_stats"))
    z = F.transform(F.arrays_zip(F.col("features").alias("x"), F.col("_stats").alias("t")), lambda v: F.when(v["t"]["s"] > 0, (v["x"] - v["t"]["m"]) / v["t"]["s"]).otherwise(F.lit(0.0)))
    parts = written(cluster.complete_linkage(rows.join(stats, "label").select("label", "scaffold", z.alias("features")), settings.threshold, group="label"))
    several = parts.groupBy("label").agg(F.max("cluster").alias("n")).filter("n > 1")
    start = several.withColumn("_from", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(last_label))
    renamed = parts.join(start, "label", "left").select("scaffold", F.when(F.col("_from").isNotNull(), F.col("_from") + F.col("cluster")).otherwise(F.col("label")).alias("label"))
    return with_label(scaffolds.select("scaffold"), renamed, "scaffold", "label", NO_INDEX), not several.isEmpty()


def run_binning(scaffolds: DataFrame, assigned: DataFrame, settings: Binning | None = None) -> DataFrame:
    """scaffold, label and probability: bins of the assigned scaffolds, spread, split and spread again while bins split."""
    settings = settings or Binning()
    features = written(matrix.spectrum_coverage(scaffolds, logarithm=True))
    edges = written(labelspread.graph(labelspread.nearest(features, "scaffold", "features", labelspread.NEIGHBOURS)))
    spread = lambda labels: written(labelspread.best_labels(edges, labelspread.seeds(labels, "scaffold", "label"), features, "scaffold", NO_INDEX, settings.alpha))
    kept = labels = written(initial_bins(scaffolds, assigned, settings))
    current = spread(labels)
    for _ in range(settings.rounds):
        last = labels.agg(F.max("label")).first()[0] or 0
        labels, split = split_bins(scaffolds, current, settings, max(0, last))
        if not split:
            break
        last_labels, last_spread = kept, current
        kept = labels = written(labels)
        current = spread(labels)
        discard(last_labels, last_spread)
    discard(features, edges, kept)
    log.info("binning ended")
    return current


def store_labels(db: Database, labels: DataFrame, column: str = "label", scaffolds: str = "Scaffolds") -> None:
    """Keep the current labels in a column of the scaffolds; those without a label get NO_INDEX."""
    rows = db.table(scaffolds)
    kept = labels.select("scaffold", F.col("label").cast("long").alias(column))
    db.replace(scaffolds, with_label(rows.drop(column), kept, "scaffold", column, NO_INDEX))


def current_labels(db: Database, column: str = "label", scaffolds: str = "Scaffolds") -> DataFrame:
    """scaffold and label as store_labels() kept them."""
    return db.table(scaffolds).select("scaffold", F.col(column).alias("label"))
