"""Genus of sequences as they arrive, by the nearest k-mer spectrum among reference sequences.

    python -m jobs.bin_arrivals --config jobs/bin_arrivals.json --sequences DIR --references DIR --output DIR --checkpoint DIR

Sequences (doc_id, lang, text) come as Parquet files of a folder, or of a pattern of paths,
as a single file needs: DIR/{documents.parquet}. A run takes the files that
no earlier run with its checkpoint took, in batches, and stops. Each batch is written to
partitions of its number and the sequences' language; a batch that was cut off is taken
again under its number and overwrites what it left, so every sequence is written once.
References (item_id, text) are a row for each genus; they should not change between runs.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from binloom.functions.arrays import l1
from binloom.functions.sequences import Kmers, gc_fraction
from binloom.operators.compare import nearest, selected
from binloom.operators.kmercount import spectra
from binloom.session import discard, written
from jobs import command

log = logging.getLogger("bin_arrivals")

SCHEMA = "doc_id long, length long, gc double, genus string, distance double, batch long, lang string"
#: Decimals of a distance: references whose distances differ less are equally near, and the first by name is taken.
DECIMALS = 9


def binned(sequences: DataFrame, known: DataFrame, by: Kmers, largest: float, ratio: float) -> DataFrame:
    """doc_id, lang, length, gc, genus and distance of each sequence; one without known k-mers is not assigned."""
    rows = spectra(sequences.select("doc_id", "lang", "text"), "text", by, strict=False)
    record = F.struct("doc_id", "lang", F.length("text").cast("long").alias("length"), F.round(gc_fraction(F.col("text")), DECIMALS).alias("gc"))
    found = nearest(rows.select(record.alias("record"), "spectrum"), known, "record", "spectrum", "genus", measure=lambda a, b: F.round(l1(a, b), DECIMALS))
    return selected(found, "genus", largest, ratio).select("record.*", "genus", "distance")


def bin_arrivals(spark: SparkSession, sequences: str, references: str, output: str, checkpoint: str, k: int = 2, largest: float = 0.9, ratio: float = 0.95, files: int = 100) -> DataFrame:
    """Bin the sequences that have arrived since the last run; the whole output, of all runs."""
    by = Kmers(k)
    known = written(spectra(spark.read.parquet(references).select(F.col("item_id").cast("string").alias("genus"), "text"), "text", by, strict=False).select("genus", "spectrum"), "bin-arrivals")
    arrived = spark.readStream.schema(spark.read.parquet(sequences).schema).option("maxFilesPerTrigger", files).parquet(sequences)

    def write(batch: DataFrame, number: int) -> None:
        read = Observation()
        rows = binned(batch.observe(read, F.count(F.lit(1)).alias("rows")), known, by, largest, ratio).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(output)
        wrote = spark.read.schema(SCHEMA).parquet(output).filter(F.col("batch") == number).count()
        log.info("batch %d: read %d sequences, wrote %d rows to %s", number, read.get["rows"], wrote, output)

    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("batch", "lang").parquet(output)  # there is an output even if nothing has arrived
    query = arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    discard(known)
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    whole = spark.read.schema(SCHEMA).parquet(output)
    log.info("took %d new sequences of %s; the output has %d rows", taken, sequences, whole.count())
    return whole.drop("batch")


if __name__ == "__main__":
    command.main(bin_arrivals, ["sequences", "references", "output", "checkpoint", "k", "largest", "ratio", "files"], "jobs/bin_arrivals.json")
