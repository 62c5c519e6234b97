"""Records of a sequence database, dealt to families by the words of their descriptions.

    python -m jobs.split_families --config jobs/split_families.json --records DIR --families DIR --output DIR

A record (doc_id, lang, source, text) belongs to the first family, in the order of their
ids, all of whose words it has; records of no family are left out. A family's words are the
first few of its text (item_id, text). records/ below the output has a folder for each
family, whose files hold about as many rows each however large the family is; summary/ has
its numbers. Both are overwritten by each run, so that a run that was cut off is run again.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.functions.sequences import gc_fraction
from binloom.operators.descriptions import first_matches
from binloom.session import discard, written
from jobs import command

log = logging.getLogger("split_families")

RECORDS = "doc_id long, lang string, source string, place long, text string, family string"
SUMMARY = "family string, description string, records long, letters long, gc double"


def split_families(spark: SparkSession, records: str, families: str, output: str, words: int = 4, rows: int = 100_000) -> DataFrame:
    """Write the records of each family and the families' numbers; the records, as written."""
    listed = spark.read.parquet(families).filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("place"), F.concat(F.lit("F"), "item_id").alias("id"), F.array_join(F.slice(F.split("text", " "), 1, words), " ").alias("description")
    )
    read = spark.read.parquet(records).select("doc_id", "lang", "source", "text")
    matched = first_matches(read, "doc_id", "text", listed, "split-families").filter("match is not null")
    found = written(matched.select("doc_id", "lang", "source", F.col("match").alias("place"), "text", F.col("match_id").alias("family")), "split-families")
    dealt = spark.sql("select /*+ rebalance(family) */ * from {found}", found=found)  # small families share a task, a large one is split among many
    dealt.write.mode("overwrite").partitionBy("family").option("maxRecordsPerFile", rows).parquet(f"{output}/records")
    back = spark.read.schema(RECORDS).parquet(f"{output}/records")
    numbers = found.groupBy("family").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("letters"), F.round(F.avg(gc_fraction(F.col("text"))), 9).alias("gc"))
    named = listed.select(F.col("id").alias("family"), "description").join(numbers, "family", "left").select("family", "description", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("letters", F.lit(0)).alias("letters"), "gc")
    named.coalesce(1).write.mode("overwrite").option("compression", "none").json(f"{output}/summary")
    log.info("read %d records and %d families, wrote %d records of %d families to %s", read.count(), listed.count(), back.count(), back.select("family").distinct().count(), output)
    discard(found)
    return back


if __name__ == "__main__":
    command.main(split_families, ["records", "families", "output", "words", "rows"], "jobs/split_families.json")
