"""Streams of sequences. The operators that look at one row at a time work on streams as they are; nothing here holds state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from binloom.functions.sequences import Kmers
from binloom.operators.kmercount import spectra


def read_tables(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def spectrum_stream(rows: DataFrame, sequence: str, by: Kmers) -> DataFrame:
    """The stream with spectra; sequences that are too short have NULL."""
    return spectra(rows, sequence, by, strict=False)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is so far, then stop; a restart goes on where this ended."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
