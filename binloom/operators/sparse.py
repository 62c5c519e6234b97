"""Spectra of long k-mers, of which only those that occur are kept: a row for each sequence and k-mer.

Two spectra sum to 1 each, so their L1 distance is 2 less twice the sum of what both have of
each k-mer; that sum is an equality join by k-mer, summed before it is shuffled. Sequences
that share no k-mer are at distance 2 and are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.sequences import Kmers
from binloom.operators.compare import nearest_two
from binloom.operators.kmercount import frequencies, histogram

#: Decimals of a distance, so that the order in which it is summed doesn't matter.
DECIMALS = 9


def spectra(df: DataFrame, key: str, sequence: str, by: Kmers) -> DataFrame:
    """key, kmer, n and freq of the k-mers that occur; sequences without any are no rows."""
    return frequencies(histogram(df, key, sequence, by), key)


def distances(queries: DataFrame, references: DataFrame, query: str, name: str) -> DataFrame:
    """query, name and L1 distance of each query and reference that share a k-mer, from spectra (query, kmer, freq) and (name, kmer, freq)."""
    left = queries.select(F.col(query).alias("_query"), "kmer", F.col("freq").alias("_a"))
    right = references.select(F.col(name).alias("_name"), "kmer", F.col("freq").alias("_b"))
    both = left.join(right, "kmer").groupBy("_query", "_name").agg(F.sum(F.least("_a", "_b")).alias("_shared"))
    return both.select(F.col("_query").alias(query), F.col("_name").alias(name), F.round(2 - 2 * F.col("_shared"), DECIMALS).alias("distance"))


def nearest(queries: DataFrame, references: DataFrame, query: str, name: str) -> DataFrame:
    """query, the nearest reference with its distance, and the distance of the second (NULL if it shares no k-mer); queries that share none with any reference are no rows."""
    return nearest_two(distances(queries, references, query, name), query, name)
