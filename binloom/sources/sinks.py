"""Writers: delimited rows, FASTA by family, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_fasta(header: Column, sequence: Column, width: int = 0) -> Column:
    """A FASTA record; width wraps the sequence."""
    body = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n") if width else sequence
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def write_family_fasta(genes: DataFrame, sequences: DataFrame, markers: DataFrame, path: str) -> None:
    """A folder cog_id=... of records ">gene,cog" for each marker family."""
    rows = genes.join(markers.select("cog_id").distinct(), "cog_id", "left_semi").select("gene_id", "cog_id").join(sequences.select("gene_id", "sequence"), "gene_id")
    rows.select("cog_id", as_fasta(F.concat_ws(",", "gene_id", "cog_id"), F.col("sequence")).alias("value")).write.partitionBy("cog_id").mode("overwrite").text(path)


def write_matched_fasta(matched: DataFrame, path: str) -> None:
    """A folder match_id=... of the records whose description matched."""
    matched.filter("match_id is not null").select("match_id", as_fasta(F.col("header"), F.col("sequence"), 60).alias("value")).write.partitionBy("match_id").mode("overwrite").text(path)


def write_matrix(df: DataFrame, column: str, path: str) -> None:
    df.select(F.array_join(F.col(column).cast("array<string>"), " ").alias("value")).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str, separator: str = ",", header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=separator, header=header)


def write_assignments(scaffolds: DataFrame, assigned: DataFrame, path: str, header: bool = False) -> None:
    """scaffold, coverage, length, GC and genus of the assigned scaffolds."""
    rows = scaffolds.select("scaffold", "coverage", "length", "GC").join(assigned.select("scaffold", "genus"), "scaffold")
    write_rows(rows.select("scaffold", "coverage", "length", "GC", "genus"), path, header=header)
