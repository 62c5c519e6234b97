"""Work done outside Spark's operators: external searches, functions over many arguments."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.operators.catalog import Database
from binloom.operators.relational import exactly_one, of_markers
from binloom.sources import files


def parallel(rows: DataFrame, key: str, value: str, function: Callable[[object], str | None]) -> DataFrame:
    """key, ok, value and error of a function of each row's value; failures are rows too."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, v in zip(frame[key], frame[value], strict=True):
                try:
                    out.append((k, True, function(v), None))
                except Exception as e:  # noqa: BLE001  # told in the result
                    out.append((k, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "ok", "value", "error"])

    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, ok boolean, value string, error string")


def failed(results: DataFrame) -> DataFrame:
    return results.filter("not ok").drop("value")


def blast(sequences: DataFrame, database: str | Column, program: str = "blastp", evalue: float = 0.001, key: str = "gene_id", sequence: str = "sequence", batches: int | None = None) -> DataFrame:
    """key, ok, value (the program's XML) and error of a search of each sequence.

    The program and its database, one for all or a column's, have to be on every executor. An empty sequence, and any message of the program, is a failure.
    """

    def search(task: object) -> str:
        database, _, text = str(task).partition("\n")
        if not text:
            raise ValueError("the sequence is empty")
        done = subprocess.run([program, "-db", database, "-evalue", str(evalue), "-outfmt", "5"], input=f">query\n{text}\n", capture_output=True, text=True, check=False)
        if done.stderr or done.returncode:
            raise RuntimeError(done.stderr.strip() or f"{program} ended with {done.returncode}")
        return done.stdout

    rows = sequences.repartition(batches, key) if batches else sequences
    task = F.concat(F.lit(database) if isinstance(database, str) else database, F.lit("\n"), F.coalesce(F.col(sequence), F.lit("")))
    return parallel(rows.select(key, task.alias("task")), key, "task", search)


def searched(results: DataFrame, key: str = "gene_id", n: int = 5) -> DataFrame:
    """key and hits of the searches of blast() that ended well, as a table of results holds them."""
    return results.filter("ok").select(key, files.hits_of_xml(F.col("value"), n).alias("hits"))


def search_markers(db: Database, markers: DataFrame, databases: str, genes: str = "Genes", sequences: str = "Sequences", **options: object) -> DataFrame:
    """key, ok, value and error of a search of each marker gene's sequence in its family's database, the file of that name in a folder.

    Tables that are missing, no markers, and families without database raise before anything runs. Genes
    with no sequence or several are left out.
    """
    for name in (genes, sequences):
        db.exists(name, raise_error=True)
    families = sorted(r.cog_id for r in markers.select("cog_id").distinct().collect())  # a list given by hand
    if not families:
        raise ValueError("there are no markers")
    there = db.spark.read.format("binaryFile").option("pathGlobFilter", "*.phr").load(databases).select(F.regexp_extract("path", r"([^/]+)\.phr$", 1).alias("cog_id"))
    if missing := sorted(set(families) - {r.cog_id for r in there.collect()}):
        raise ValueError(f"there is no database of {', '.join(missing)}")
    rows = exactly_one(of_markers(db.table(genes).select("gene_id", "cog_id"), markers, "cog_id"), db.table(sequences).select("gene_id", "sequence"), "gene_id")
    return blast(rows, F.concat(F.lit(f"{databases.removeprefix('file://')}/"), "cog_id"), **options)
