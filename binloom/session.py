"""Sessions, tables and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Arrow batches between the JVM and Python hold rows of whole documents, so they are bounded by bytes as well.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless their import path already leads to it, and bound Arrow batches where the session has its defaults."""
    for name, (default, ours) in BATCHES.items():
        if default is None and not spark.sparkContext.getConf().contains(name) or spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    home = str(PACKAGE.parent)
    reach = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in reach or getattr(spark.sparkContext, "_binloom_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="binloom-")
    with zipfile.ZipFile(f"{folder}/binloom.zip", "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(f"{folder}/binloom.zip")
    spark.sparkContext._binloom_sent = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the executors first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir.

    Only where it is unset on one machine, as in tests, a temporary one is made; on a cluster
    that would be a folder which executors don't share, so it is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_binloom_folder", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="binloom-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = context._binloom_folder = Path(path).as_uri()
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, owner: str = "query") -> str:
    """A name of its own for a table or files in the shared folder, which go when the session stops or, if nothing stops it, when the program ends."""
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/binloom-{context.applicationId}-{owner}-{uuid.uuid4().hex}"
    if not getattr(context, "_binloom_leaving", False):
        context._binloom_leaving, stop = True, context.stop

        def clear() -> None:
            if context._jsc is not None:  # not stopped yet
                with contextlib.suppress(Exception):
                    delete_written(spark, "*")

        def leave() -> None:
            clear()
            stop()

        context.stop = leave
        atexit.register(clear)
    return path


def written(df: DataFrame, owner: str = "query") -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read again: cuts the lineage.

    discard() and delete_written() remove such tables; what is left goes when the session stops.
    """
    spark = df.sparkSession
    path = new_folder(spark, owner)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_binloom_path"] = path
    return out


def _delete(spark: SparkSession, pattern: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(path) or []:
        files.delete(status.getPath(), True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_binloom_path", None):
            _delete(df.sparkSession, path)


def delete_written(spark: SparkSession, owner: str) -> None:
    """Remove all tables that written() made for this owner in this application."""
    _delete(spark, f"{shared_folder(spark)}/binloom-{spark.sparkContext.applicationId}-{owner}-*")

