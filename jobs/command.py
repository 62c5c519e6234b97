"""What the jobs' command lines share: settings from a JSON file, paths and values from arguments."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

from binloom.session import ship


def settings(spark: SparkSession, path: str, given: dict[str, str | None]) -> dict[str, object]:
    """The settings of a JSON file, read by Spark, with those given instead where they are."""
    found = spark.read.json(path, multiLine=True).first().asDict()
    if unknown := {k for k, v in given.items() if v is not None} - set(found):
        raise ValueError(f"the config file has no {', '.join(sorted(unknown))}")
    return found | {k: type(found[k])(v) for k, v in given.items() if v is not None}


def main(job: Callable[..., object], names: list[str], config: str, argv: list[str] | None = None) -> None:
    """Make a session, run the job with its settings and stop the session."""
    parser = argparse.ArgumentParser(description=job.__doc__)
    parser.add_argument("--config", default=config)
    for name in names:
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    path = given.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__name__).getOrCreate()
    try:
        ship(spark)
        job(spark, **settings(spark, path, given))
    finally:
        spark.stop()
