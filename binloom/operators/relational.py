"""Joins and updates that the binning steps are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unassigned(rows: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the assigned ones."""
    return rows.join(assigned.select(key), key, "left_anti")


def of_markers(rows: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a marker; repeated markers don't matter."""
    return rows.join(markers.select(key), key, "left_semi")


def updated(rows: DataFrame, values: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows with the last value of their key, NULL without one; values of other keys are left out."""
    last = values.groupBy(key).agg(F.max_by(value, order).alias(value))
    return rows.join(last, key, "left")


def exactly_one(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows joined to the one other row of their key; keys with none or several are left out."""
    single = others.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others.columns if c != key]).filter("_n = 1").drop("_n")
    return rows.join(single, key)


def with_label(rows: DataFrame, labels: DataFrame, key: str, label: str, default: object = -1) -> DataFrame:
    """Rows with their label, or the default."""
    return rows.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def united(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables, columns matched by name and sorted."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(*sorted(t.columns)) for t in tables])


def set_where(rows: DataFrame, values: dict[str, object], where: dict[str, object]) -> DataFrame:
    """Rows with some columns set where all of others equal given values."""
    condition = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in where.items()], F.lit(True))
    return rows.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other doesn't have."""
    return a.subtract(b).unionByName(b.subtract(a))


def first_match(rows: DataFrame, text: Column, descriptions: list[str], ids: list[str]) -> DataFrame:
    """Rows with the number and id of the first description all of whose words the text has; others have NULL.

    Words are split at single spaces, in lower case. Descriptions are a short parameter list, which the plan holds;
    descriptions.first_matches takes a table of them.
    """
    if not descriptions:
        raise ValueError("no descriptions are given")
    if len(ids) != len(descriptions):
        raise ValueError("a description needs an id")
    words = F.split(F.lower(text), " ")
    listed = F.array(*[F.struct(F.lit(i).alias("match"), F.lit(ids[i]).alias("match_id"), F.array(*[F.lit(w) for w in d.lower().split(" ")]).alias("keys")) for i, d in enumerate(descriptions)])
    hit = F.filter(listed, lambda d: F.size(F.array_except(d["keys"], words)) == 0)
    first = F.try_element_at(hit, F.lit(1))
    return rows.withColumn("match", first["match"]).withColumn("match_id", first["match_id"])
