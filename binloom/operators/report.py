"""Points of scatter plots, and tables for the pages that draw them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators.assign import relabelled
from binloom.schema import NOT_ASSIGNED

#: The colour of points without a label, and those of the labels, which begin with the second.
GRAY = "gainsboro"
PALETTE = (
    "red", "blue", "green", "orange", "yellow", "purple", "DarkOrchid", "olive", "salmon", "brown", "MediumPurple", "LightCoral", "gold", "pink", "cyan", "BurlyWood",
    "chocolate", "crimson", "deeppink", "black", "aquamarine", "aqua", "Darkorange", "darkmagenta", "lightgreen", "greenyellow", "indigo", "lime", "MidnightBlue", "SaddleBrown", "indianred", "khaki",
)
#: Dots an inch, height and width in inches of a figure.
DPI, HEIGHT, WIDTH = 900, 4, 8
#: The source that counts if several are asked for.
ORDER = ("kmeans", "lbl", "dpgmm", "km_lbl", "blast", "ext")


def plot_points(scaffolds: DataFrame, labels: DataFrame | None, dpi: float = DPI, height: float = HEIGHT, width: float = WIDTH, palette: Sequence[str] = PALETTE, strict: bool = False) -> DataFrame:
    """scaffold, x (coverage), y (GC), size, label and color of each scaffold with a label.

    Points without label are gray and come first; the other labels have colours by name, in turn.
    With strict, as many labels as scaffolds are needed.
    """
    if strict and labels is not None and (a := scaffolds.count()) != (b := labels.count()):
        raise ValueError(f"there are {a} scaffolds and {b} labels")
    rows = scaffolds.select("scaffold", F.col("coverage").alias("x"), F.col("GC").alias("y"), "length")
    top = rows.agg(F.max("length").alias("_top"))
    rows = rows.join(F.broadcast(top)).withColumn("size", F.col("length") * 8e-6 * dpi**2 * height * width / F.col("_top")).drop("_top", "length")
    if labels is None:
        return rows.withColumns({"label": F.lit(NOT_ASSIGNED), "color": F.lit("gray")})
    rows = rows.join(labels.select("scaffold", F.col("label").cast("string").alias("label")), "scaffold")
    distinct = rows.select("label").distinct()
    ranked = distinct.filter(F.col("label") != NOT_ASSIGNED).withColumn("_rank", F.row_number().over(Window.orderBy("label")))
    color = F.element_at(F.array(*[F.lit(c) for c in palette]), (F.col("_rank") % len(palette) + 1).cast("int"))
    return rows.join(ranked.select(F.col("label").alias("_label"), color.alias("color")), F.col("label") == F.col("_label"), "left").drop("_label").withColumn("color", F.coalesce("color", F.lit(GRAY)))


def chosen_source(**flags: object) -> str | None:
    """The first of the sources in their order that is asked for; a threshold of 0.0 counts."""
    return next((name for name in ORDER if flags.get(name) is not None and flags[name] is not False), None)


def confident(rows: DataFrame, label: str, threshold: float) -> DataFrame:
    """scaffold and label where its probability is above the threshold, NOT_ASSIGNED elsewhere."""
    return rows.select("scaffold", relabelled(F.col(label).cast("string"), F.col("probability"), threshold).alias("label"))


def page_table(scaffolds: DataFrame, assigned: DataFrame) -> DataFrame:
    """Scaffold, coverage, gc, length and genus, as the pages read them."""
    rows = scaffolds.join(assigned.select("scaffold", "genus"), "scaffold")
    return rows.select(F.col("scaffold").alias("Scaffold"), "coverage", F.col("GC").alias("gc"), "length", "genus")


def square_root(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.sqrt(column))




def axis(points: DataFrame, linear: bool = False) -> dict[str, object]:
    """Scale and ends of the x axis: logarithmic from 1 to the largest x, or linear from 1 to 200."""
    return {"scale": "linear", "from": 1.0, "to": 200.0} if linear else {"scale": "log", "from": 1.0, "to": points.agg(F.max("x")).first()[0]}
