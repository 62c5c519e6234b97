"""Column functions on arrays: distances, spectra codecs, hit lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from binloom.schema import HIT_SEPARATOR, SPECTRUM_SEPARATOR


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, without a root."""
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2(a, b))


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest value."""
    return F.array_position(a, F.array_max(a)) - 1


def encode_spectrum(spectrum: Column) -> Column:
    return F.array_join(spectrum.cast("array<string>"), SPECTRUM_SEPARATOR)


def decode_spectrum(text: Column) -> Column:
    return F.transform(F.split(text, SPECTRUM_SEPARATOR), lambda x: x.cast("double"))


def encode_hits(hits: Column, field: str) -> Column:
    """One field of a list of hits as text."""
    return F.array_join(F.transform(hits, lambda h: h[field].cast("string")), HIT_SEPARATOR)


def decode_hits(titles: Column, evalues: Column, scores: Column, bits: Column) -> Column:
    """Hits from their four texts."""
    e, s, b = (F.split(c, HIT_SEPARATOR) for c in (evalues, scores, bits))
    number = lambda part, i: F.get(part, i).cast("double")
    return F.transform(F.split(titles, HIT_SEPARATOR), lambda t, i: F.struct(t.alias("title"), number(e, i).alias("evalue"), number(s, i).alias("score"), number(b, i).alias("bits")))


def first_hits(hits: Column, n: int = 5) -> Column:
    return F.slice(hits, 1, n)


def rounded(x: Column, digits: int) -> Column:
    """x rounded half away from zero, with its sign where nothing else is left: F.round makes 0 of -0.0000001, not -0."""
    r = F.round(x, digits)
    return F.when((r == 0) & x.cast("string").startswith("-"), -r).otherwise(r)
