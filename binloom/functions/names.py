"""Column functions on descriptions: organisms in brackets, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in descriptions.
STOP_WORDS = ("the", "for", "of")


def _named(words: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.slice(words, 1, 2)))


def organisms(description: Column, compat: bool = False) -> Column:
    """Names "genus species" in lower case, from each bracketed part with two words or more.

    If a bracketed part has one word only, the form [[Genus] species] is looked for as
    well and adds its names. compat keeps an older reading of that form, in which the
    bracket stays in the genus.
    """
    plain = F.regexp_extract_all(description, F.lit(r"\[.+?\]"), F.lit(0))
    words = F.transform(plain, lambda b: F.split(F.regexp_replace(b, r"^\[+|\]+$", ""), " "))
    found = F.transform(F.filter(words, lambda w: F.size(w) > 1), _named)
    if compat:
        whole = F.regexp_extract_all(description, F.lit(r"\[.*?\[(.*?)\]\s*(.*?)\]"), F.lit(0))
        nested = F.transform(F.filter(F.transform(whole, lambda b: F.split(F.regexp_replace(b, r"^\[+|\]+$", ""), " ")), lambda w: F.size(w) > 1), _named)
    else:
        genus, species = (F.regexp_extract_all(description, F.lit(r"\[[^\[\]]*\[([^\[\]]*)\]\s*([^\[\]]*)\]"), F.lit(k)) for k in (1, 2))
        nested = F.filter(F.zip_with(genus, species, lambda g, s: F.lower(F.concat_ws(" ", g, F.split(s, " ")[0]))), lambda x: F.size(F.split(x, " ")) > 1)
    return F.when(F.exists(words, lambda w: F.size(w) < 2), F.concat(found, nested)).otherwise(found)


def genus(organism: Column) -> Column:
    return F.split(organism, " ")[0]


def best_hit_name(title: Column, strict: bool = True) -> Column:
    """First organism of a title; one without raises, or is NULL if not strict."""
    first = F.try_element_at(organisms(title), F.lit(1))
    return F.coalesce(first, F.raise_error(F.concat(F.lit("no organism in "), title))) if strict else first


def meaningful(words: Column) -> Column:
    """Words without the stop words, which count in lower case only."""
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def contains_all(words: Column, keywords: Column) -> Column:
    return F.size(F.array_except(keywords, words)) == 0
