"""The first of many descriptions all of whose words a text has.

Descriptions are a table, not a list of the plan. Each stands in an inverted index under
its rarest word only, so a text meets the descriptions whose rarest word it has and no
others; the other words of those candidates are then looked up one by one among the text's
words, each an equality join. A description with a word that no text has drops out before
the texts are joined, one whose words are those of an earlier one too.

Only the first match counts, so descriptions are taken in their order, a few first and
then ever more at once, and a text that has a match meets no later ones: what is looked
up grows with the texts, not with texts times descriptions, unless few of them match.

Words are those of names.contains_all: cut at single spaces, in lower case, so two spaces
make an empty word. Spark sends the index to all tasks while its size allows, sorts both
sides beyond that, and splits the texts of a frequent word (adaptive skew joins).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.session import discard, written

#: Descriptions of the first chunk, and how many times as many each chunk has as the one before.
FIRST, GROWTH = 256, 8


def split_words(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.split(F.lower(text), " "))


def index(words: DataFrame, descriptions: DataFrame) -> DataFrame:
    """number, word and rest: descriptions that can match, by their rarest word; words are (text, word), descriptions (number, keys)."""
    seen = words.groupBy("word").agg(F.count("*").alias("n"))
    each = descriptions.select("number", F.size("keys").alias("size"), F.explode("keys").alias("word")).join(seen, "word")
    found = each.groupBy("number", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w")).filter(F.size("w") == F.col("size"))
    return found.select("number", F.col("w")[0]["word"].alias("word"), F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x["word"]).alias("rest"))


def numbered(listed: DataFrame, owner: str) -> DataFrame:
    """The descriptions with number, from 0 without gaps, in the order of place and match_id."""
    rows = written(listed.orderBy("place", "match_id").withColumn("at", F.monotonically_increasing_id()), owner)  # its upper bits are the slice of the order
    before = F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = rows.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.count("*").alias("n")).select("slice", F.coalesce(before, F.lit(0)).alias("before"))  # a row a slice
    out = rows.withColumn("slice", F.shiftright("at", 33)).join(F.broadcast(slices), "slice")
    out = written(out.withColumn("number", F.col("at") - F.shiftleft("slice", 33) + F.col("before")).drop("at", "slice", "before"), owner)
    discard(rows)
    return out


def first_of_chunk(texts: DataFrame, chunk: DataFrame, owner: str) -> DataFrame:
    """key, version and number of the first description of the chunk that each of (key, version, words) has the words of."""
    wanted = chunk.select(F.explode("keys").alias("word")).distinct()
    words = texts.select("key", "version", F.explode("words").alias("word")).join(wanted, "word", "left_semi")
    words = written(words.select("key", "version", "word").distinct(), owner)
    candidates = written(words.join(index(words, chunk.select("number", "keys")), "word").select("key", "version", "number", "rest"), owner)
    whole = candidates.filter(F.size("rest") == 0).select("key", "version", "number")
    asked = candidates.select("key", "version", "number", F.size("rest").alias("size"), F.explode("rest").alias("word"))
    held = asked.join(words, ["key", "version", "word"]).groupBy("key", "version", "number").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n = size")
    found = written(whole.unionByName(held.select("key", "version", "number")).groupBy("key", "version").agg(F.min("number").alias("number")), owner)
    discard(words, candidates)
    return found


def first_matches(rows: DataFrame, key: str, text: str, descriptions: DataFrame, owner: str = "query", first: int = FIRST) -> DataFrame:
    """The rows with match and match_id: place and id of the first description all of whose words the text has, NULL without one.

    descriptions has the columns place (a number, the order), id and description. Rows with equal keys and
    texts have equal matches; NULL texts, NULL keys and NULL descriptions match nothing. Descriptions at one place
    are ordered by their ids. A column named match or match_id is replaced. first: descriptions of the first chunk.
    """
    if descriptions.isEmpty():
        raise ValueError("no descriptions are given")
    kept = [c for c in rows.columns if c.lower() not in ("match", "match_id")]
    listed = descriptions.filter("place is not null and description is not null").select("place", F.col("id").alias("match_id"), F.array_sort(split_words(F.col("description"))).alias("keys"))
    listed = numbered(listed.groupBy("keys").agg(F.min(F.struct("place", "match_id")).alias("d")).select("keys", "d.place", "d.match_id"), owner)
    total = listed.count()
    version = F.xxhash64(F.col(f"`{text}`"))  # texts of one key are told apart
    left = rows.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), version.alias("version"), split_words(F.col(f"`{text}`")).alias("words"))
    low, size, parts = 0, first, []
    while low < total and (low == 0 or not left.isEmpty()):
        chunk = listed.filter(F.col("number").between(low, low + size - 1))
        parts.append(first_of_chunk(left, chunk, owner))
        low, size = low + size, size * GROWTH
        if low < total:
            last, left = left, written(left.join(parts[-1].select("key", "version"), ["key", "version"], "left_anti"), owner)
            discard(last)
    discard(left)
    found = reduce(DataFrame.unionByName, parts) if parts else left.select("key", "version", F.lit(0).cast("long").alias("number")).limit(0)
    found = written(found.join(listed, "number").select(F.col("key").alias("_key"), F.col("version").alias("_version"), F.col("place").alias("match"), "match_id"), owner)
    discard(listed, *parts)
    named = rows.select(*[F.col(f"`{c}`") for c in kept])
    return named.join(found, (named[f"`{key}`"] == found["_key"]) & (F.xxhash64(named[f"`{text}`"]) == found["_version"]), "left").select(*[named[f"`{c}`"] for c in kept], found["match"], found["match_id"])
