"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source_size times. Documents are ordered
within their source by size class, then by a hash of their id and text; expected copies are summed
along that order from one offset drawn for the source, and a document is emitted once for
each integer that its own step crosses. Sizes thus spread evenly over what is kept, and
the words taken from a source stay within about a document's size of the target.

The running sum is never taken over a whole source in one task: counts of (class, bucket)
give each bucket its start, and rows are numbered inside a bucket only. A source has a few
hundred classes at most, a class BUCKETS buckets.

Everything here is DataFrame code. Null and blank texts have size 0 and are taken with
their own class; a null source is a source like the others, sorted last; rows of one
id are separate rows, in the order of their sizes and of their texts' hashes, so that
only equal rows tie and lie in one bucket; ids may have any type; an empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
#: Multiplier, increment and modulus of a linear congruential hash.
MULTIPLY, ADD, MODULUS = 1103515245, 12345, 1 << 31


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def size_class(size: Column) -> Column:
    """Eight classes to each doubling of the size."""
    bits = F.length(F.bin(size))
    return F.when(size < 1, F.lit(0)).otherwise(bits * 8 + F.call_function("shiftright", size * 8, bits - 1).cast("int"))


def levels(sizes: DataFrame, source: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """The target of each source, from (source, source_size): a row for each source; one named "null" comes last.

    Targets are weight times a common level, or most times the source's size where that is
    less: the level at which they sum to share times all sizes. Sources sorted by the level
    at which they reach their limit are full up to the first whose own level is enough.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col(source) == "null", source)) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / open_weight
    found = full.withColumn("_level", level).withColumn("_place", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct("_place", "_level"))).over(everything)
    target = F.coalesce(F.least(F.col("_limit"), first["_level"] * F.col("_weight")), F.col("_limit"))
    return found.withColumn("target", target).select(source, "_rank", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix has the document).

    With carry, a struct column "row" holds all columns of the documents as well.
    """
    named = F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("s:"), F.col(source).cast("string")))
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    number = F.pmod(F.coalesce(F.col("_id").cast("long") if whole else F.xxhash64("_id"), F.lit(-1)), F.lit(MODULUS)) + F.conv(F.substring("_text_hash", 1, 8), 16, 10).cast("long")
    mark = (F.pmod(number, F.lit(MODULUS)) * MULTIPLY + ADD) % MODULUS
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    sized = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_raw"), named.alias("_source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_text_hash"), *carried)
    sized = sized.withColumn("_class", size_class(F.col("size"))).withColumn("_mark", mark)
    sized = sized.withColumn("_bucket", (F.col("_mark") / (MODULUS // BUCKETS)).cast("int"))
    buckets = sized.groupBy("_source", "_class", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    classes = buckets.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    sizes = classes.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    upto = Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_source", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select("_source", "_class", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    starts = starts.join(levels(sizes, "_source", weights, share, most), "_source")
    within = buckets.select("_source", "_class", "_bucket", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_skip"))
    rows = sized.join(within.join(starts, ["_source", "_class"]), ["_source", "_class", "_bucket"])
    place = F.col("_start") + F.col("_skip") + F.row_number().over(Window.partitionBy("_source", "_class", "_bucket").orderBy("_mark", F.col("_id").asc_nulls_first(), "size", "_text_hash"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_raw").cast("string"), F.lit("")), F.col("_rank").cast("string")).cast("binary"))
    offset = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("_place") * F.col("_step") + F.col("_offset")) - F.floor((F.col("_place") - 1) * F.col("_step") + F.col("_offset"))
    rows = rows.withColumn("_place", place).withColumn("_step", step).withColumn("_offset", offset)
    copies = F.least(F.greatest(crossed, F.lit(0)), F.ceil("_step")).cast("long")
    return rows.select(F.col("_id").alias(doc_id), F.col("_raw").alias(source), "size", "source_size", "target", copies.alias("copies"), *["row"] * carry)


def emitted(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix, each as often as the mix has it."""
    mixed = mix(docs, carry=True, **options).filter("copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


ORACLE = f"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         (((coalesce(doc_id, -1) % {MODULUS} + {MODULUS}) % {MODULUS} + cast('0x' || substr(md5(coalesce(text, '')), 1, 8) as bigint)) % {MODULUS} * {MULTIPLY} + {ADD}) % {MODULUS} as mark
  from documents),
classed as (
  select *, case when size < 1 then 0 else len(bin(size)) * 8 + ((size * 8) >> (len(bin(size)) - 1)) end as class from sized),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) - 1 as place
  from classed group by source),
weighed as (
  select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as full_size from sources),
levels as (
  select *, row_number() over o as k,
         (sum(source_size) over () * 1.5::double - coalesce(sum(full_size) over (order by full_size / weight, place rows between unbounded preceding and 1 preceding), 0.0::double))
           / sum(weight) over (order by full_size / weight, place rows between current row and unbounded following) as level
  from weighed window o as (order by full_size / weight, place)),
chosen as (select min_by(level, k) as level from levels where level * weight <= full_size),
targets as (
  select l.source, l.source_size, coalesce(least(l.full_size, c.level * l.weight), l.full_size) as target,
         cast('0x' || substr(md5('17:' || coalesce(l.source, '') || ':' || cast(l.place as varchar)), 1, 8) as bigint) / 4294967296.0::double as u
  from levels l, chosen c),
placed as (
  select doc_id, size, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0 end as step,
         row_number() over (partition by d.source order by class, mark, doc_id) as k
  from classed d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(least(greatest(floor(k * step + u) - floor((k - 1) * step + u), 0), ceil(step)) as bigint) * size as taken
from placed
"""
