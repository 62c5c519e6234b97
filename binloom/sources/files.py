"""Readers of the binning engine's files, as DataFrames."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.functions.sequences import gc_fraction
from binloom.schema import NULL_TEXT

log = logging.getLogger(__name__)

#: Headers of the protein and scaffold files.
PROTEIN_HEADER = r"^([0-9]+)\s+(sg4i_[0-9]+)\s+(.*)\s+(\[.*\])"
SCAFFOLD_HEADER = r"^(.+?)\s+(.+?)\s+(.+)"
SCAFFOLD_PREFIX = "sg4i_"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and sequence of each record; records may be split between tasks at their start."""
    records = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    rows = records.select(F.regexp_replace(lines[0], "\r$", "").alias("header"), F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), r"\s", "").alias("sequence"))
    return rows.filter((F.length("header") > 0) | (F.length("sequence") > 0))


def proteins(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, locus_tag, description and sequence of a protein file; other headers raise."""
    part = lambda k: F.regexp_extract("header", PROTEIN_HEADER, k)
    rows = fasta(spark, path).withColumn("header", F.when(F.col("header").rlike(PROTEIN_HEADER), F.col("header")).otherwise(F.raise_error(F.concat(F.lit("not a protein header: "), "header"))))
    return rows.select(part(1).alias("gene_id"), part(2).alias("locus_tag"), part(3).alias("description"), "sequence")


def scaffolds(spark: SparkSession, path: str) -> DataFrame:
    """scaffold_id, scaffold, sequence, length and GC of a scaffold file; other headers raise."""
    part = lambda k: F.regexp_extract("header", SCAFFOLD_HEADER, k)
    rows = fasta(spark, path).withColumn("header", F.when(F.col("header").rlike(SCAFFOLD_HEADER), F.col("header")).otherwise(F.raise_error(F.concat(F.lit("not a scaffold header: "), "header"))))
    return rows.select(part(1).alias("scaffold_id"), part(2).alias("scaffold"), "sequence", F.length("sequence").cast("long").alias("length"), gc_fraction(F.col("sequence")).alias("GC"))


def lines(spark: SparkSession, path: str, separator: str, fields: int) -> DataFrame:
    """pos and f (the fields) of each line of files with a header; pos orders the lines as they stand in the files.

    Files are split between tasks: a line's place is its file, the split's start and the line's number in it.
    """
    schema = T.StructType([T.StructField(f"f{k}", T.StringType()) for k in range(fields)])
    rows = spark.read.csv(path, sep=separator, header=True, schema=schema, quote="", escape="")
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select(pos.alias("pos"), F.array(*[F.coalesce(f"f{k}", F.lit("")) for k in range(fields)]).alias("f"))


def gene_rows(spark: SparkSession, path: str) -> DataFrame:
    """pos and the six fields of each row of a gene table; the header is left out."""
    return lines(spark, path, "\t", 6)


def gene_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of gene_rows() with paragraph: its file and number there, counted by the rows without id before it.

    Each split of a file counts its own; the sums of the splits before it, a row a split, make the number
    the same wherever splits fall, within a paragraph too. Lines are read as text, since blank ones count.
    """
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(path).select(pos.alias("pos"), F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    ends = (F.coalesce(F.try_element_at("f", F.lit(1)), F.lit("")) == "").cast("long")
    split = [F.col("pos.file").alias("_file"), F.col("pos.block").alias("_block")]
    marked = rows.select("*", *split, ends.alias("_ends"))
    in_split = Window.partitionBy("_file", "_block").orderBy("pos.line")
    own = F.sum("_ends").over(in_split)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = marked.groupBy("_file", "_block").agg(F.sum("_ends").alias("_n")).select("_file", "_block", before.alias("_before"))
    numbered = marked.withColumns({"_own": own, "_line": F.row_number().over(in_split)}).join(splits, ["_file", "_block"])
    return numbered.filter("_block > 0 or _line > 1").select("pos", "f", F.struct(F.col("_file").alias("file"), (F.col("_before") + F.col("_own")).alias("number")).alias("paragraph"))


def folded_genes(rows: DataFrame, skip_first_row: bool = True, paragraphs: bool = False) -> DataFrame:
    """A row for each gene from the rows that describe it; of several rows of a kind the last counts.

    Rows of a gene are those with its id, or with paragraphs on, given rows of gene_paragraphs(), those up to a row without id, whose first names
    the gene: two paragraphs of one id are two genes. With skip_first_row the first row only names the gene.
    A gene without scaffold raises.
    """
    field = lambda k: F.coalesce(F.try_element_at("f", F.lit(k + 1)), F.lit(""))
    named = rows.select("pos", *[field(k).alias(c) for k, c in enumerate(("gene_id", "tag", "kind", "cluster", "info", "evalue"))], *["paragraph"] * paragraphs).filter("gene_id <> ''")
    named = named.withColumns({"low": F.lower("kind"), "own": F.col("paragraph" if paragraphs else "gene_id")})
    first = named.groupBy("own").agg(F.min("pos").alias("first"), F.min_by("tag", "pos").alias("locus_tag"), F.min_by("gene_id", "pos").alias("gene_id"))
    used = named.join(first.select("own", "first"), "own").filter(F.col("pos") > F.col("first")) if skip_first_row else named
    cog, pfam = F.col("kind").startswith("COG") & (F.col("kind") != "COG_category"), F.col("low").startswith("pfam")
    last = lambda column, where: F.max_by(F.when(where, column), F.when(where, F.col("pos")))
    number = lambda column, pattern: F.try_to_number(F.regexp_extract(column, pattern, 1), F.lit("9999999999")).cast("long")
    is_ = lambda name: F.col("low") == name
    place = r"^([0-9]+)\.+([0-9]+)\(([+-])\)"
    info = lambda name: last(F.col("info"), is_(name))
    out = used.groupBy("own").agg(
        last(F.col("kind"), cog).alias("cog_id"), last(F.col("cluster"), cog).alias("cog_description"), last(F.col("evalue"), cog).alias("cog_Evalue"), info("scaffold").alias("scaffold"),
        last(F.col("kind"), pfam).alias("pfam"), last(F.col("cluster"), pfam).alias("pfam_description"), last(F.col("evalue"), pfam).alias("pfam_Evalue"),
        info("dna_length").alias("dna"), info("protein_length").alias("protein"), info("coordinates").alias("at"), info("gc").alias("gc"),
    )
    out = first.join(out, "own", "left")
    return out.select(
        "gene_id", "locus_tag", F.coalesce("cog_id", F.lit(NULL_TEXT)).alias("cog_id"), F.coalesce("cog_description", F.lit(NULL_TEXT)).alias("cog_description"), F.coalesce(F.col("cog_Evalue").cast("double"), F.lit(-1.0)).alias("cog_Evalue"),
        F.coalesce("scaffold", F.raise_error(F.concat(F.lit("gene without scaffold: "), "gene_id"))).alias("scaffold"),
        F.coalesce("pfam", F.lit(NULL_TEXT)).alias("pfam"), F.coalesce("pfam_description", F.lit(NULL_TEXT)).alias("pfam_description"), F.coalesce(F.col("pfam_Evalue").cast("double"), F.lit(-1.0)).alias("pfam_Evalue"),
        number(F.col("dna"), "^([0-9]+)").alias("dna_length"), F.coalesce(number(F.col("protein"), "^([0-9]+)"), F.lit(0).cast("long")).alias("protein_length"),
        number(F.col("at"), place).alias("start"), F.try_to_number(F.regexp_extract("at", place, 2), F.lit("9999999999")).cast("long").alias("end"), F.regexp_extract("at", place, 3).alias("strand"), F.expr("try_cast(gc as double)").alias("gc"),
    )


def genes(spark: SparkSession, path: str, skip_first_row: bool = True, paragraphs: bool = False) -> DataFrame:
    return folded_genes(gene_paragraphs(spark, path) if paragraphs else gene_rows(spark, path), skip_first_row, paragraphs)


def warn_without_cog(rows: DataFrame) -> int:
    """How many genes have no COG; a warning says so."""
    n = rows.filter(F.col("cog_id") == NULL_TEXT).count()
    if n:
        log.warning("%d genes have no COG", n)
    return n


def coverage(spark: SparkSession, path: str, prefix: str = SCAFFOLD_PREFIX) -> DataFrame:
    """scaffold, coverage and pos of a coverage file with a header; a value that is no number raises."""
    return lines(spark, path, ",", 2).select(F.concat(F.lit(prefix), F.col("f")[0]).alias("scaffold"), F.col("f")[1].cast("double").alias("coverage"), "pos")


def markers(spark: SparkSession, path: str, separator: str = " ", header: bool = False) -> DataFrame:
    """Distinct first fields, as cog_id; an empty list raises."""
    schema = T.StructType([T.StructField("cog_id", T.StringType())])
    rows = spark.read.csv(path, sep=separator, header=header, schema=schema, enforceSchema=True).filter("cog_id is not null").distinct()
    if rows.isEmpty():
        raise ValueError(f"there are no markers in {path}")
    return rows


def cog_names(spark: SparkSession, path: str) -> DataFrame:
    """cog_id and its name in lower case, from a table with a header."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(rows.columns[0]).alias("cog_id"), F.lower(rows.columns[1]).alias("name"))


HSP = T.StructType([T.StructField("Hsp_bit-score", T.DoubleType()), T.StructField("Hsp_score", T.DoubleType()), T.StructField("Hsp_evalue", T.DoubleType())])
HIT = T.StructType([T.StructField("Hit_num", T.LongType()), T.StructField("Hit_id", T.StringType()), T.StructField("Hit_def", T.StringType()), T.StructField("Hit_hsps", T.StructType([T.StructField("Hsp", T.ArrayType(HSP))]))])
ITERATION = T.StructType([T.StructField("Iteration_iter-num", T.LongType()), T.StructField("Iteration_hits", T.StructType([T.StructField("Hit", T.ArrayType(HIT))]))])
HITS = "array<struct<title:string,evalue:double,score:double,bits:double>>"


def first_of(hits: Column, n: int) -> Column:
    """The first n hits by their numbers, each by its first alignment; none is an empty array."""
    best = lambda h: h["Hit_hsps"]["Hsp"][0]
    made = F.transform(F.slice(F.array_sort(hits), 1, n), lambda h: F.struct(F.concat_ws(" ", h["Hit_id"], h["Hit_def"]).alias("title"), best(h)["Hsp_evalue"].alias("evalue"), best(h)["Hsp_score"].alias("score"), best(h)["Hsp_bit-score"].alias("bits")))
    return F.coalesce(made, F.array().cast(HITS))


def hits_of_xml(xml: Column, n: int = 5) -> Column:
    """The first n hits of the first query in a search's XML, as blast_xml reads them from files; NULL for NULL."""
    whole = T.StructType([T.StructField("BlastOutput_iterations", T.StructType([T.StructField("Iteration", T.ArrayType(ITERATION))]))])
    first = F.array_sort(F.from_xml(xml, whole)["BlastOutput_iterations"]["Iteration"])[0]
    return F.when(xml.isNotNull(), first_of(first["Iteration_hits"]["Hit"], n))


def blast_xml(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """file and hits (title, evalue, score, bits; the first n of a file's first query, by their first alignment)."""
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(ITERATION).load(path).withColumn("file", F.input_file_name())
    first = rows.groupBy("file").agg(F.min_by("Iteration_hits.Hit", "`Iteration_iter-num`").alias("hits"))
    return first.select("file", first_of(F.col("hits"), n).alias("hits"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A row of numbers for each line of a text file."""
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("row"))
