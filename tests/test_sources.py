"""Readers and writers, on small files written here."""

import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from binloom.functions import names
from binloom.operators import external, relational, report
from binloom.operators.catalog import Database
from binloom.plans import binning, proxies
from binloom.sources import files, sinks

GENES = """gene_oid\tLocus Tag\tSource\tCluster Information\tGene Information\tE-value
1\tt1\tCOG_category\t[J] x\t\t
1\tt1\tCOG0336\tfirst\t\t7.0e-55
1\tt1\tCOG0999\tlast\t\t1.0e-3
1\tt1\tpfam01746\tp\t\t6.8e-34
1\tt1\tScaffold\t\tc1\t
1\tt1\tCoordinates\t\t3..530(+)\t
1\tt1\tDNA_length\t\t528bp\t
1\tt1\tProtein_length\t\t175aa\t
1\tt1\tGC\t\t.66\t
\t\t\t\t\t
2\tt2\tpfam00001\tlost\t\t1e-2
2\tt2\tscaffold\t\tc2\t
"""


def test_gene_rows_fold(spark, tmp_path):
    (tmp_path / "g.tsv").write_text(GENES)
    got = {r.gene_id: r for r in files.genes(spark, str(tmp_path / "g.tsv")).collect()}
    a, b = got["1"], got["2"]
    assert (a.cog_id, a.cog_description, a.pfam, a.scaffold, a.start, a.end, a.strand, a.dna_length, a.protein_length, a.gc) == ("COG0999", "last", "pfam01746", "c1", 3, 530, "+", 528, 175, 0.66)
    assert (b.cog_id, b.cog_Evalue, b.pfam, b.protein_length, b.start) == ("NULL_ST", -1.0, "NULL_ST", 0, None)
    again = {r.gene_id: r for r in files.genes(spark, str(tmp_path / "g.tsv"), skip_first_row=False).collect()}
    assert again["2"].pfam == "pfam00001"
    (tmp_path / "h.tsv").write_text(GENES.replace("scaffold\t\tc2", "other\t\tc2"))
    with pytest.raises(PySparkException, match="gene without scaffold"):
        files.genes(spark, str(tmp_path / "h.tsv")).collect()


def test_gene_paragraphs(spark, tmp_path, caplog):
    """Two paragraphs of one id stay two, wherever files are cut; folded by id they are one."""
    blank = "\t" * 5 + "\n"
    gene = lambda i, n, more="": f"{i}\tt{n}\tCOG_category\tx\t\t\n{i}\tt{n}\tscaffold\t\tc{n}\t\n{more}"
    body = "".join(gene(f"g{n % 40}", n, f"g{n % 40}\tt{n}\tCOG{n:04d}\td\t\t1e-{n % 30}\n" if n % 3 else "") + blank for n in range(120))
    (tmp_path / "g.tsv").write_text(GENES.splitlines()[0] + "\n" + body)
    (tmp_path / "h.tsv").write_text(GENES.splitlines()[0] + "\n" + gene("g1", 500))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("700", "2000", small):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted((r.gene_id, r.locus_tag, r.scaffold, r.cog_id) for r in files.genes(spark, str(tmp_path / "*.tsv"), paragraphs=True).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert found[0] == found[1] == found[2] == sorted([(f"g{n % 40}", f"t{n}", f"c{n}", f"COG{n:04d}" if n % 3 else "NULL_ST") for n in range(120)] + [("g1", "t500", "c500", "NULL_ST")])
    assert files.genes(spark, str(tmp_path / "g.tsv")).count() == 40
    db = Database(spark, str(tmp_path / "db"))
    binning.create_database(db, genes=str(tmp_path / "g.tsv"), paragraphs=True)
    assert db.count("Genes") == 120 and "40 genes have no COG" in caplog.text


def test_fasta(spark, tmp_path):
    (tmp_path / "p.faa").write_text(">11 sg4i_0001 some enzyme [An organism (v2)]\nMKV\nLLA\n>12 sg4i_0002 other [B c]\nMM\n")
    assert [tuple(r) for r in files.proteins(spark, str(tmp_path / "p.faa")).orderBy("gene_id").collect()] == [("11", "sg4i_0001", "some enzyme", "MKVLLA"), ("12", "sg4i_0002", "other", "MM")]
    (tmp_path / "s.fna").write_text(">7 c1 an assembly : c1\nGGCA\nACGT\n")
    assert tuple(files.scaffolds(spark, str(tmp_path / "s.fna")).first()) == ("7", "c1", "GGCAACGT", 8, 0.625)
    (tmp_path / "bad.fna").write_text(">nameless\nACGT\n")
    with pytest.raises(PySparkException, match="not a scaffold header"):
        files.scaffolds(spark, str(tmp_path / "bad.fna")).collect()


def test_lists_coverage_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("COG1 x\nCOG2 y\nCOG1 z\n")
    assert sorted(r[0] for r in files.markers(spark, str(tmp_path / "m.txt")).collect()) == ["COG1", "COG2"]
    assert [r[0] for r in files.markers(spark, str(tmp_path / "m.txt"), header=True).orderBy("cog_id").collect()] == ["COG1", "COG2"]
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError, match="no markers"):
        files.markers(spark, str(tmp_path / "empty.txt"))
    (tmp_path / "c.csv").write_text("id,cov\nc1,2.5\nc1,3.5\nc9,1\n")
    scaffolds = spark.createDataFrame([("sg4i_c1",), ("sg4i_c2",)], "scaffold string")
    got = relational.updated(scaffolds, files.coverage(spark, str(tmp_path / "c.csv")), "scaffold", "coverage", "pos")
    assert {r.scaffold: r.coverage for r in got.collect()} == {"sg4i_c1": 3.5, "sg4i_c2": None}
    sinks.write_matrix(spark.createDataFrame([([1.0, 2.5],)], "row array<double>"), "row", str(tmp_path / "mat"))
    assert files.matrix(spark, str(tmp_path / "mat")).first().row == [1.0, 2.5]
    (tmp_path / "n.tsv").write_text("id\tname\nCOG1\tRibosomal Protein\n")
    assert tuple(files.cog_names(spark, str(tmp_path / "n.tsv")).first()) == ("COG1", "ribosomal protein")


def test_blast_xml(spark, tmp_path):
    hit = "<Hit><Hit_num>{0}</Hit_num><Hit_id>gi|{0}</Hit_id><Hit_def>x [A b]</Hit_def><Hit_hsps><Hsp><Hsp_bit-score>{1}</Hsp_bit-score><Hsp_score>9</Hsp_score><Hsp_evalue>0.5</Hsp_evalue></Hsp><Hsp><Hsp_bit-score>1</Hsp_bit-score></Hsp></Hit_hsps></Hit>"
    body = "".join(hit.format(i, 100 - i) for i in range(1, 9))
    (tmp_path / "b.xml").write_text(f"<BlastOutput><BlastOutput_iterations><Iteration><Iteration_iter-num>1</Iteration_iter-num><Iteration_hits>{body}</Iteration_hits></Iteration><Iteration><Iteration_iter-num>2</Iteration_iter-num><Iteration_hits>{hit.format(1, 1)}</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>")
    hits = files.blast_xml(spark, str(tmp_path / "b.xml")).first().hits
    assert len(hits) == 5 and hits[0].title == "gi|1 x [A b]" and [h.bits for h in hits] == [99.0, 98.0, 97.0, 96.0, 95.0]


def test_organisms(spark):
    one = lambda s, **k: spark.createDataFrame([(s,)], "d string").select(names.organisms(F.col("d"), **k)).first()[0]
    assert one("gi| a [Escherichia coli O157:H7]\x01gi| b [Shigella flexneri]") == ["escherichia coli", "shigella flexneri"]
    assert one("x [[Clostridium] difficile 630]") == ["clostridium difficile"]
    assert one("x [[Clostridium] difficile 630]", compat=True) == ["clostridium] difficile"]
    assert one("ferredoxin [2Fe-2S] [Thermus thermophilus]") == ["thermus thermophilus"]
    assert one("none") == []
    with pytest.raises(PySparkException, match="no organism"):
        spark.createDataFrame([("none",)], "d string").select(names.best_hit_name(F.col("d"))).collect()


def test_keywords(spark, tmp_path):
    df = spark.createDataFrame([("a", "Alpha of the beta"), ("b", "the gamma"), ("c", "nothing")], "header string, text string")
    assert df.select(names.meaningful(F.split("text", " "))).first()[0] == ["Alpha", "beta"]
    got = relational.first_match(df.withColumn("sequence", F.lit("ACGT")), F.col("text"), ["beta alpha", "alpha", "gamma"], ["x", "y", "z"])
    assert {r.header: (r.match, r.match_id) for r in got.collect()} == {"a": (0, "x"), "b": (2, "z"), "c": (None, None)}
    sinks.write_matched_fasta(got, str(tmp_path / "nr"))
    assert spark.read.text(str(tmp_path / "nr")).filter("match_id = 'z'").count() == 2
    with pytest.raises(ValueError, match="needs an id"):
        relational.first_match(df, F.col("text"), ["a"], [])


def test_hits_of_xml_text(spark):
    hit = "<Hit><Hit_num>{0}</Hit_num><Hit_id>gi|{0}</Hit_id><Hit_def>x [A b]</Hit_def><Hit_hsps><Hsp><Hsp_bit-score>{1}</Hsp_bit-score><Hsp_score>9</Hsp_score><Hsp_evalue>0.5</Hsp_evalue></Hsp><Hsp><Hsp_bit-score>1</Hsp_bit-score></Hsp></Hit_hsps></Hit>"
    page = lambda n: f"<BlastOutput><BlastOutput_iterations><Iteration><Iteration_iter-num>1</Iteration_iter-num><Iteration_hits>{''.join(hit.format(i, 100 - i) for i in range(1, n + 1))}</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"
    rows = spark.createDataFrame([("a", True, page(8)), ("b", True, page(0)), ("c", True, page(1)), ("d", False, None)], "gene_id string, ok boolean, value string")
    got = {r.gene_id: r.hits for r in external.searched(rows).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] == [] and [h.bits for h in got["a"]] == [99.0, 98.0, 97.0, 96.0, 95.0]
    assert got["c"][0].title == "gi|1 x [A b]"


def test_search_of_markers(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    markers = spark.createDataFrame([("COG1",), ("COG2",)], "cog_id string")
    with pytest.raises(ValueError, match="no table Genes"):
        external.search_markers(db, markers, str(tmp_path))
    db.replace("Genes", spark.createDataFrame([("1", "COG1"), ("2", "COG2"), ("3", "COG1"), ("4", "COG9")], "gene_id string, cog_id string"))
    with pytest.raises(ValueError, match="no table Sequences"):
        external.search_markers(db, markers, str(tmp_path))
    db.replace("Sequences", spark.createDataFrame([("1", "MK"), ("2", "ML"), ("3", "MM"), ("3", "MN"), ("4", "MO")], "gene_id string, sequence string"))
    with pytest.raises(ValueError, match="no markers"):
        external.search_markers(db, markers.limit(0), str(tmp_path))
    (tmp_path / "COG1.phr").write_text("x")
    with pytest.raises(ValueError, match="no database of COG2"):
        external.search_markers(db, markers, str(tmp_path))
    (tmp_path / "COG2.phr").write_text("x")
    program = tmp_path / "search"
    program.write_text('#!/bin/sh\ncat > /dev/null\necho "$2"\n')
    program.chmod(0o755)
    found = external.search_markers(db, markers, str(tmp_path), program=str(program))
    assert sorted((r.gene_id, r.ok, r.value.strip().rsplit("/", 1)[-1]) for r in found.collect()) == [("1", True, "COG1"), ("2", True, "COG2")]


def test_lines_keep_their_places(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,cov\r\n" + "".join(f"c{i},{i}\r\n" for i in range(5000)) + '"q",1\n')
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.lines(spark, str(tmp_path / "c.csv"), ",", 2).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert len({r.pos.block for r in rows}) > 5 and [r.f[0] for r in rows] == [f"c{i}" for i in range(5000)] + ['"q"']


def test_warning_of_genes_without_cog(spark, caplog):
    rows = spark.createDataFrame([("1", "COG1"), ("2", "NULL_ST")], "gene_id string, cog_id string")
    assert files.warn_without_cog(rows) == 1 and "1 genes have no COG" in caplog.text
    assert files.warn_without_cog(rows.limit(0)) == 0


def test_colours_and_counts_of_points(spark):
    n = len(report.PALETTE) + 3
    scaffolds = spark.range(n + 1).select(F.col("id").alias("scaffold"), F.lit(1.0).alias("coverage"), F.lit(0.5).alias("GC"), (F.col("id") + 1).alias("length"))
    labels = spark.range(n).select(F.col("id").alias("scaffold"), F.format_string("l%03d", "id").alias("label"))
    got = {r.label: r for r in report.plot_points(scaffolds, labels).collect()}
    assert [got[f"l{i:03d}"].color for i in range(n)] == [report.PALETTE[(i + 1) % len(report.PALETTE)] for i in range(n)]
    assert got["l000"].size == pytest.approx(8e-6 * 900**2 * 4 * 8 / (n + 1))
    with pytest.raises(ValueError, match="scaffolds and"):
        report.plot_points(scaffolds, labels, strict=True)


def test_labels_kept_with_scaffolds(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.replace("Scaffolds", spark.createDataFrame([("a", 1.0), ("b", 2.0)], "scaffold string, coverage double"))
    for label in (4, 5):
        binning.store_labels(db, spark.createDataFrame([("a", label)], "scaffold string, label int"))
        assert {r.scaffold: r.label for r in binning.current_labels(db).collect()} == {"a": label, "b": -1}
    assert db.columns("Scaffolds") == ["scaffold", "coverage", "label"]


def test_nothing_stays_in_the_shared_folder(tmp_path):
    """Tables of a session that was stopped, and of a program that ended without stopping its own, are gone."""
    body = f"""
from pyspark.sql import SparkSession
from binloom.plans import proxies
from binloom.session import written
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path.as_uri()}").getOrCreate()
written(spark.range(5)).count()
proxies.database(spark).replace("Numbers", spark.range(3))
import os, sys
assert len([n for n in os.listdir("{tmp_path}") if n.startswith("binloom-")]) == 2
if sys.argv[1] == "stop":
    spark.stop()
    assert not [n for n in os.listdir("{tmp_path}") if n.startswith("binloom-")]
"""
    for how in ("stop", "leave"):
        done = subprocess.run([sys.executable, "-c", body, how], capture_output=True, text=True, timeout=120, check=False, cwd=Path(__file__).resolve().parent.parent)
        assert done.returncode == 0, done.stderr[-1500:]
        for _ in range(50):
            if not (left := list(tmp_path.glob("binloom-*"))):
                break
            time.sleep(0.2)
        assert not left


def test_matrix_keeps_the_sign_of_small_numbers(spark, tmp_path):
    """-2e-7 rounds to -0, as in the SQL."""
    spark.createDataFrame([([-2e-7, 2e-7, -0.5, -0.0000005],)], "embedding array<double>").write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    row = proxies.matrix_file(spark, str(tmp_path)).first().row
    assert [str(x) for x in row] == ["-0.0", "0.0", "-0.5", "-1e-06"]
