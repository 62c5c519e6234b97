"""The jobs: runs over growing input, runs that were cut off, odd rows, command lines."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from jobs import queries
from jobs.bin_arrivals import bin_arrivals
from jobs.command import settings
from jobs.split_families import split_families

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


def expected(sql, documents, benchmark=f"{FOLDER}/benchmark.parquet"):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{documents}')")
    con.sql(f"create view benchmark as select * from read_parquet('{benchmark}')")
    found = con.sql(sql)
    return found.columns, sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found.fetchall()), key=repr)


def rows(df, columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def halves(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    middle = docs.approxQuantile("doc_id", [0.5], 0.0)[0]
    return docs.filter(F.col("doc_id") <= middle).coalesce(1), docs.filter(F.col("doc_id") > middle).coalesce(1)


def test_arrivals_are_taken_once(spark, tmp_path, halves, caplog):
    caplog.set_level(logging.INFO)
    arrived, out, mark = (str(tmp_path / n) for n in ("arrived", "out", "mark"))
    references = f"{FOLDER}/benchmark.parquet"
    run = lambda: bin_arrivals(spark, arrived, references, out, mark)
    halves[0].write.mode("append").parquet(arrived)
    first = {tuple(r) for r in run().collect()}
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("batch=0/**/*.parquet")}
    assert len(first) == halves[0].count() and files
    halves[1].write.mode("append").parquet(arrived)
    whole = run()
    columns, want = expected(queries.BIN_ARRIVALS, f"{FOLDER}/documents.parquet")
    assert rows(whole, columns) == want and first < {tuple(r) for r in whole.collect()}
    assert files == {p: p.stat().st_mtime_ns for p in Path(out).rglob("batch=0/**/*.parquet")}  # not written again
    assert f"took {halves[1].count()} new sequences" in caplog.text and f"batch 1: read {halves[1].count()} sequences, wrote {halves[1].count()} rows" in caplog.text
    assert rows(run(), columns) == want and "took 0 new sequences" in caplog.text
    for f in Path(mark, "commits").glob("*1*"):  # as if the last run had been cut off after it had written its batch
        f.unlink()
    assert rows(run(), columns) == want
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_arrivals_in_any_batches(spark, tmp_path):
    """One file a batch, odd rows among them, gives what one batch gives."""
    texts = [(1, "acgtacgt", "x", "en"), (2, None, "x", None), (3, "", "x", "en"), (4, "a", "x", "d e/=1"), (5, "ACGTN" * 40_000, "x", "en"), (5, "ACGTN" * 40_000, "x", "en"), (None, "ttttt", "x", "7"), (8, "zzz", "x", "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, genus string, lang string")
    references = str(tmp_path / "references")
    spark.createDataFrame([(1, "ACGTACGTAC"), (2, "TTTTTTTT"), (3, "NNN"), (4, None)], "item_id int, text string").write.parquet(references)
    docs.repartition(4, "doc_id").write.parquet(str(tmp_path / "four"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    got = [bin_arrivals(spark, str(tmp_path / n), references, str(tmp_path / f"{n}-out"), str(tmp_path / f"{n}-mark"), files=1) for n in ("four", "one")]
    found = [sorted(map(tuple, g.collect()), key=repr) for g in got]
    assert found[0] == found[1] and len(found[0]) == len(texts)
    assert {(r.doc_id, r.genus, r.lang) for r in got[0].collect()} >= {(1, "1", "en"), (None, "2", "7"), (4, "not assigned", "d e/=1"), (2, "not assigned", None), (8, "not assigned", "en")}
    assert len(list((tmp_path / "four-out").glob("batch=*"))) > 1
    (tmp_path / "none").mkdir()
    docs.limit(0).write.mode("append").parquet(str(tmp_path / "none"))
    assert bin_arrivals(spark, str(tmp_path / "none"), references, str(tmp_path / "none-out"), str(tmp_path / "none-mark")).count() == 0


def test_families(spark, tmp_path, halves, caplog):
    caplog.set_level(logging.INFO)
    records, out, families = str(tmp_path / "records"), str(tmp_path / "out"), f"{FOLDER}/benchmark.parquet"
    halves[0].write.parquet(records)
    split_families(spark, records, families, out)
    halves[1].write.mode("append").parquet(records)
    for _ in (0, 1):
        back = split_families(spark, records, families, out).select("doc_id", "lang", "source", "place", "family", F.length("text").alias("letters"))
        columns, want = expected(queries.SPLIT_FAMILIES, f"{FOLDER}/documents.parquet")
        assert rows(back, columns) == want and want
    numbers = {r.family: (r.records, r.letters) for r in spark.read.json(f"{out}/summary").collect()}
    assert len(numbers) == spark.read.parquet(families).count()
    assert {k: v for k, v in numbers.items() if v[0]} == {r.family: (r.n, r.letters) for r in back.groupBy("family").agg(F.count("*").alias("n"), F.sum("letters").alias("letters")).collect()}
    assert f"wrote {len(want)} records" in caplog.text
    assert len(list(Path(out, "records").glob("family=*"))) == len({r[columns.index("family")] for r in want})
    few = spark.read.parquet(families).filter("item_id = 0")  # families that are gone leave nothing behind
    few.write.parquet(str(tmp_path / "few"))
    assert {r.family for r in split_families(spark, records, str(tmp_path / "few"), out, words=1).collect()} <= {"F0"}
    few.limit(0).write.parquet(str(tmp_path / "no"))
    with pytest.raises(ValueError, match="no descriptions"):
        split_families(spark, records, str(tmp_path / "no"), out)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    columns, want = expected(queries.ORACLE_SQL[name], f"{FOLDER}/documents.parquet")
    got = driver.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns) and rows(got, columns) == want


def test_command_line(spark, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps(json.loads((ROOT / "jobs/bin_arrivals.json").read_text()) | {"references": f"{FOLDER}/benchmark.parquet"}))
    assert settings(spark, str(config), {"k": "3", "ratio": None, "largest": "0.5"}).items() >= {"k": 3, "ratio": 0.95, "largest": 0.5}.items()
    with pytest.raises(ValueError, match="has no other"):
        settings(spark, str(config), {"other": "1"})
    args = ["--config", str(config), "--sequences", f"{FOLDER}/{{documents.parquet}}", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run([sys.executable, "-m", "jobs.bin_arrivals", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"took {n} new sequences" in done.stderr and spark.read.parquet(str(tmp_path / "out")).count() == n
