"""The index of descriptions against a comparison of every text with every description."""

import random

import pytest
from pyspark.sql import functions as F

from binloom.operators import descriptions
from binloom.plans import proxies
from binloom.sources import files, sinks


def by_hand(texts, listed):
    """First description, in order, all of whose words a text has."""
    listed = sorted((d for d in listed if d[0] is not None and d[2] is not None), key=lambda d: (d[0], d[1]))
    split = [(place, name, set(d.lower().split(" "))) for place, name, d in listed]
    return [next(((p, n) for p, n, words in split if words <= set(t.lower().split(" "))), (None, None)) if t is not None else (None, None) for t in texts]


def test_first_matches(spark):
    rng = random.Random(2)
    common, rare = ["of", "the", "a"], [f"w{i}" for i in range(40)]
    said = lambda n: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))
    texts = [said(rng.randint(1, 12)) for _ in range(300)] + [None, "", "  ", "Of  THE", "w1 " * 50_000, "ÉTÉ w2", texts_twice := "the w3 of", texts_twice]
    listed = [(100 + i, f"d{i}", said(rng.randint(1, 4))) for i in range(120)] + [(5, "x", "absent of"), (7, "e", ""), (300, "late", "the"), (None, "n", "of"), (8, "n", None), (9, "u", "été"), (12, "b", "of of the"), (12, "a", "w3 the"), (400, "same", "the of")]
    rows = spark.createDataFrame([(i % 305, t, "m", i) for i, t in enumerate(texts)], "doc long, text string, Match string, place int")
    table = spark.createDataFrame(listed, "place int, id string, description string")
    got = descriptions.first_matches(rows, "doc", "text", table)
    assert got.columns == ["doc", "text", "place", "match", "match_id"]
    found = {r.place: (r.match, r.match_id) for r in got.collect()}
    assert [found[i] for i in range(len(texts))] == by_hand(texts, listed)
    assert descriptions.first_matches(rows.limit(0), "doc", "text", table).count() == 0
    with pytest.raises(ValueError, match="no descriptions"):
        descriptions.first_matches(rows, "doc", "text", table.limit(0))


def test_no_nested_loop(spark):
    """All joins go by equal words or keys."""
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i} c") for i in range(50)], "doc_id long, text string")
    words = docs.select("doc_id", F.explode(descriptions.split_words(F.col("text"))).alias("word"))
    listed = proxies.cut_descriptions(docs).select(F.col("place").alias("number"), descriptions.split_words(F.col("description")).alias("keys"))
    plan = descriptions.index(words, listed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    place = {r.number: (r.word, sorted(r.rest)) for r in descriptions.index(words, listed).collect()}
    assert place[0] == ("b0", ["a0"]) and len(place) == listed.count()


def test_records_split_by_description(spark, tmp_path):
    """A sequence database cut into a folder for each family, by the descriptions in the records' headers."""
    (tmp_path / "nr.faa").write_text(">1 ribosomal protein S3 [A b]\nMKV\n>2 DNA gyrase subunit B\nMMM\n>3 unknown\nLL\n>4 gyrase protein S3 ribosomal\nMA\n")
    records = files.fasta(spark, str(tmp_path / "nr.faa"))
    table = spark.createDataFrame([(0, "COG2", "gyrase subunit"), (1, "COG1", "ribosomal protein S3")], "place int, id string, description string")
    sinks.write_matched_fasta(descriptions.first_matches(records, "header", "header", table), str(tmp_path / "out"))
    back = files.fasta(spark, str(tmp_path / "out"))
    assert sorted((r.header[:1], r.sequence) for r in back.collect()) == [("1", "MKV"), ("2", "MMM"), ("4", "MA")]
    assert sorted(p.name for p in (tmp_path / "out").glob("match_id=*")) == ["match_id=COG1", "match_id=COG2"]


def test_matched_texts_meet_no_later_descriptions(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 9))) for _ in range(200)]
    listed = [(i // 2, f"d{i}", " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 3)))) for i in range(150)]
    asked, whole = [], descriptions.first_of_chunk
    monkeypatch.setattr(descriptions, "first_of_chunk", lambda texts, chunk, owner: asked.append((texts.count(), chunk.count())) or whole(texts, chunk, owner))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    got = descriptions.first_matches(rows, "doc", "text", spark.createDataFrame(listed, "place int, id string, description string").repartition(5), first=4)
    assert [(r.match, r.match_id) for r in got.orderBy("doc").collect()] == by_hand(texts, listed)
    assert [n for _, n in asked[:2]] == [4, 32] and [n for n, _ in asked] == sorted({n for n, _ in asked}, reverse=True)
