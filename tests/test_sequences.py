"""K-mer counts, ranks, distances: golden vectors and properties."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from binloom.functions import arrays
from binloom.functions.sequences import Kmers, gc_fraction, kmer_rank, vector_rank
from binloom.operators import kmercount

FIRST = "attgtaggcctgcatgaact"
UNKNOWN = "atnntagnnngcatgaact"
GOLDEN = {
    (FIRST, 1): [5, 4, 5, 6],
    (FIRST, 2): [1, 1, 1, 2, 1, 1, 0, 2, 1, 2, 1, 1, 1, 0, 3, 1],
    (UNKNOWN, 2): [1, 1, 1, 2, 1, 0, 0, 1, 1, 1, 0, 0, 1, 0, 1, 0],
}


@pytest.mark.parametrize(("sequence", "k"), GOLDEN)
def test_golden_counts(spark, sequence, k):
    by = Kmers(k)
    df = spark.createDataFrame([(1, sequence)], "id long, s string")
    assert kmercount.counted(df, "s", by).first().counts == GOLDEN[sequence, k]
    found = {r.kmer: r.n for r in kmercount.histogram(df, "id", "s", by).collect()}
    assert [found.get(w, 0) for w in by.all()] == GOLDEN[sequence, k]


def test_both_forms_agree_and_batches_keep_sequences_apart(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGTacgtN") for _ in range(rng.randint(3, 40)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s string").coalesce(2)
    by = Kmers(3)
    dense = {r.id: r.counts for r in kmercount.counted(df, "s", by).collect()}
    for r in kmercount.histogram(df, "id", "s", by).collect():
        assert dense[r.id][by.all().index(r.kmer)] == r.n
    for i, s in rows:
        assert sum(dense[i]) == sum(set(s[j : j + 3].upper()) <= set("ACGT") for j in range(len(s) - 2))


def test_short_null_and_unknown_sequences(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "NNNN"), (4, ""), (5, "ACG")], "id long, s string")
    with pytest.raises(PySparkException, match="fewer than 2 letters"):
        kmercount.counted(df, "s", Kmers(2)).collect()
    got = {r.id: r.spectrum for r in kmercount.spectra(df, "s", Kmers(2), strict=False).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and got[4] is None
    assert sum(got[5]) == 1.0


def test_reversal_classes(spark):
    assert [Kmers(k).unique for k in (2, 3, 4)] == [10, 40, 136]
    by = Kmers(2)
    df = kmercount.counted(spark.createDataFrame([(1, FIRST)], "id long, s string"), "s", by).withColumn("u", kmercount.folded_counts("counts", by))
    row = df.first()
    assert len(row.u) == 10 and sum(row.u) == sum(row.counts)
    words = kmercount.without_reversed(kmercount.all_kmers(spark, by))
    assert words.count() == 10
    folded = {r.kmer: r.n for r in kmercount.folded_histogram(spark.createDataFrame([(1, FIRST)], "id long, s string"), "id", "s", by).collect()}
    assert sum(folded.values()) == sum(row.u) and all(k <= k[::-1] for k in folded)


def test_ranks(spark):
    by = Kmers(3)
    rows = kmercount.all_kmers(spark, by).withColumn("again", kmer_rank(F.col("kmer"), by)).collect()
    assert all(r["rank"] == r.again for r in rows) and [r.kmer for r in sorted(rows, key=lambda r: r["rank"])] == by.all()
    df = spark.createDataFrame([("GTG", [2, 3, 2]), ("tga", [3, 2, 0])], "w string, v array<int>")
    assert [(r.a, r.b) for r in df.select(kmer_rank(F.col("w"), by).alias("a"), vector_rank(F.col("v"), by).alias("b")).collect()] == [(46, 46), (56, 56)]
    assert spark.createDataFrame([("ANA",)], "w string").select(kmer_rank(F.col("w"), by)).first()[0] == -1
    with pytest.raises(PySparkException, match="doesn't have 3 letters"):
        spark.createDataFrame([("AA",)], "w string").select(kmer_rank(F.col("w"), by)).collect()


def test_gc_counts_upper_case_only(spark):
    df = spark.createDataFrame([("GGCA",), ("ggca",), ("",)], "s string")
    assert [r[0] for r in df.select(gc_fraction(F.col("s"))).collect()] == [0.75, 0.0, None]


def test_distances_and_codecs(spark):
    df = spark.createDataFrame([([0.5, 0.25, 0.25], [0.25, 0.25, 0.5])], "a array<double>, b array<double>")
    row = df.select(arrays.l1(F.col("a"), F.col("b")), arrays.l2(F.col("a"), F.col("b")), arrays.euclidean(F.col("a"), F.col("b")), arrays.l1(F.col("a"), F.col("a")), arrays.argmax(F.col("b")), arrays.decode_spectrum(arrays.encode_spectrum(F.col("a")))).first()
    assert row[0] == 0.5 and row[1] == 0.125 and abs(row[2] - 0.125**0.5) < 1e-15 and row[3] == 0 and row[4] == 2 and row[5] == [0.5, 0.25, 0.25]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_joined_spectra_are_those_of_the_joined_texts(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice("ab"), i, "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 2, 3, 5, 40])))) for i in range(120)]
    df = spark.createDataFrame([*rows, ("a", 500, None), ("c", 1, "AC"), ("c", 2, ""), ("c", 3, "G"), ("c", 4, "T")], "g string, i long, s string")
    by = Kmers(k)
    want = {r.g: r.spectrum for r in kmercount.spectra(kmercount.concatenated(df, "g", "i", "s"), "s", by).collect()}
    got = {r.g: r.spectrum for r in kmercount.joined_spectra(df.repartition(5), "g", "i", "s", by).collect()}
    assert got == want and set(got) == set("abc")


def test_joined_spectra_of_short_texts_raise(spark):
    df = spark.createDataFrame([("a", 1, "AC"), ("b", 1, "ACGT")], "g string, i long, s string")
    with pytest.raises(PySparkException, match="fewer than 4 letters"):
        kmercount.joined_spectra(df, "g", "i", "s", Kmers(4)).collect()
    assert kmercount.joined_spectra(df.limit(0), "g", "i", "s", Kmers(4)).count() == 0


def test_alphabets_are_checked():
    for k, alphabet in ((2, "AC?"), (2, "AaC"), (0, "AC"), (2, ""), (2, "A]C"), (2, "Aé")):
        with pytest.raises(ValueError, match="alphabet"):
            Kmers(k, alphabet)


def test_counts_of_long_texts_hold_few_letters_at_once(monkeypatch):
    """Pieces of a batch give the counts of the whole, and its memory doesn't grow with the letters."""
    import tracemalloc

    import numpy as np

    from binloom.functions.sequences import Kmers
    from binloom.operators import kmercount

    rng = np.random.default_rng(4)
    data = np.frombuffer(b"ACGTNacgt", dtype=np.uint8)[rng.integers(0, 9, 3000)]
    offsets = np.r_[0, 0, np.sort(rng.integers(0, 3000, 40)), 3000, 3000]
    for k in (1, 2, 5):
        for letters in (1, 7, 100, 10_000):
            monkeypatch.setattr(kmercount, "LETTERS", letters)
            assert (kmercount._letters_at_once(data, offsets, Kmers(k)) == kmercount._count_batch(data, offsets, Kmers(k))).all()
    monkeypatch.setattr(kmercount, "LETTERS", 1 << 18)
    large = np.resize(data, 1 << 23)
    tracemalloc.start()
    kmercount._letters_at_once(large, np.array([0, len(large)]), Kmers(2))
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_empty_tables_need_no_python(spark, tmp_path):
    from binloom.operators.catalog import Database

    db = Database(spark, tmp_path.as_uri())
    db.create("t", ["a", "b"], ["int", "str"])
    assert [(c, t) for c, t in db.types("t").items()][0][0] == "a" and db.count("t") == 0
    from binloom import schema
    from pyspark.sql import types as T

    plan = db._empty(T.StructType([T.StructField("a", schema.SCALARS["int"])]))._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan
