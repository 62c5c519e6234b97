"""Sparse spectra against dense ones."""

import random

import pytest

from binloom.functions.arrays import l1
from binloom.functions.sequences import Kmers
from binloom.operators import compare, kmercount, sparse


def test_sparse_distances_are_the_dense_ones(spark):
    rng = random.Random(12)
    said = lambda n: "".join(rng.choice("ACGTacgtN ") for _ in range(n))
    by = Kmers(3)
    queries = spark.createDataFrame([(i, said(rng.randint(3, 200))) for i in range(30)] + [(40, None), (41, ""), (42, "AC"), (43, "NNNN"), (44, "ACGT" * 20_000)], "q long, s string")
    references = spark.createDataFrame([(f"g{i}", said(150)) for i in range(6)] + [("same", "ACGT" * 50)], "g string, s string")
    a, b = sparse.spectra(queries, "q", "s", by), sparse.spectra(references, "g", "s", by)
    got = {(r.q, r.g): r.distance for r in sparse.distances(a, b, "q", "g").collect()}
    dense = compare.distances(kmercount.spectra(queries, "s", by, strict=False), kmercount.spectra(references, "s", by), "q", "spectrum", "g", measure=l1)
    want = {(r.q, r.g): r.distance for r in dense.collect() if r.distance is not None}
    assert {k: v for k, v in want.items() if v < 2 - 1e-9} == pytest.approx(got, abs=1e-8)
    first = {r.q: (r.g, r.distance, r.second) for r in sparse.nearest(a, b, "q", "g").collect()}
    for q, (g, d, second) in first.items():
        far = sorted((round(v, 9), n) for (x, n), v in want.items() if x == q)
        assert (d, g) == far[0] and (second is None or abs(second - far[1][0]) < 1e-8)
    assert set(first) == {q for (q, _), v in want.items() if v < 2 - 1e-9} and 44 in first and first[44][0] == "same"
    assert sparse.spectra(queries.limit(0), "q", "s", by).count() == 0


def test_long_kmers(spark):
    df = spark.createDataFrame([(1, "ABCDEFGHIJKLAB xyzxyzxyzxyz")], "id long, s string")
    got = {(r.kmer, r.n) for r in sparse.spectra(df, "id", "s", Kmers(10, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).collect()}
    text = ["ABCDEFGHIJKLAB", "XYZXYZXYZXYZ"]
    assert got == {(t[i : i + 10], 1) for t in text for i in range(len(t) - 9)}
