"""Assignment, comparison, matrices, clustering and label spreading."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from binloom.functions.sequences import Kmers
from binloom.operators import assign, cluster, compare, external, labelspread, matrix, neighbours, relational, report
from binloom.operators.catalog import Database
from binloom.plans import binning
from binloom.streaming import perrow


def test_assignment_counts_before_scores(spark):
    hits = spark.createDataFrame([("s1", "a", 40.0), ("s1", "b", 30.0), ("s1", "b", 20.0), ("s2", "b", 10.0), ("s3", "c", 99.0), ("s4", "d", 50.0), ("s4", "c", 50.0)], "scaffold string, genus string, bits double")
    best = {r.scaffold: (r.genus, r.bits) for r in assign.best_group(assign.score_sums(hits)).collect()}
    assert best == {"s1": ("b", 50.0), "s2": ("b", 10.0), "s3": ("c", 99.0), "s4": ("c", 50.0)}
    assert {r.scaffold for r in assign.assign_genus(hits, 30, 2).collect()} == {"s1", "s3", "s4"}
    assert {r.scaffold for r in assign.assign_genus(hits, 50, 2).collect()} == {"s3"}


def test_gene_hits(spark):
    genes = spark.createDataFrame([("g1", "COG1", "s1"), ("g2", "COG2", "s1")], "gene_id string, cog_id string, scaffold string")
    results = spark.createDataFrame([("g1", [("x [Thermus aquaticus]", 0.0, 1.0, 90.0)]), ("g2", [("y [B c]", 0.0, 1.0, 10.0)])], "gene_id string, hits array<struct<title:string,evalue:double,score:double,bits:double>>")
    got = assign.gene_hits(genes, results, spark.createDataFrame([("COG1",), ("COG1",)], "cog_id string"))
    assert [tuple(r) for r in got.collect()] == [("s1", "thermus", 90.0)]


def test_votes_and_relabelling(spark):
    members = spark.createDataFrame([("s1", 1), ("s2", 1), ("s3", 2)], "scaffold string, cluster long")
    hits = spark.createDataFrame([("s1", "a", 5.0), ("s2", "b", 3.0), ("s2", "b", 3.0)], "scaffold string, genus string, bits double")
    assert {r.scaffold: r.genus for r in assign.cluster_votes(members, hits).collect()} == {"s1": "b", "s2": "b", "s3": "not assigned"}
    rows = spark.createDataFrame([("x", 0.5), ("y", 0.6), ("z", float("nan")), ("w", None)], "scaffold string, probability double").withColumn("label", assign.F.col("scaffold"))
    assert {r.scaffold: r.label for r in report.confident(rows, "label", 0.5).collect()} == {"x": "not assigned", "y": "y", "z": "not assigned", "w": "not assigned"}
    assert report.chosen_source(dpgmm=0.0, ext=True) == "dpgmm" and report.chosen_source(kmeans=False) is None


def test_selection_rules(spark):
    rows = [("a", "g", 0.1, 0.2), ("b", "g", 0.19, 0.2), ("c", "g", 5.0, 9.0), ("d", "g", 0.0, 0.0), ("e", "g", float("nan"), 1.0), ("f", "g", None, None)]
    got = compare.selected(spark.createDataFrame(rows, "q string, genus string, distance double, second double"), "genus", 3.0, 0.8)
    assert {r.q: (r.genus, r.distance) for r in got.collect()} == {"a": ("g", 0.1), "b": ("not assigned", -1.0), "c": ("not assigned", -1.0), "d": ("g", 0.0), "e": ("not assigned", -1.0), "f": ("not assigned", -1.0)}
    assert abs(compare.absolute_threshold(Kmers(4), 0.003) - 3.072) < 1e-12


def test_comparison_reuses_what_it_assigned(spark):
    scaffolds = spark.createDataFrame([("a", "AAAAAAAAAC"), ("b", "GGGGGGGGGT"), ("c", "AAAAAAAACC"), ("d", "NNNN")], "scaffold string, sequence string")
    assigned = spark.createDataFrame([("a", "x"), ("b", "y")], "scaffold string, genus string")
    got = {r.scaffold: (r.genus, r.distance) for r in compare.compare_all(assigned, scaffolds, Kmers(2), largest=1.0).collect()}
    assert got["a"] == ("x", 0.0) and got["c"][0] == "x" and "d" not in got
    once = {r.scaffold: r.genus for r in compare.compare_all(assigned, scaffolds, Kmers(2), mode="compat").collect()}
    assert once["d"] == "not assigned"
    with pytest.raises(ValueError, match="two references"):
        compare.compare_once(assigned.limit(1), scaffolds, Kmers(2))


def test_rounds_equal_full_recounts(spark, caplog):
    """Counts and seams kept from round to round give what counting everything again gives, and fewer rows are left each time."""
    caplog.set_level("INFO")
    rng = np.random.default_rng(11)

    def said(n, bias):
        return "".join(rng.choice(list("ACGTN"), p=bias, size=n))

    biases = [[0.6, 0.2, 0.1, 0.09, 0.01], [0.1, 0.1, 0.6, 0.19, 0.01], [0.2, 0.3, 0.1, 0.39, 0.01]]
    mixed = [[a * (1 - t) + b * t for a, b in zip(biases[0], biases[1], strict=True)] for t in (0.1, 0.2, 0.3, 0.4, 0.5)]
    rows = [(i, said(int(rng.integers(1, 90)), [*biases, *mixed][i % 8])) for i in range(60)] + [(70, None), (71, ""), (72, "A")]
    scaffolds = spark.createDataFrame(rows, "scaffold long, sequence string")
    assigned = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z"), (8, "x"), (59, "not assigned"), (99, "x")], "scaffold long, genus string")
    got = {tuple(r) for r in compare.compare_all(assigned, scaffolds, Kmers(2), largest=0.6, ratio=0.9).collect()}
    table = assigned.withColumn("distance", F.lit(0.0))
    while new := compare.compare_once(table, scaffolds, Kmers(2), largest=0.6, ratio=0.9).filter("genus <> 'not assigned'").collect():
        table = spark.createDataFrame([tuple(r) for r in table.collect()] + [tuple(r) for r in new], "scaffold long, genus string, distance double")
    rounded = lambda rows: {(s, g, round(d, 9)) for s, g, d in rows}
    assert rounded(got) == rounded({tuple(r) for r in table.collect()}) and len(got) > len(assigned.collect())
    left = [r.args[1] for r in caplog.records if r.name == "binloom.operators.compare"]
    assert len(left) > 1 and left == sorted(left, reverse=True)


def test_rounds_write_no_sequences(spark, monkeypatch):
    """Sequences are read once for their counts and ends; what rounds write and shuffle doesn't grow with their lengths."""
    made, whole = [], compare.written
    monkeypatch.setattr(compare, "written", lambda df, *owner: made.append(df.columns) or whole(df, *owner))
    scaffolds = spark.createDataFrame([("a", "AAAAAAAAAC"), ("b", "GGGGGGGGGT"), ("c", "AAAAAAAACC"), ("d", "NNNN"), ("e", None), ("f", "")], "scaffold string, sequence string")
    assigned = spark.createDataFrame([("a", "x"), ("b", "y"), ("e", "x")], "scaffold string, genus string")
    got = {r.scaffold: r.genus for r in compare.compare_all(assigned, scaffolds, Kmers(2), largest=1.0).collect()}
    assert got == {"a": "x", "b": "y", "c": "x", "e": "x"}
    assert made and not any("sequence" in columns for columns in made)


def test_references_in_blocks_give_the_same(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(40)], "id long, v array<double>")
    refs = spark.createDataFrame([(f"r{i}", [float(i), 0.0]) for i in range(9)], "name string, v array<double>")
    a = {tuple(r) for r in compare.distances(vectors, refs, "id", "v", "name").collect()}
    near = {tuple(r) for r in compare.nearest(vectors, refs, "id", "v", "name").collect()}
    assert near == {tuple(r) for r in compare.nearest_two(compare.distances(vectors, refs, "id", "v", "name"), "id", "name").collect()}
    monkeypatch.setattr(compare, "SENT_BYTES", 1)
    monkeypatch.setattr(compare, "BLOCK_ROWS", 4)
    assert {tuple(r) for r in compare.distances(vectors, refs, "id", "v", "name").collect()} == a and len(a) == 360
    assert {tuple(r) for r in compare.nearest(vectors, refs, "id", "v", "name").collect()} == near


def test_scaling(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [2.0, 5.0]), ("c", [4.0, 5.0])], "scaffold string, features array<double>")
    got = np.array([r.features for r in matrix.scaled(df, "scaffold", "features").orderBy("scaffold").collect()])
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(got[:, 0], (x - x.mean()) / x.std()) and (got[:, 1] == 0).all()


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {}
    for r in neighbours.nearest(df, "id", "v", 7, block=40).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    assert all([got[i][k] for k in range(1, 8)] == np.argsort(d[i], kind="stable")[:7].tolist() for i in range(150))


def test_neighbours_of_equal_rows(spark):
    """Copies, ties, strings as keys, few rows, none."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 2)) * 10)  # whole numbers, so that ties are exact
    x[30:70] = x[3]
    names = [f"k{i:02d}" for i in rng.permutation(90)]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)] + [("none", None)], "id string, v array<double>")
    for itself in (True, False):
        got = {}
        for r in neighbours.nearest(df, "id", "v", 5, itself=itself, block=8).collect():
            got.setdefault(r.src, {})[r["rank"]] = (r.dst, round(r.distance, 9))
        for i, n in enumerate(names):
            far = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 9), names[j]) for j in range(90) if itself or j != i)[:5]
            assert [got[n][k] for k in range(1, 6)] == [(m, d) for d, m in far]
        assert set(got) == set(names)
    few = df.filter("id = 'none' or id < 'k03'")
    assert neighbours.nearest(few, "id", "v", 7).count() == 9 and neighbours.nearest(df.limit(0), "id", "v", 7).count() == 0


def test_neighbours_visit_few_rings(spark):
    """Of rows that lie in clumps each visits a few rings, whatever their number."""
    rng = np.random.default_rng(4)
    share = []
    for clumps in (8, 32):
        centers = rng.normal(size=(clumps, 6)) * 50
        x = centers[np.arange(clumps * 64) % clumps] + rng.normal(size=(clumps * 64, 6))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>")
        located, pivots, rings = neighbours.rings_of(df, 16)
        going = neighbours.visits(located.withColumn("bound", F.lit(3.0)), pivots, rings)
        share.append((going.select(F.avg(F.size("entries"))).first()[0], len(rings["cell"])))
    assert share[1][1] > 3 * share[0][1] and share[1][0] < 2 * share[0][0] and share[1][0] < 0.25 * share[1][1]


def test_kmeans_against_many_fits(spark):
    """The cost is that of the best of ten fits of Spark's own, to a ten-thousandth at worst, and reruns agree however rows are dealt."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 5))[rng.integers(0, 12, 600)] * 4 + rng.normal(size=(600, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None)], "scaffold long, features array<double>")

    def cost(rows):
        label = np.array([r.cluster for r in sorted(rows, key=lambda r: r.scaffold)])
        return sum(((x[label == k] - x[label == k].mean(axis=0)) ** 2).sum() for k in np.unique(label))

    got = cluster.kmeans(df, 12).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in cluster.kmeans(df.repartition(7), 12).collect()} and len(got) == 600
    vectors = df.filter("features is not null").select(array_to_vector("features").alias("v")).cache()
    assert cost(got) <= min(KMeans(k=12, featuresCol="v", seed=s).fit(vectors).summary.trainingCost for s in range(10)) * (1 + 1e-4)
    few = df.filter("scaffold < 2")
    assert cluster.kmeans(few, 4).count() == 2 and cluster.kmeans(df.limit(0), 4).count() == 0


def test_complete_linkage(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    for cut in (0.5, 1.5, 3.0):
        c = cluster.linkage_clusters(x, cut)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        own = [np.flatnonzero(c == k) for k in np.unique(c)]
        assert all(d[np.ix_(o, o)].max() <= cut for o in own)
        # no two clusters could have been merged below the cut
        assert all(d[np.ix_(a, b)].max() > cut for a, b in itertools.combinations(own, 2))
        assert c.min() == 1 and c.max() == len(own) and c[0] == 1
    df = spark.createDataFrame([("a", [0.0]), ("b", [0.1]), ("c", [9.0])], "scaffold string, features array<double>")
    assert {r.scaffold: r.cluster for r in cluster.complete_linkage(df, 1.0).collect()} == {"a": 1, "b": 1, "c": 2}
    with pytest.raises(PySparkException, match="over the limit"):
        cluster.complete_linkage(df, 1.0, limit=2).collect()


def test_complete_linkage_of_large_groups(spark, monkeypatch):
    # one group of more rows than complete linkage takes at once
    n = cluster.LINKED + 808
    pairs = spark.range(n).select(F.col("id").alias("scaffold"), F.array(F.floor(F.col("id") / 2) * 10.0 + F.col("id") % 2 * 0.5).alias("features"))
    assert {(r.scaffold, r.cluster) for r in cluster.complete_linkage(pairs, 1.0).collect()} == {(i, i // 2 + 1) for i in range(n)}
    # by components as by whole groups, the group without a label and equal rows included
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(f"s{i:03}", rng.integers(0, 2, size=2).tolist() if i % 9 == 0 else rng.normal(scale=5, size=2).tolist(), [1, 2, None][i % 5 % 3]) for i in range(300)]
    df = spark.createDataFrame([(k, [float(v) for v in x], g) for k, x, g in rows], "scaffold string, features array<double>, label long")
    for group in (None, "label"):
        whole, parts = (Counter(tuple(r) for r in cluster.complete_linkage(df, 0.4, group=group, linked=k).collect()) for k in (8192, 80))
        assert whole == parts and len({r[-1] for r in whole}) > 20
    with pytest.raises(PySparkException, match="over the limit"):
        cluster.complete_linkage(df, 0.4, linked=2).collect()


def blobs(spark, n=30, apart=10.0):
    rng = np.random.default_rng(1)
    rows = [(f"s{i:03}", (rng.normal(size=2) + apart * (i % 3)).tolist(), i % 3) for i in range(3 * n)]
    return spark.createDataFrame(rows, "scaffold string, features array<double>, truth long")


@pytest.mark.parametrize("how", ["kmeans", "gaussian", "dirichlet"])
def test_mixtures_find_blobs(spark, how):
    df = blobs(spark)
    found = {"kmeans": lambda: cluster.kmeans(df, 3, starts=3), "gaussian": lambda: cluster.gaussian_mixture(df, 3), "dirichlet": lambda: cluster.dirichlet_mixture(df, 8)}[how]()
    pairs = {(r.truth, r.cluster) for r in df.join(found, "scaffold").collect()}
    by_cluster = {}
    for t, c in pairs:
        by_cluster.setdefault(c, set()).add(t)
    assert all(len(t) == 1 for t in by_cluster.values())


def test_label_spreading(spark):
    df = blobs(spark)
    seeds = df.filter("scaffold in ('s000', 's001', 's002')").selectExpr("scaffold", "truth as label")
    got = labelspread.propagate(df, seeds, alpha=0.9)
    assert all(r.truth == r.label and 0 < r.probability <= 1 for r in df.join(got, "scaffold").collect())
    alone = labelspread.propagate(df, seeds.filter("label = 0"), alpha=0.9)
    assert {r.label for r in df.join(alone, "scaffold").filter("truth = 2").collect()} == {-1}
    weights = labelspread.spread(labelspread.graph(neighbours.nearest(df, "scaffold", "features")), labelspread.seeds(seeds, "scaffold", "label"), 0.9)
    assert all(abs(r[1] - 1) < 1e-9 for r in weights.groupBy("node").sum("weight").collect())


def test_binning_splits_bins(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:03}", np.abs(rng.normal(size=3) * 0.02 + (i % 2)).tolist(), 20.0 + i % 2, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "scaffold string, spectrum array<double>, coverage double, truth long")
    got = binning.run_binning(df, df.filter("scaffold < 's010'"), binning.Binning(threshold=3.0, probability=0.3, alpha=0.9))
    pairs = {(r.truth, r.label) for r in df.join(got, "scaffold").collect()}
    assert len({c for _, c in pairs}) == len(pairs) >= 2
    one = got.withColumn("label", relational.F.lit(1).cast("long")).withColumn("probability", relational.F.lit(1.0))
    labels, split = binning.split_bins(df, one, binning.Binning(threshold=3.0), last_label=7)
    assert split and {r.label for r in labels.collect()} == {8, 9}


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), overwrite=True)
    db.create("t", ["a", "b", "c"], ["int", "float", "str"])
    db.store("t", spark.createDataFrame([("1", "2.5", "x"), ("2", "3", "y")], "a string, b string, c string"))
    db.store("t", spark.createDataFrame([], "a long, b double, c string"))
    assert db.count("t") == 2 and db.types("t") == {"a": "bigint", "b": "double", "c": "string"}
    with pytest.raises(PySparkException):
        db.store("t", spark.createDataFrame([("one", "1", "z")], "a string, b string, c string"))
    db.add_columns("t", {"d": "float", "a": "int"})
    db.update("t", {"c": "new"}, {"a": 2, "c": "y"})
    assert [(r.a, r.c, r.d) for r in db.table("t", order_by="a").collect()] == [(1, "x", None), (2, "new", None)]
    db.drop_columns("t", ["d"])
    db.create_view("v", "t", {"a": 1})
    db.create_top_view("w", "t", "b", 1)
    assert db.table("v").count() == 1 and db.table("w").first().a == 1 and db.exists("v") and db.sql("select sum(a) from t").first()[0] == 3
    db.drop_view("v")
    with pytest.raises(ValueError, match="no view"):
        db.drop_view("v")
    other = Database(spark, str(tmp_path / "other"))
    other.replace("t", db.table("t").select("c", "b", "a"))
    db.merge([db, other], "t")
    assert db.count("t") == 4
    with pytest.raises(ValueError, match="no table"):
        db.exists("missing", raise_error=True)
    db.create_known("KmeansResults")
    assert db.columns("KmeansResults") == ["scaffold", "cluster"]


def test_whole_engine(spark, tmp_path):
    rng = np.random.default_rng(4)
    draw = lambda p: "".join(rng.choice(list("ACGT"), p=p, size=300))
    kinds = {"x": [0.4, 0.1, 0.1, 0.4], "y": [0.1, 0.4, 0.4, 0.1]}
    names = [f"{g}{i}" for g in kinds for i in range(12)]
    (tmp_path / "s.fna").write_text("".join(f">{i} sg4i_{n} asm : {n}\n{draw(kinds[n[0]])}\n" for i, n in enumerate(names)))
    (tmp_path / "c.csv").write_text("id,cov\n" + "".join(f"{n},{10 + (n[0] == 'y')}\n" for n in names))
    db = Database(spark, str(tmp_path / "db"))
    binning.create_database(db, scaffolds=str(tmp_path / "s.fna"), coverage=str(tmp_path / "c.csv"))
    binning.add_spectra(db, 2)
    db.replace("ScaffoldsAssignments", spark.createDataFrame([(f"sg4i_{g}{i}", g, 60.0) for g in kinds for i in range(3)], "scaffold string, genus string, bits double"))
    binning.nearest_genera(db, Kmers(2))
    assert all(r.genus == r.scaffold[5] for r in db.table("ScaffoldKmerComparison").collect())
    binning.label_propagation(db)
    binning.kmeans(db, 2)
    binning.kmeans_label_propagation(db, 2)
    binning.mixture(db, 4)
    assert all(r.genus == r.scaffold[5] for r in db.table("LabelPropagationResults").collect())
    assert db.count("KmeansResults") == db.count("KmeansLPResults") == db.count("DPGMMResults") == 24
    assert binning.design(db, "genus").count() == binning.design(db, "log").count() == 24
    points = report.plot_points(db.table("Scaffolds"), db.table("ScaffoldsAssignments").withColumnRenamed("genus", "label"))
    assert {(r.label, r.color) for r in points.collect()} == {("x", "blue"), ("y", "green")}


def test_failures_are_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id long, v string")
    got = external.parallel(df, "id", "v", lambda v: v.upper() if v else 1 / 0)
    assert [(r.id, r.ok, r.value) for r in got.orderBy("id").collect()] == [(1, True, "A"), (2, False, None), (3, False, None)]
    assert "ZeroDivisionError" in external.failed(got).first().error
    lost = external.blast(spark.createDataFrame([("g", "MK")], "gene_id string, sequence string"), "nr", program="no-such-program").first()
    assert not lost.ok and "no-such-program" in lost.error


def test_spectra_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "ACGT"), (2, "A")], "id long, s string").write.parquet(str(tmp_path / "in"))
    rows = perrow.spectrum_stream(perrow.read_tables(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "s", Kmers(2))
    perrow.append_to(rows, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r.id: r.spectrum for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2] is None and abs(sum(got[1]) - 1) < 1e-12


def test_complete_linkage_of_one_large_component(spark, monkeypatch):
    """A component of more rows than are taken at once, by rounds over all tasks: the clusters of taking it whole."""
    monkeypatch.setattr(cluster, "BLOCK", 32)
    x = np.random.default_rng(8).normal(size=(300, 3))
    df = spark.createDataFrame([(f"s{i:03}", v.tolist(), i % 2) for i, v in enumerate(x)] + [("t", [9.0] * 3, 1), ("u", [9.0] * 3, 1)], "scaffold string, features array<double>, label int").repartition(5)
    for group in (None, "label"):
        whole = sorted(tuple(r) for r in cluster.complete_linkage(df, 1.2, group=group).collect())
        assert sorted(tuple(r) for r in cluster.complete_linkage(df, 1.2, group=group, at_once=20).collect()) == whole and len(whole) == 302


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_nearest_of_bounded_and_unbounded_rows(shift):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(300, 16)) + shift, rng.normal(size=(3000, 16)) + shift
    y[9] = y[4]
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    for bound in (np.inf, 3.2):
        order = np.argsort(d, axis=1, kind="stable")[:, :7]
        want = [(i, j, d[i, j]) for i in range(300) for j in order[i].tolist() if d[i, j] <= bound]
        row, to, far = neighbours.nearest_of(x, y, np.full(300, bound), 7)
        assert list(zip(row.tolist(), to.tolist(), strict=True)) == [w[:2] for w in want] and np.allclose(far, [w[2] for w in want])


def test_weights_are_moved_along_edges(monkeypatch):
    """Hubs, nodes without edges, blocks of any width: the sums that a dense matrix gives."""
    rng = np.random.default_rng(5)
    for n, m, width, room, hub in ((50, 300, 3, 64, 20), (300, 5000, 7, 64, 20), (1000, 4000, 64, 1 << 14, 64), (10, 0, 4, 64, 64), (5, 200, 2, 8, 3)):
        monkeypatch.setattr(labelspread, "MOVED", room)
        monkeypatch.setattr(labelspread, "HUB", hub)
        src, dst, w = rng.integers(0, n, m), rng.integers(0, n, m) * rng.integers(0, 2, m), rng.random(m)
        dense = np.zeros((n, n))
        np.add.at(dense, (dst, src), w)
        graph, f = labelspread.Graph(src, dst, w, n, width), rng.random((n, width))
        for part in (f, np.ascontiguousarray(f[:, :2])):
            out = np.full_like(part, np.nan)
            graph.move(part[graph.order], out, 0.9)
            assert np.allclose(out[graph.place], 0.9 * dense @ part)


def test_shares_of_labels_have_a_partition_each(spark, monkeypatch):
    """The graph is sent to shares of many blocks of labels, not to each block, and no two shares wait for one task."""
    monkeypatch.setattr(labelspread, "WIDE", 1)
    monkeypatch.setattr(labelspread, "SHARES", 1)
    made, whole = [], labelspread.written
    monkeypatch.setattr(labelspread, "written", lambda df, *a: made.append(whole(df, *a)) or made[-1])
    df = blobs(spark, apart=3.0)
    labels = df.selectExpr("scaffold", "concat('g', cast(substr(scaffold, 2) as int) % 40) as label")
    found = labelspread.propagate(df, labels, alpha=0.5)
    assert found.count() == df.count()
    shares = spark.sparkContext.defaultParallelism
    rows = [t for t in made if "total" in t.columns][-1].filter("kind = 0")  # the last of two, if the first went on for too many rounds
    assert rows.count() <= shares * df.count()
    for n in (1, 7, shares, 24):
        keys = spark.createDataFrame([(k,) for k in labelspread.partition_keys(spark, n)], "k int")
        assert sorted(r.p for r in keys.repartition(n, "k").select(F.spark_partition_id().alias("p")).collect()) == list(range(n))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_small_groups_are_clustered_together(spark, monkeypatch, kind):
    """Many groups, null among them, are handed over by few calls and clustered each by itself."""
    monkeypatch.setattr(cluster, "BIN", 40)
    rng = np.random.default_rng(6)
    rows = [(f"s{i:04}", None if i % 61 == 0 else int(i % 50) + (1 << 60), rng.normal(size=2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "scaffold string, bin long, features array<double>").withColumn("bin", F.col("bin").cast(kind))
    found = cluster.complete_linkage(df, 1.0, group="bin")
    assert "_bin" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.scaffold: (r.bin, r.cluster) for r in found.collect()}
    for b in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == b]
        want = cluster.linkage_clusters(np.array([r[2] for r in own]), 1.0)
        assert {s: got[s] for s, _, _ in own} == {r[0]: (b if b is None or kind == "long" else str(b), int(c)) for r, c in zip(own, want, strict=True)}


@pytest.mark.parametrize("alpha", [1.0, 0.7, 0.05])
def test_spreading_by_blocks_of_labels(spark, monkeypatch, alpha):
    """Blocks of labels give what joins round by round give, wherever these stop."""
    monkeypatch.setattr(labelspread, "WIDE", 3)
    monkeypatch.setattr(labelspread, "MOVED", 64)
    df = blobs(spark, apart=3.0)
    labels = df.filter("cast(substr(scaffold, 2) as int) % 4 = 0").selectExpr("scaffold", "concat('g', cast(substr(scaffold, 2) as int) % 11) as label")
    edges, start = labelspread.graph(neighbours.nearest(df, "scaffold", "features")), labelspread.seeds(labels, "scaffold", "label")
    joined, dealt = (sorted(tuple(r) for r in labelspread.best_labels(edges, start, df, "scaffold", "none", alpha, sent=n).collect()) for n in (0, 10**6))
    assert [r[0] for r in joined] == [r[0] for r in dealt] and np.allclose([r[2] for r in joined], [r[2] for r in dealt])
    weights = {(r.node, r.label): r.weight for r in labelspread.spread(edges, start, alpha).collect()}
    for a, b in zip(joined, dealt, strict=True):  # with alpha 1 several labels come to the same weight
        assert a[1] == b[1] or abs(weights[a[0], a[1]] - weights[b[0], b[1]]) < 1e-9
    assert alpha == 1 or len({r[1] for r in dealt}) > 5
