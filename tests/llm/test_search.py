"""Hard negatives and language identification: brute force, all segmentations, held-out rows, odd rows."""

import math
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from binloom.llm import hardneg, langid, queries
from binloom.session import table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def mined(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """By hand; rows are (id, label, components)."""
    good = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    out = []
    for i, g, v in dict.fromkeys((i, g, tuple(v)) for i, g, v in good if is_anchor(i)):
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, h) for j, h, w in good if len(w) == len(v)]
        for p, j, _ in sorted((s for s in scored if s[2] == g and s[1] != i), key=lambda s: (-s[0], s[1]))[:positives]:
            fits = sorted((s for s in scored if s[2] != g and low * p <= 100 * s[0] <= high * p), key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, j, r, n[1], p, n[0]) for r, n in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "chunk"), [(4096, 16384), (7, 50)])
def test_hard_negatives(spark, monkeypatch, anchors, chunk):
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    monkeypatch.setattr(hardneg, "CHUNK", chunk)
    rng = random.Random(4)
    near = [[rng.gauss(0, 1) for _ in range(70)] for _ in range(3)]
    rows = [(i, rng.randrange(3), [x + rng.gauss(0, 0.7) for x in near[rng.randrange(3)]]) for i in range(160)]
    rows += [(i, 1, rows[i - 200][2]) for i in range(200, 240)]  # ties
    rows += [(300 + i, rng.choice([1, 2]), [float(rng.randrange(-3, 9)) for _ in range(3)]) for i in range(30)]  # other lengths
    rows += [rows[5], rows[5], rows[10], rows[10], (10, 2, rows[3][2]), (10, 1, [1.0, 2.0, 3.0])]  # repeated rows, versions of an id
    rows += [(400, 1, [0.0] * 70), (410, None, rows[1][2]), (420, 1, None), (430, 1, []), (440, 1, [None, *rows[1][2][1:]]), (450, 1, [math.nan] * 70), (460, 1, [math.inf] * 70), (None, 1, rows[1][2])]
    rows += [(500, 1, [2.0**22, 1.0, 0.5, 3.0]), (510, 1, [2.0**21, 7.0, 0.5, -3.0]), (520, 2, [2.0**20, -1.0, 0.25, 3.0])]  # beyond floating point
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, key int").repartition(5)
    got = sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == mined(rows, lambda i: i % 10 == 0) and any(r[0] == 500 for r in got)
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_and_drop():
    """Pairs outside the bounds are dropped, whatever the planes; all others are kept."""
    rng = np.random.default_rng(5)
    a, c = rng.integers(-300, 200, size=(9, 65)), rng.integers(-140, 150, size=(400, 65))
    want = a @ c.T
    for least, most in ((-(1 << 40), 1 << 40), (60_000, 90_000), (0, 0), (10**9, 10**9)):
        i, j, s = hardneg.qualified(a, hardneg.sliced(a), hardneg.sliced(c), np.ones(want.shape, dtype=bool), np.full(9, least), np.full(9, most))
        assert sorted(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == sorted((x, y, int(want[x, y])) for x, y in zip(*np.nonzero((want >= least) & (want <= most)), strict=True))
    planes = hardneg.sliced(c)
    weight = np.array([-(1 << k) if k == len(planes) - 1 else 1 << k for k in range(len(planes))])
    assert (sum(w * hardneg.unpacked(p, 65, np.int64) for w, p in zip(weight, planes, strict=True)) == c).all()


def test_hard_negatives_of_the_tables(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{FOLDER}/embeddings.parquet')")
    got = queries.op11_hard_negatives(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(hardneg.ORACLE).select(*got.columns).fetchall())


def cuts(word, pieces):
    """All ways to cut a word into pieces."""
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ((word[:k], *rest) for rest in cuts(word[k:], pieces))


def lattice_of(pieces, some):
    data = np.frombuffer(b"".join(some), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in some])
    return list(langid.lattices(pieces, data, ends - [len(w) for w in some], ends, np.zeros(len(some), dtype=np.int64), 2))


def test_forward_and_backward_against_all_cuts():
    pieces = langid.Pieces([b"ab", b"abc", b"bc", b" a", b" ab", b"ca", b"bab", b"AB", b"a1"])
    assert b"AB" not in pieces.all and b"a1" not in pieces.all and b"\xff" in pieces.all
    rng = random.Random(6)
    weight = np.array([rng.random() for _ in pieces.all])
    some = [b" abc", b"ab", b" ", b"abcabcabab", b" " + b"abc" * 3, b" bca\xc3\xa9b", *(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(60))]
    number = {p: i for i, p in enumerate(pieces.all)}
    seen = 0
    for lattice in lattice_of(pieces, some):
        by = [weight[p] for _, _, p in lattice.edges]
        before, after = lattice.forward(by), lattice.backward(by)
        for k, row in enumerate(lattice.rows):
            ways = {c: math.prod(weight[number[p]] for p in c) for c in cuts(some[row], number)}
            assert math.isclose(before[lattice.length[k], k], sum(ways.values()), rel_tol=1e-9) and math.isclose(after[0, k], sum(ways.values()), rel_tol=1e-9)
            seen += 1
    assert seen == len(some)


def test_expected_counts_against_all_cuts(spark):
    pieces = langid.Pieces([b"ab", b"abc", b"bc", b" a"])
    rng = np.random.default_rng(7)
    weights = rng.random((len(pieces.all), 2))
    rows = [("x", b" abc", 3), ("y", b" abcab", 1), ("x", b"bcbc", 1 << 33)]
    got = langid.expected(spark.createDataFrame(rows, "lang string, word binary, n long"), pieces, ["x", "y"], weights)
    number, want = {p: i for i, p in enumerate(pieces.all)}, np.zeros(weights.shape)
    for lang, word, n in rows:
        k = "xy".index(lang)
        ways = {c: math.prod(weights[number[p], k] for p in c) for c in cuts(word, number)}
        for c, w in ways.items():
            for p in c:
                want[number[p], k] += n * w / sum(ways.values())
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_words_of_texts():
    texts = ["Ab c1d É-x", "", "12", "q" * 100]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    s, e, doc, h, opens = langid.words(np.frombuffer(data, dtype=np.uint8), offsets)
    assert [(data[a:b].decode(), int(d), int(o)) for a, b, d, o in zip(s, e, doc, opens, strict=True)] == [("Ab", 0, 1), ("c", 0, 1), ("d", 0, 1), ("É", 0, 1), ("x", 0, 1), ("q" * 47, 3, 1), ("q" * 47, 3, 0), ("q" * 6, 3, 0)]
    assert len(set(h.tolist())) == 8


def test_languages_of_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang").toPandas()
    got = queries.op12_language(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    both = got.merge(docs, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.98
    again = queries.op12_language(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_languages_of_odd_rows(spark):
    path = public_tokenizers.path(queries.TOKENIZER)
    rows = [(1, None, "en"), (2, "", "en"), (3, "the house of the man and the hand", "en"), (4, "das haus und der mann und die hand", "de"), (4, "das haus und der mann und die hand", "de"), (None, "der hund", None), (5, "123 -- ¡¿", "de"), (6, "the " * 40_000, None), (7, "x" * 300_000, None), (8, "日本語 中文", None)]
    df = spark.createDataFrame([(*r, "a", 2.0, "b") for r in rows], "doc_id long, text string, lang string, Score string, t double, c0 string")
    model = langid.fit(df, path)
    assert model.langs == ["de", "en"]
    out = langid.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "t", "c0", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert {i: p for i, p, _ in found if i in (1, 2, 3, 4, 5, 6)} == {1: "und", 2: "und", 3: "en", 4: "de", 5: "und", 6: "en"}
    assert all(0 <= s <= 1 for _, _, s in found) and [s for _, p, s in found if p == "und"] == [0, 0, 0] and len({x for x in found if x[0] == 4}) == 1
    assert langid.predict(df.limit(0), model).count() == 0
    untaught = langid.predict(df, langid.fit(df.limit(0), path)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)} and len(untaught) == len(rows)
