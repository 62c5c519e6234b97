"""Alignment search against full dynamic programming."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import assign, search
from binloom.operators.search import Scoring

PROTEINS = "   A  C  D  E\nA  4  0 -2 -1\nC  0  9 -3 -4\nD -2 -3  6  2\nE -1 -4  2  5\n"


def best_score(a, b, scoring):
    """The best local alignment's score, all cells of both sequences."""
    table, low = scoring.table(), -(10**9)
    held, gap, best = [0] * (len(b) + 1), [low] * (len(b) + 1), 0
    for x in a.upper().encode():
        now, side = [0] * (len(b) + 1), low
        for j, y in enumerate(b.upper().encode(), 1):
            gap[j] = max(gap[j], held[j] - scoring.opening) - scoring.extension
            side = max(side, now[j - 1] - scoring.opening) - scoring.extension
            now[j] = max(0, held[j - 1] + int(table[x, y]), gap[j], side)
            best = max(best, now[j])
        held = now
    return best


def mutated(rng, text, alphabet, changes):
    out = list(text)
    for _ in range(changes):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice(alphabet)], [out[k], rng.choice(alphabet)]])
    return "".join(out)


def test_bands_wide_enough_give_the_full_score():
    rng = random.Random(8)
    for scoring in (Scoring(), Scoring(match=1, mismatch=-1, opening=0, extension=1), Scoring(opening=11, extension=1, matrix=search.read_matrix(PROTEINS.splitlines()))):
        alphabet = "ACDE"
        pairs = []
        for _ in range(60):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + mutated(rng, a, alphabet, rng.randint(0, 8)) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
            pairs.append((a, b))
        q, t = ([p[k].encode() for p in pairs] for k in (0, 1))
        got = search.aligned(q, t, np.array([-len(a) for a in q]), np.array([len(b) for b in t]), scoring)
        assert got[:, 0].tolist() == [best_score(a, b, scoring) for a, b in pairs]
        for (a, b), (score, q0, q1, t0, t1) in zip(pairs, got.tolist(), strict=True):  # the places it names hold that score
            assert score == best_score(a[q0:q1], b[t0:t1], scoring) and (score == 0 or a[q0] and b[t0])


def test_search_against_full_alignment(spark):
    rng = random.Random(9)
    said = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    queries = [(i, said(rng.randint(80, 200)), "x") for i in range(8)] + [(20, None, "x"), (21, "acg", "x"), (None, said(50), "x")]
    targets = [(f"t{i}", said(rng.randint(50, 300)) + mutated(rng, queries[i % 8][1].upper(), "ACGT", rng.randint(0, 9)) + said(rng.randint(0, 300))) for i in range(24)]
    targets += [(f"r{i}", said(300)) for i in range(12)] + [("none", None), ("", ""), (None, said(60)), ("long", said(20_000) + queries[0][1] + said(20_000)), ("twice", queries[1][1] + said(500) + queries[1][1][:60])]
    q, t = spark.createDataFrame(queries, "gene long, protein string, target string"), spark.createDataFrame(targets, "scaffold string, sequence string")
    scoring = Scoring()
    got = {(r.query, r.target): r for r in search.search(q, t, "gene", "protein", "scaffold", "sequence", scoring).collect()}
    assert {(i % 8, f"t{i}") for i in range(24)} | {(0, "long"), (1, "twice")} == set(got)
    text = dict(targets)
    for (i, name), r in got.items():
        if name != "long":
            assert r.score == best_score(queries[i][1], text[name], scoring)
        assert r.score == best_score(queries[i][1][r.q_start : r.q_end], text[name][r.t_start : r.t_end], scoring)
    size = sum(len(s or "") for n, s in targets if n is not None)
    r = got[0, "long"]
    counts = search.letter_counts(t.filter("scaffold is not null").select(search.letters(F.col("sequence")).alias("letters")))
    rate = search.rate_of(counts, scoring.table())
    p = counts / counts.sum()
    assert abs((np.outer(p, p) * np.exp(rate * scoring.table())).sum() - 1) < 1e-9 and counts.sum() == size
    assert (r.score, r.q_end - r.q_start) == (2 * len(queries[0][1]), len(queries[0][1])) and math.isclose(r.bits, (rate * r.score - math.log(0.41)) / math.log(2))
    assert math.isclose(r.evalue, len(queries[0][1]) * size * 2**-r.bits)
    assert search.search(q.limit(0), t, "gene", "protein", "scaffold", "sequence").count() == 0 == search.search(q, t.limit(0), "gene", "protein", "scaffold", "sequence").count()


def test_words_near_by_a_matrix(spark):
    scoring = Scoring(opening=11, extension=1, word=3, stride=1, pairs=1, threshold=11, rate=0.3, factor=0.04, matrix=search.read_matrix(PROTEINS.splitlines()))
    found = search.neighbourhood(spark.createDataFrame([(1, 0, bytearray(b"ADC")), (1, 1, bytearray(b"AAA"))], "id long, place int, word binary"), scoring)
    table = scoring.table()
    every = [a + b + c for a in "ACDE" for b in "ACDE" for c in "ACDE"]
    want = {(k, w) for k, q in enumerate(["ADC", "AAA"]) for w in every if sum(table[ord(x), ord(y)] for x, y in zip(q, w, strict=True)) >= 11}
    assert {(r.place, bytes(r.word).decode()) for r in found.collect()} == want and (0, "AEC") in want
    q, t = spark.createDataFrame([("g", "DDDDDDDD")], "id string, s string"), spark.createDataFrame([(1, "AAAADDEDDEDDEAAA"), (2, "CCCCCCCCCC")], "id int, s string")
    got = search.search(q, t, "id", "s", "id", "s", scoring, evalue=1e9).collect()
    assert [(r.target, r.score) for r in got] == [(1, 40)] and best_score("DDDDDDDD", "AAAADDEDDEDDEAAA", scoring) == 40  # no word in common
    with pytest.raises(ValueError, match="negative on average"):
        search.rate_of(np.ones(256), np.ones((256, 256)))


def test_hits_feed_the_assignment(spark):
    rng = random.Random(10)
    said = lambda n: "".join(rng.choice("acdefghiklmnpqrstvwy") for _ in range(n))
    known = [("p1", said(120), "a protein [Thermus aquaticus]"), ("p2", said(120), "other [Bacillus subtilis]"), ("p3", said(120), "third [Vibrio fischeri]")]
    genes = [("g1", "COG1", "s1", known[0][1][10:100]), ("g2", "COG1", "s1", known[1][1][:40]), ("g3", "COG2", "s2", known[1][1]), ("g4", "COG9", "s2", known[2][1])]
    g = spark.createDataFrame(genes, "gene_id string, cog_id string, scaffold string, sequence string")
    database = spark.createDataFrame(known, "target string, sequence string, title string")
    results = search.hit_lists(search.search(g, database, "gene_id", "sequence", "target", "sequence"), database)
    assert {r.gene_id: [h.title for h in r.hits] for r in results.collect()} == {"g1": [known[0][2]], "g2": [known[1][2]], "g3": [known[1][2]], "g4": [known[2][2]]}
    markers = spark.createDataFrame([("COG1",), ("COG2",)], "cog_id string")
    best = assign.best_group(assign.score_sums(assign.gene_hits(g.drop("sequence"), results, markers)))
    assert {r.scaffold: r.genus for r in best.collect()} == {"s1": "thermus", "s2": "bacillus"}
