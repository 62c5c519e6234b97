"""Near duplicates, paragraphs, long repeats, mixing, neighbours and the pipeline, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binloom.llm import graphann, minhash, mixing, paragraphs, queries, runindex, textbytes
from binloom.llm.components import components
from binloom.session import table


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n, least=1):
    w = words_of(text)
    if len(w) < least or not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def brute_groups(texts, n, percent=80, least=1):
    """Least id reachable for each id of {id: text}."""
    sets = {i: shingles(t, n, least) for i, t in texts.items()}
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in at[g] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, sets


def near_copies(n=160, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    texts = {}
    for i in range(n):
        if i > 10 and rng.random() < 0.7:
            w = texts[rng.randrange(10 if i % 2 else i)].split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 40, 120])))
    return texts


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    want, sets = brute_groups(texts, 4)
    got = {r.id: (r.n, r.component) for r in minhash.groups(df, minhash.Banding(words=4)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_groups_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One word"), (5, "one  WORD"), (6, "one word"), (6, "one word"), (None, "one word"), (7, "x " * 5000), (8, "x " * 5000 + "y")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = Counter((r.id, r.n, r.component) for r in minhash.groups(df, minhash.Banding(words=4)).collect())
    # "x x x x" once, and with "x x x y" twice: one of two shingles in common
    assert got == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (6, 1, 4), (None, 1, None), (7, 1, 7), (8, 2, 8)])
    assert minhash.groups(df.limit(0), minhash.Banding()).count() == 0
    assert minhash.groups(df.filter("id < 4"), minhash.Banding()).count() == 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(150):
        n = int(rng.integers(2, 400))
        k = int(n * rng.uniform(0.2, 1))
        u = rng.integers(0, 2**63, size=3 * n).astype(np.uint64)
        a, b = np.unique(u[:n]), np.unique(np.r_[u[:k], u[n : 2 * n - k]])
        s = minhash.signatures([a, b, a], 128)
        assert (s[0] == s[2]).all()
        off.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.01 and np.sqrt(np.mean(np.square(off))) < 0.045
    assert minhash.Banding().missed(0.8) < 1e-7 and paragraphs.BANDING.missed(0.8) < 1e-4


def test_intersections_and_bridges():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, size=30)).astype(np.uint64) for _ in range(50)]
    both = minhash.intersections(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(50) for j in range(50) if i != j)
    found = minhash.bridges(sets, np.arange(50), 35)
    texts = {i: s for i, s in enumerate(sets)}
    near = lambda i, j: 100 * len(np.intersect1d(texts[i], texts[j])) >= 35 * len(np.union1d(texts[i], texts[j]))
    assert all(near(i, j) for i, j in found)
    parent = list(range(50))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in found:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    assert all(find(i) == find(j) for i in range(50) for j in range(i) if near(i, j))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (None, 1), (400, 401), (401, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def pieces_of(text):
    """Paragraphs of a text: cut before each word whose value is the least of its neighbours' on either side."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    near, (p, q), m = paragraphs.NEAR, paragraphs.FACTORS, paragraphs.MODULUS
    sums = [sum((j + 1) * c for j, c in enumerate(re.sub("[A-Z]", lambda x: x[0].lower(), text[a:b]).encode())) for a, b in spans]
    value = [(x * p + y * q) % m for x, y in zip(sums, [*sums[1:], 0], strict=True)] if sums else []
    at = [spans[i][0] for i, v in enumerate(value) if near < i < len(value) - near and v < min(value[i - near : i]) and v <= min(value[i + 1 : i + near + 1])]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


def test_paragraphs(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    shared = [line(60) + ". " for _ in range(5)] + [line(9) + ". ", line(20) + "! " + line(31) + "? "]
    texts = {}
    for i in range(60):
        parts = [line(rng.randint(1, 30)) + rng.choice(["\n", " ", ". ", "。", ".", "  "]) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(shared).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w) - 1)] = "other"
            parts.insert(rng.randrange(len(parts) + 1), ". " + " ".join(w))
        texts[i] = "".join(parts)
    texts[70] = texts[71] = line(30000)  # one paragraph of 30,000 words
    texts[72] = "A. b.\n\n c!  d. " + shared[0]
    rows = [(i, t, "x", 1, 2, 3) for i, t in texts.items()] + [(100, None, "x", 1, 2, 3), (101, "", "x", 1, 2, 3), (None, shared[0], "x", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Removed string, _id int, key int, version int")
    got = {r.doc_id: r for r in paragraphs.remove(df).collect()}
    pieces = {(i, k): p for i, t in texts.items() for k, p in enumerate(pieces_of(t))}
    want, sets = brute_groups(pieces, 5)
    many = Counter(want[p] for p in pieces if sets[p])
    for i, t in texts.items():
        gone = sorted(k for (d, k), c in want.items() if d == i and c != (d, k))
        assert got[i].removed == gone and got[i].kept_text == "".join(p for k, p in enumerate(pieces_of(t)) if k not in gone)
        assert got[i].kept_in == sorted({want[i, k][0] for k in gone}) and (got[i]._id, got[i].key, got[i].version) == (1, 2, 3)
        assert got[i].shared == sorted(k for (d, k), c in want.items() if d == i and many[c] > 1)
    assert got[100].kept_text is None and got[101].kept_text == "" and got[None].removed == [] and sum(len(r.removed) for r in got.values()) > 20
    assert len(got[71].removed) > 1000 and got[71].kept_in == [70] and got[71].kept_text == "" and got[70].removed == []
    assert min(len(words_of(p)) for (i, k), p in pieces.items() if (i, 1) in pieces) > paragraphs.NEAR
    assert paragraphs.remove(df.limit(0)).count() == 0


def test_passages_within_longer_texts(spark):
    """A passage is found wherever it stands, whatever its marks: in short sentences, without any, over lines; nothing else is."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    said = lambda n: " ".join(word() for _ in range(n))
    passages = [f() for f in (lambda: ". ".join(said(12) for _ in range(6)), lambda: said(60), lambda: "\n".join(said(9) for _ in range(7))) for _ in range(4)]
    rows = [(100 * k + i, f"{said(rng.randint(5, 90))} {said(rng.randint(5, 90))}. {p} {said(rng.randint(5, 150))}") for k, p in enumerate(passages) for i in range(10)]
    rows += [(5000 + i, said(200)) for i in range(50)]
    got = {r.doc_id: r for r in paragraphs.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(len(passages)):
        assert all(got[100 * k + i].removed and set(got[100 * k + i].kept_in) <= set(range(100 * k, 100 * k + i)) for i in range(1, 10)) and got[100 * k].removed == []
    assert all(got[5000 + i].shared == [] for i in range(50))


def test_prefixes_keep_all_that_have_their_like(spark):
    """Every paragraph with a like at 0.8 is kept by the shared prefixes, and most others are not."""
    texts = near_copies(120, seed=8)
    got = {(r.doc_id, n) for r in paragraphs.likely(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", paragraphs.BANDING, "query").collect() for n in r.numbers}
    units = {(i, k): p for i, t in texts.items() for k, p in enumerate(pieces_of(t))}
    want, sets = brute_groups(units, 5)
    many = Counter(want[u] for u in units if sets[u])
    like = {u for u in units if sets[u] and many[want[u]] > 1}
    assert like <= got < {u for u in units if sets[u]}


def test_sums_of_long_texts():
    data = np.frombuffer(b"Ab " * 200_000 + b"x" * 300_000 + b" ab", dtype=np.uint8)
    starts, ends, _ = textbytes.words(data, np.array([0, len(data)]))
    got = paragraphs.byte_sums(data, starts, ends)
    assert set(got[:-2].tolist()) == {97 + 2 * 98} == {int(got[-1])} and got[-2] == 120 * (300_000 * 300_001 // 2) % paragraphs.MODULUS


def test_versions_of_one_id(spark):
    """Rows that share an id only are grouped one by one."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b, c = (" ".join(word() for _ in range(100)) for _ in range(3))
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " more"), (3, c), (2, c)], "id long, text string")
    got = {(r.id, r.th): r.component for r in minhash.groups(df, minhash.Banding()).collect()}
    th = {(r.id, r.text): r.th for r in df.withColumn("th", F.xxhash64("text")).collect()}
    assert got == {(1, th[1, a]): 1, (1, th[1, b]): 1, (2, th[2, b + " more"]): 1, (3, th[3, c]): 2, (2, th[2, c]): 2}


def test_hashes_of_alternating_words(spark):
    """Words that collide in sums modulo a power of two, whatever the base, are told apart."""
    w = "a"
    for _ in range(12):
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"one two three {w}"), (2, f"one two three {other}"), (3, f"one two three {w}")], "id long, text string")
    assert {r.id: r.component for r in minhash.groups(df, minhash.Banding(words=4)).collect()} == {1: 1, 2: 2, 3: 1}
    data = np.frombuffer((w + other).encode(), dtype=np.uint8)
    for hashes in (textbytes.span_hash(textbytes.prefix_hash(data), np.array([0, len(w)]), np.array([len(w), 2 * len(w)])), textbytes.word_hash(data, np.array([0, len(w)]), np.array([len(w), 2 * len(w)]))):
        assert hashes[0] != hashes[1]
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, size=40000).astype(np.uint8)  # several blocks of prefix sums
    data[30000:30500] = data[100:600]
    h = textbytes.prefix_hash(data)
    a = rng.integers(0, 480, size=200)
    assert (textbytes.span_hash(h, 100 + a, 120 + a) == textbytes.span_hash(h, 30000 + a, 30020 + a)).all()
    k = sum(int(textbytes.BYTE_VALUES[0][c]) * pow(textbytes.BASES[0], i, textbytes.PRIME) for i, c in enumerate(data[20000:20050].tolist())) % textbytes.PRIME
    assert int(textbytes.span_residues(h, np.array([20000]), np.array([20050]))[0]) >> 31 == k


def brute_repeats(texts, w):
    """Flags of the bytes that windows of w bytes cover which start elsewhere too."""
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                flags[i : i + w] = b"\1" * w
        out.append(bytes(flags))
    return out


def test_index_of_small_texts():
    rng = random.Random(4)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [bytes(rng.choice(b"abc\0") for _ in range(rng.randint(0, 20))) + base[(a := rng.randrange(60)) : a + rng.randint(0, 50)] for _ in range(rng.randint(1, 8))]
        w = rng.randint(3, 14)
        for t, spans, flags in zip(texts, runindex.RunIndex(texts).long_matches(w)[0], brute_repeats(texts, w), strict=True):
            mine = bytearray(len(t))
            for a, b in zip(spans[0::2], spans[1::2], strict=True):
                mine[a:b] = b"\1" * (b - a)
            assert bytes(mine) == flags


@pytest.mark.parametrize("group", [runindex.GROUP, 1])
def test_long_repeats(spark, group):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = [draw(rng.randint(30, 200)) for _ in range(6)]
    texts = ["".join(rng.choice([draw(rng.randint(0, 60)), (p := rng.choice(passage))[: rng.randint(20, len(p))]]) for _ in range(rng.randint(0, 5))) for _ in range(70)]
    texts += ["ab" * 300, "x" * 500, "xyz" * 200, "", passage[0], passage[0], "\x00" * 50 + passage[1]]
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)] + [(3, texts[3], "a", 1), (500, None, "a", 1), (None, passage[2], "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, _i int").repartition(3)
    df = df.withColumns({"_h": F.lit(2), "_g": F.lit(3), "_marks": F.lit(4), "data": F.lit(5), "marks": F.lit(6), "c0": F.lit(7)})
    found = runindex.remove_repeats(df, window=40, short=24, gram=8, shard_bytes=2000, group=group).collect()
    assert len(found) == len(rows) and {(r._i, r._h, r._g, r._marks, r.data, r.marks, r.c0) for r in found} == {(1, 2, 3, 4, 5, 6, 7)}
    raw = [(t or "").encode() for _, t, _, _ in rows]
    flags = defaultdict(set)
    for (i, t, _, _), f, near in zip(rows, brute_repeats(raw, 40), brute_repeats(raw, 24), strict=True):
        flags[i, t].add((f, near))
    seen = total = 0
    for r in found:
        ((want, near),) = flags[r.doc_id, r.text]
        data = (r.text or "").encode()
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", want)]
        assert (r.n_bytes, [tuple(s) for s in r.spans]) == (len(data), spans)
        assert bytes(r.kept) == bytes(b for b, f in zip(data, want, strict=True) if not f)
        shared = bytearray(len(data))
        for a, b in r.shared:
            shared[a:b] = b"\1" * (b - a)
        assert all(n >= s >= w for n, s, w in zip(near, shared, want, strict=True))  # true matches only, and all of the long ones
        seen, total = seen + sum(shared) - sum(want), total + sum(near) - sum(want)
    assert group == 1 or seen > 0.3 * total
    assert runindex.remove_repeats(df.limit(0)).count() == 0


def test_runs_that_stand_once_are_not_written_and_texts_move_once(spark, monkeypatch):
    rng = random.Random(28)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(3000))) for i in range(20)]
    rows.append((20, rows[0][1][:700] + "".join(rng.choice("abcdefgh ") for _ in range(700))))
    made, whole = [], runindex.written

    def noted(df, owner="query"):
        made.append(whole(df, owner))
        return made[-1]

    monkeypatch.setattr(runindex, "written", noted)
    found = runindex.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    every = next(t for t in made if "reach" in t.columns)
    assert {r._id for r in every.select("_id").distinct().collect()} == {0, 20}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect() if r.spans} == {0: [(0, 700)], 20: [(0, 700)]}
    plan = runindex.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_key") <= 2 and plan.count("Exchange hashpartitioning") <= 4


def test_windows_of_crowded_anchors_meet_once_a_chunk(spark):
    """A passage within very many contexts is counted without a row for each window of each of them."""
    rng = random.Random(29)
    draw = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    passage = draw(60)
    texts = [draw(20) + passage[rng.randint(0, 30) :] + draw(20) for _ in range(400)] + [draw(70), draw(19), b""]
    rows = [(7, i, i % 50 == 3, i * 1000, t) for i, t in enumerate(texts)]
    wanted = brute_repeats(texts, 25)
    for n in (1, 5, 403):  # chunks
        df = spark.createDataFrame(rows, "anchor long, ctx long, several boolean, place long, bytes binary").repartition(n)
        found = runindex.counted_matches(df, 25)
        got = {r.ctx: bytearray(len(texts[r.ctx])) for r in found.collect()}
        for r in found.collect():
            for a, b in zip(r.spans[0::2], r.spans[1::2], strict=True):
                got[r.ctx][a:b] = b"\1" * (b - a)
        assert got == {i: f for i, f in enumerate(wanted) if any(f) and i % 50 != 3}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") <= 2
    found = runindex.counted_matches(spark.createDataFrame(rows, "anchor long, ctx long, several boolean, place long, bytes binary").coalesce(1), 25)
    assert found.filter(F.size("spans") == 2).count() > 350  # whole runs, not windows one by one


@pytest.mark.parametrize("group", [runindex.GROUP, 1])
def test_passages_of_words(spark, group):
    """Passages of so many words that start elsewhere too go, whatever white space parts the words, beside the long strings."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [said(rng.randint(5, 30)) for _ in range(12)]
    texts = []
    for _ in range(60):
        words = said(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            words += rng.choice(shared) + said(rng.randint(0, 30))
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in words))
    texts += ["a " * 50, "é é é\n" * 9, "", None, " \n ", said(1)[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = runindex.remove_repeats(df, window=60, short=60, gram=8, shard_bytes=2000, group=group, words=8).collect()
    raw = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in raw]
    key = lambda i, k: tuple(raw[i][a:b] for a, b in places[i][k : k + 8])
    seen = Counter(key(i, k) for i in range(len(raw)) for k in range(len(places[i]) - 7))
    assert len(found) == len(texts)
    want = brute_repeats(raw, 60)
    short_ones = 0
    for r in found:
        flags = bytearray(want[r.doc_id])
        for k in range(len(places[r.doc_id]) - 7):
            if seen[key(r.doc_id, k)] > 1:
                a, b = places[r.doc_id][k][0], places[r.doc_id][k + 7][1]
                flags[a:b] = b"\1" * (b - a)
        short_ones += flags != want[r.doc_id]
        assert [tuple(x) for x in r.spans] == [m.span() for m in re.finditer(b"\1+", flags)]
        assert bytes(r.kept) == bytes(b for b, f in zip(raw[r.doc_id], flags, strict=True) if not f)
    assert short_ones > 10


def test_repeats_stage_removes_passages_over_50_words(spark):
    """Passages of 51 words and about 300 bytes that stand in several documents are gone from each; documents without any stay as they are."""
    rng = random.Random(10)
    said = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passages = [said(51) for _ in range(8)]
    assert all(250 < len(p) < 400 for p in passages)
    own = [(said(rng.randint(20, 60)), said(rng.randint(20, 60))) for _ in range(40)]
    texts = [f"{a} {passages[i % 8]} {b}" if i < 32 else f"{a} {said(51)} {b}" for i, (a, b) in enumerate(own)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.remove_repeats(spark, docs, FOLDER).collect()}
    want = [f"{a}  {b}" if i < 32 else texts[i] for i, (a, b) in enumerate(own)]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_long_repeats_of_one_very_long_text(spark):
    rng = random.Random(18)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    base = base[:99_999] + "!" + base[100_000:150_000] + "?" + base[150_001:]
    rows = [(1, base[:300_000] + base[100_000:150_000] + base[300_000:]), (2, base[350_000:350_900] + "z" * 900), (3, base[:399])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in runindex.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(100_000, 150_000), (300_000, 350_000), (400_000, 400_900)], 2: [(0, 1800)], 3: []}


def mix_by_hand(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, open_ = {}, share * sum(size.values()), set(sources)
    while open_:
        part = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * part > most * size[s]}
        if not full:
            target |= {s: weight[s] * part for s in open_}
            break
        target |= {s: most * size[s] for s in full}
        left -= sum(most * size[s] for s in full)
        open_ -= full
    return size, target


def test_mixing(spark):
    rng = random.Random(9)
    names = ["b", "a", None, "Z", "é", ""]
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(names), " ".join(["w"] * int(rng.expovariate(1 / 30)))) for i in range(1500)] + [(2000, "empty", ""), (2001, None, None), (1, "a", "w w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix(df).collect()
    size, target = mix_by_hand(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(2)).collect()))
    out = Counter((r.doc_id, r.source) for r in mixing.emitted(df.withColumn("row", F.lit(1)).withColumn("size", F.lit("z"))).collect())
    want = Counter()
    for r in got:
        want[r.doc_id, r.source] += r.copies
    assert out == +want
    assert mixing.mix(df.limit(0)).count() == 0 and {r.copies for r in mixing.mix(df.filter("doc_id = 2000")).collect()} == {0}


def test_mixing_of_ids_of_any_type(spark):
    rows = [(f"id {i % 40}", "a", "w " * (i % 7)) for i in range(80)] + [(None, None, "w")] * 3
    df = spark.createDataFrame(rows, "doc_id string, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    marks = mixing.mix(spark.createDataFrame([(None, "a", f"w{i}") for i in range(500)], "doc_id int, source string, text string"))
    assert marks.agg(F.sum("copies")).first()[0] == 750


def test_mixing_agrees_on_repeated_ids(spark):
    """Rows of one id in one size class, differing in size or text only, in whatever order they come."""
    rows = [(1, "s", " ".join(["w"] * (16 + i % 2)) + f" {i % 5}") for i in range(40)] + [(i, "s", "a b c") for i in range(2, 30)] + [(i, "t", "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = [Counter((r.row.doc_id, r.row.text, r.copies) for r in mixing.mix(df.repartition(n), carry=True).collect()) for n in (1, 7, 11)]
    assert found[0] == found[1] == found[2]


def exact_nearest(rows, queries_, most):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for q, x in good:
        if queries_(q):
            near = sorted((-float(np.dot(x, v)), i) for i, v in good if i != q and len(v) == len(x))[:most]
            out[q] = [(i, -d) for d, i in near]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, size=(900, 1))
    x[100:160] = x[100]  # copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 12), (1040, [None] * 12), (1060, [float("nan")] * 12), (1080, [float("inf")] * 12), (1100, []), (1120, [1.0, 2.0]), (1121, [3.0, 4.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, rank string")
    found = defaultdict(list)
    for r in graphann.search(df, F.col("vec_id") % 20 == 0, shard_size=350).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    want = exact_nearest(rows + odd, lambda i: i % 20 == 0, 20)
    assert set(found) == set(want) and found[1120] == [(1121, 11.0)]
    assert sum(len({i for i, _ in found[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.97 * sum(map(len, want.values()))
    assert [i for i, _ in found[100]][:20] == list(range(101, 121)) or found[100][0][1] > want[100][0][1] - 1e-9
    few = graphann.search(df.filter("vec_id in (20, 21, 40)"), F.col("vec_id") % 20 == 0).collect()
    assert Counter(r.query_id for r in few) == {20: 2, 40: 2}
    assert graphann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and graphann.search(df.filter("vec_id between 1000 and 1080"), F.col("vec_id") % 20 == 0).count() == 0


FOLDER = "/root/testdata/sf0.001"


def test_queries_cover_every_document(spark):
    docs = table(spark, FOLDER, "documents").toPandas()
    got = queries.op6_minhash(spark, FOLDER).toPandas()
    want, sets = brute_groups(dict(zip(docs.doc_id, docs.text, strict=True)), 4)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == {(i, len(sets[i]), want[i], want[i] == i) for i in want}
    raw = [t.encode() for t in docs.text]
    seen = Counter(hash(t[i : i + 400]) for t in raw for i in range(len(t) - 399))
    expected = {}
    for i, t in zip(docs.doc_id, raw, strict=True):
        flags = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                flags[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        expected[i] = (len(t), len(t) - len(kept), len(re.findall(b"\1+", flags)), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_run_index(spark, FOLDER).toPandas().itertuples()} == expected
    n = len(docs)
    for name in ("op1_paragraphs", "op2_bpe", "op4_quality", "op5_mixing", "op7_media", "op8_toxicity", "op10_class_lm"):
        assert queries.QUERIES[name](spark, FOLDER).count() == n


def test_pipeline_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = table(spark, FOLDER, "documents")
    kinds = dict(docs.dtypes)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        after = docs.toPandas()
        if name != "bpe":
            assert dict(docs.dtypes) == kinds
        if name == "toxicity":
            labels = table(spark, FOLDER, "labels").toPandas()
            assert set(after.doc_id) <= set(before.doc_id) and set(labels.doc_id[labels.toxic == 0]) & set(before.doc_id) <= set(after.doc_id)
        if name == "near-dedup":
            want, _ = brute_groups(dict(zip(before.doc_id, before.text, strict=True)), 5)
            assert set(after.doc_id) == {i for i, c in want.items() if i == c}
        if name == "suffix-array dedup":
            texts = dict(zip(before.doc_id, before.text, strict=True))
            flags = dict(zip(texts, brute_repeats([t.encode() for t in texts.values()], 400), strict=True))
            for i, t in zip(after.doc_id, after.text, strict=True):
                assert t == bytes(b for b, f in zip(texts[i].encode(), flags[i], strict=True) if not f).decode(errors="ignore")
        if name == "mixing":
            size, target = mix_by_hand([(r.doc_id, r.source, r.text) for r in before.itertuples()])
            assert after.groupby("doc_id").size().max() <= 2 and abs(sum(len(words_of(t)) for t in after.text) - sum(target.values())) < 0.2 * sum(target.values())
            assert size
        if name == "bpe":
            assert after.same.all() and len(after) == len(before)
        kept[name] = len(after)
    assert corpus_pipeline.run(spark, FOLDER).count() == kept["bpe"]


def test_word_hashes():
    rng = random.Random(21)
    found = {bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 150))) for _ in range(3000)} | {b"a" * n for n in range(70)} | {b"\0" * n for n in range(70)}
    spans = [w for w in sorted(found) for _ in (0, 1)]
    rng.shuffle(spans)
    parts = [bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 9))) for _ in spans]
    data = np.frombuffer(b"".join(p + w for p, w in zip(parts, spans, strict=True)), dtype=np.uint8)
    ends = np.cumsum([len(p) + len(w) for p, w in zip(parts, spans, strict=True)])
    hashes = textbytes.word_hash(data, ends - [len(w) for w in spans], ends).tolist()
    by_word = defaultdict(set)
    for w, h in zip(spans, hashes, strict=True):
        by_word[w].add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len(set(hashes)) == len(found)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids that recur, columns with names that the stages use."""
    rng = random.Random(20)
    said = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    long, twin = said(30_000), said(90)
    texts = [(1, twin, "en", "s"), (1, twin, "en", "s"), (1, said(80), "en", "s"), (2, twin + " more", "de", None), (3, None, None, "t"), (4, "", "en", "t"), (None, said(70), None, None), (None, None, None, None), (5, long, "en", "u"), (6, "x y z", "en", "u"), (7, " \t\n", "en", "u")]
    rows = [(i, t, lang, source, None if t is None else len(t), "k", 1, 2.0, "m", 3, b"w", 4) for i, t, lang, source in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, _id int, score double, row string, size int, spans binary, toxicity0 int")


def test_pipeline_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    extra = docs.columns[5:]
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        found, empty = out.collect(), stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0 and empty.schema.names == out.schema.names
        if name == "bpe":
            assert all(r.same for r in found) and len(found) == docs.count()
            continue
        assert out.columns == docs.columns and {tuple(r[c] for c in extra) for r in found} == {("k", 1, 2.0, "m", 3, b"w", 4)}
        now = Counter((r.doc_id, r.text) for r in found)
        if name == "toxicity":
            assert now == texts  # nothing here is toxic
        if name == "near-dedup":
            gone = texts - now
            assert {i for i, _ in gone} == {1, 2} and sum(gone.values()) == 2  # one of the equal rows, and the near copy
        if name == "suffix-array dedup":
            assert sum(now.values()) == docs.count() and now == Counter((r.doc_id, r.text) for r in docs.collect())  # no repeats are left
        docs = spark.createDataFrame(found, out.schema)


def test_repeats_stage_on_equal_rows(spark):
    """Equal rows are repeats of each other: both become empty."""
    text = "".join(random.Random(3).choice("abc ") for _ in range(500))
    docs = spark.createDataFrame([(1, text, "en", "s", 500), (1, text, "en", "s", 500), (2, text[:450] + "é" * 100, "en", None, 550)], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.remove_repeats(spark, docs, FOLDER).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in found) == Counter({(1, "", 0): 2, (2, "é" * 100, 100): 1})
