"""Class language model, classifiers, tokenizer, media: brute force, round trips, odd rows."""

import base64
import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from binloom.llm import bpe, classlm, learning, media, queries, quality, textbytes, toxicity

PATH, PATTERN = public_tokenizers.path(queries.TOKENIZER), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, score string"
ODD = [(1, None, "x", "y"), (2, "", "x", None), (3, "word", None, "y"), (3, "word", None, "y"), (None, "a b", "x", "y"), (5, "é \x00\t  ​x" + "long " * 3000, "x", "y")]


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_reference_ids(encoding):
    encoder, tokens = bpe.loaded(open(PATH, "rb").read(), PATTERN), bpe.token_bytes(open(PATH, "rb").read())
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "1", "!", "ing", "'s", "ß", "中", "​", "\x1d", "🙂", "\r\n", "\x85", "zzzz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["", "a" * 700, " " * 400 + "x", "日本語" * 90]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
        assert bpe.decoded(ids, tokens) == text.encode()
    for _ in range(40):
        word = "".join(rng.choice("etaonirsh") for _ in range(rng.randint(100, 500))).encode()
        assert encoder.vocabulary.merge_long(word) == encoder.vocabulary.merge_rows([word], 512)[0]


def test_bpe_rows(spark, encoding):
    df = spark.createDataFrame(ODD, SCHEMA)
    coded = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN, to="score")
    assert coded.columns == ["doc_id", "text", "ids", "score"]
    for r in coded.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(r.text or "") and bytes(r.score) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_ids_and_what_they_decode_to_by_one_worker_a_task(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    both = bpe.encode_decode(df, PATH, PATTERN, to="score")
    want = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN, to="score")
    assert both.columns == want.columns and sorted(map(str, both.collect())) == sorted(map(str, want.collect()))
    stage = corpus_pipeline.tokenize(spark, df.selectExpr("doc_id", "text", "'en' as lang", "ids as source"), "unused")
    assert all(r.same for r in stage.collect())
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_results_named_as_columns_in_other_case(spark):
    """A column that differs from a result in case only is replaced."""
    docs = spark.createDataFrame([(1, "a good text", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, IDS string, Score string")
    coded = bpe.encode(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "Score", "ids"] and coded.count() == 2
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for kind in (quality, toxicity):
        found = kind.score(docs, kind.fit(docs, labels))
        assert found.columns == ["doc_id", "text", "IDS", "score"] and all(0 <= r.score <= 1 for r in found.select("score").collect())


def test_media_keeps_the_payload(spark):
    df = spark.createDataFrame([*ODD, (7, "x" * 63, "a", "b"), (8, "x" * 64, "a", "b"), (9, "x" * 65, "a", "b"), *((20 + i, f"text {i} " * i, "a", "b") for i in range(30))], SCHEMA)
    stored = media.store(df.withColumn("payload", media.payload(F.col("text"))), "payload", to="media")
    back = media.read(stored.withColumns({"codes": F.lit(1), "Feature": F.lit(2)}), with_pcm=True)
    rows = back.withColumn("samples", media.pcm_samples(F.col("pcm"))).collect()
    assert media.read(stored.limit(0), with_pcm=True).count() == 0 == media.store(stored.limit(0), "payload").count()
    seen = set()
    for r in rows:
        raw = (r.text or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert bytes(r.codes) == want == bytes(r.payload) and len(want) % 64 == 0
        name = r.feature.split(";")[0]
        seen.add(name)
        assert len(r.samples) == (8 if name == "adpcm" else 4) * len(want) and r.feature.endswith(f"{zlib.crc32(bytes(r.samples)):08x}")
        with wave.open(io.BytesIO(bytes(r.pcm))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 2 * media.RATE) and w.readframes(w.getnframes()) == bytes(r.samples)
    assert seen == set(media.TAGS)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"RIFF")), (3, bytearray(b"nothing" * 20)), (4, bytearray(media.wav("mulaw", b"x" * 64)[:-1]))], "id long, media binary")
    assert {(r.codes, r.feature) for r in media.read(bad).collect()} == {(None, None)}


def test_telephony_tables_and_adpcm():
    assert media.TABLES["mulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.TABLES["alaw"][[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, size=(5, media.BLOCK), dtype=np.uint8)
    blocks[:, 2] %= 89
    for block, got in zip(blocks, media.adpcm(blocks), strict=True):
        value, index, want = int(np.array(block[:2]).view("<i2")[0]), int(block[2]), []
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                move = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(media.CHANGES[code & 7])))
                want.append(value)
        assert got.tolist() == want


def test_resampling():
    weights = media.HALF_BAND.tolist()
    assert 2 * sum(weights) == media.UNITY and len(media.resampled(np.zeros(0, dtype=np.int16))) == 0
    rng = np.random.default_rng(1)
    pcm = rng.integers(-32768, 32768, size=50).astype(np.int16)
    at = lambda i: int(pcm[min(max(i, 0), 49)])
    slow = []
    for i in range(50):
        value = (sum(w * (at(i - k) + at(i + 1 + k)) for k, w in enumerate(weights)) + media.UNITY // 2) // media.UNITY
        slow += [at(i), max(-32768, min(32767, value))]
    assert media.resampled(pcm).tolist() == slow
    t = np.arange(400)
    for hertz in (300, 1000, 2500):  # tones below the band's edge stay as they are
        tone = lambda x, f=hertz: 20000 * np.sin(2 * np.pi * f * x / media.RATE)
        off = media.resampled(np.rint(tone(t)).astype(np.int16)) - tone(np.arange(800) / 2)
        assert np.abs(off[40:-40]).max() < 200


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    kinds = [[f"{p}{i}" for i in range(40)] for p in ("al", "be", "ga")]
    return [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(1, 60))) + (f" only{i}" if i % 4 == 0 else "")) for i in range(n)]


@pytest.mark.parametrize("frequent", [1 << 18, 50])
def test_class_model_against_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(classlm, "FREQUENT", frequent)
    rows = [*corpus(), (900, None), (901, ""), (902, "AL1 al1  al1\tnew"), (902, "AL1 al1  al1\tnew"), (None, "be2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    training = df.filter("doc_id < 250 or doc_id = 902")
    model, counts = classlm.fit(training)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in classlm.score(df, model, counts).collect())
    known = Counter()
    for i, t in rows:
        if i is not None and (i < 250 or i == 902):
            known.update([*words_of(t), None])
    total, distinct = sum(known.values()), len(known)
    want = Counter()
    for i, t in rows:
        w = [*words_of(t), None]
        want[i, len(w), sum(known[x] > 0 for x in w), round(sum(math.log10((known[x] + 1) / (total + distinct + 1)) for x in w), 6)] += 1
    assert got == want and model.train_tokens == total
    # the classes say more than the words alone
    held = classlm.score(df.filter("doc_id between 250 and 299"), model, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    # a class is followed by one of the classes, and holds known words or an unseen one
    assert np.allclose((10**model.follows).sum(axis=1), 1)


@pytest.mark.parametrize("frequent", [1 << 18, 700])
def test_words_of_one_ending_get_classes_of_their_own(spark, monkeypatch, frequent):
    # words that end alike, of two kinds that stand in different places, and more of them than types
    monkeypatch.setattr(classlm, "FREQUENT", frequent)
    rng = random.Random(9)
    left, right = ([f"{p}{i}xyz" for i in range(600)] for p in ("l", "r"))
    heads, tails = (["one", "the", "such"], ["was", "ran", "sat"])
    lines = [" ".join(x for _ in range(12) for x in (rng.choice(heads), rng.choice(left), rng.choice(tails), rng.choice(right))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model, counts = classlm.fit(df)
    assert model.clustered > 0.95
    rare = {r.hash: r.own_class for r in counts.filter("own_class is not null").collect()}
    known = {int(h): int(c) for h, c in zip(model.lookup.hashes.view(np.int64), model.of_word, strict=True) if c >= 0} | rare

    def classes(words):
        data, offsets = toxicity.lowered([w.encode() for w in words])
        word, _, _ = classlm.tokens(data, offsets)
        return Counter(known[int(h)] for h in word.view(np.int64) if int(h) in known)

    a, b = classes(left), classes(right)
    assert sum(a.values()) + sum(b.values()) > 1100 and bool(rare) == (frequent == 700)
    assert sum(n for c, n in a.items() if n > b[c]) > 0.9 * sum(a.values()) and sum(n for c, n in b.items() if n > a[c]) > 0.9 * sum(b.values())
    # the score of a text is that of its words in their classes, whether they are joined or looked up
    plain = {}
    for r in classlm.score(df.limit(30), model, counts).collect():
        data, offsets = toxicity.lowered([lines[r.doc_id].encode()])
        word, shape, _ = classlm.tokens(data, offsets)
        of = [known.get(int(h), int(model.classes[1 + classlm.OWN + s])) for h, s in zip(word.view(np.int64), shape, strict=True)]
        n = Counter(w for t in lines for w in t.split())
        want = sum(model.follows[x, y] for x, y in zip([0, *of], [*of, 0], strict=True)) + sum(math.log10(n[w]) + model.seen[c] for w, c in zip(lines[r.doc_id].split(), of, strict=True)) + math.log10(model.ends) + model.seen[0]
        plain[r.doc_id] = (round(r.score, 6), round(want, 6))
    assert all(x == y for x, y in plain.values())


def test_class_model_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, counts = classlm.fit(df.limit(0))
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in classlm.score(df, model, counts).collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    assert classlm.score(df.limit(0), model, counts).count() == 0


def test_exchange_finds_classes():
    pairs = np.zeros((classlm.TYPES, classlm.TYPES))
    rng = np.random.default_rng(1)
    for _ in range(4000):
        k = rng.integers(2)
        a, b = (1 + 2 * rng.integers(20, size=2) + k).tolist()
        pairs[a, b] += 1
    found = classlm.exchange(pairs, classes=3)
    assert found[0] == 0 and len(set(found[1:41:2])) == 1 and len(set(found[2:42:2])) == 1 and found[1] != found[2]


def labelled(spark, n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "er", "on", "th", "es", "in"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 80))]
        toxic, poor = int(i % 5 == 0), int(i % 4 == 1)
        if toxic:
            for w in ("stupid", "worthless"):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(f"{w}%%%" if poor else w for w in words)))
        labels.append((i, 1 - poor, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame(ODD, SCHEMA)
    tox = toxicity.fit(docs, labels.filter("doc_id < 450"))
    got = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id >= 450"), tox).collect()}
    assert all((s >= 0.5) == (i % 5 == 0) for i, s in got.items())
    disguised = spark.createDataFrame([(1, "the on er stup1d in an w0rthless"), (2, "on s t u p i d er th wooorthleeess"), (3, "an er on in th es")], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(disguised, tox).collect()} == {1: True, 2: True, 3: False}
    good = quality.fit(docs, labels.filter("doc_id < 450"))
    got = {r.doc_id: r.score for r in quality.score(docs.filter("doc_id >= 450"), good).collect()}
    assert sum((s >= 0.7) == (i % 4 != 1) for i, s in got.items()) >= 0.95 * len(got)
    for rows in (toxicity.score(odd, tox), quality.score(odd, good)):
        found = rows.collect()
        assert len(found) == len(ODD) and rows.columns == ["doc_id", "text", "ids", "score"] and all(0 <= r.score <= 1 for r in found)
        assert found[2].score == found[3].score
    assert toxicity.score(odd.limit(0), tox).count() == quality.score(odd.limit(0), good).count() == 0


def test_disguises_of_any_length(spark):
    docs, labels = labelled(spark)
    tox = toxicity.fit(docs, labels)
    texts = {
        "on er such a s t u p i d th": True,
        "y o u w o r t h l e s s s t u p i d an er": True,
        "s t u p i d w o r t h l e s s": True,
        "er a i y s t u p i d o a an": True,
        "on er 5 7 u p 1 d th": True,
        "on er th stup" + "i" * 60 + "d an": True,
        "on er " + ".".join(["therin", "anones"] * 5) + ".stupid.an": True,
        "an " + "e r o n " * 12 + "s t u p i d": True,
        "on er st\u00fapid th": True,
        "on er W\u00d3RTHLESS th": True,
        "an \u00e9r \u00f3n th\u00edn": False,
        "an er 1 2 3 4 5 on th": False,
        "on a e i o an er": False,
        "an " + "e r o n " * 12 + "th in": False,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.score >= 0.5 for r in toxicity.score(rows, tox).collect()}
    assert got == texts
    # words edges where the letters ask for them
    flat = np.full((toxicity.SYMBOLS, toxicity.SYMBOLS), np.log(1e-4))
    for w in ["a", "stupid", "loser"]:
        code = [0, *(ord(c) - 96 for c in w), 0]
        for x, y in zip(code, code[1:], strict=False):
            flat[x, y] = np.log(0.5)
    assert toxicity.restore(["a s t u p i d", "l 0 s e r s t u p i d", "s t u u u u u p i d"], flat) == ["a stupid", "loser stupid", "stupid"]


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r)[:2] for r in learning.sample(nulls, "doc_id", "toxic", 10).collect()] == [(2, 1)]


def test_restoration():
    table = np.full((toxicity.SYMBOLS, toxicity.SYMBOLS), 0.01)
    for w in ["idiot", "stupid", "loser", "little"] * 50:
        code = [0, *(ord(c) - 96 for c in w), 0]
        for a, b in zip(code, code[1:], strict=False):
            table[a, b] += 1
    bigrams = np.log(table / table.sum(axis=1, keepdims=True))
    assert toxicity.restore(["1d10t", "stuuuupid", "l.o.s.e.r", "little", "$tup!d", "LOSER"], bigrams) == ["idiot", "stupid", "loser", "little", "stupid", "loser"]
    assert toxicity.restore([], bigrams) == []


def test_words_and_hashes():
    texts = ["", " a  bb\tc ", "x", "\n", "déjà vu"]
    data, offsets = toxicity.lowered([t.encode() for t in texts])
    starts, ends, doc = textbytes.words(data, offsets)
    got = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(starts, ends, doc, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    h = textbytes.span_hash(textbytes.prefix_hash(data), starts, ends)
    assert len(set(h.tolist())) == len({w for _, w in got})


def test_remainder_is_that_of_the_id_as_text(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 7 for r in df.select("doc_id", classlm.remainder(F.col("doc_id"), 7)).collect())
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(F.lit(b""), 256)).first()[0]


def test_likeliest_letters_against_all_paths():
    """decoded() against every way to read a short token."""
    rng = np.random.default_rng(7)
    bigrams = np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.3), size=toxicity.SYMBOLS) + 1e-9)

    def best(token):
        found = [(-np.inf, "")]

        def read(k, state, total, said):
            if k == len(token):
                found.append((total + bigrams[state, 0], said))
                return
            c = token[k]
            if "a" <= c <= "z":
                ways, drop, kept = [(ord(c) - 96, 0.0, c)], toxicity.LOST, said
            elif c in toxicity.STANDS_FOR:
                ways, drop, kept = [(ord(x) - 96, toxicity.REPLACED, x) for x in toxicity.STANDS_FOR[c]], toxicity.DROPPED, said
            else:
                ways, drop, kept = [(0, toxicity.SEPARATOR, " ")], toxicity.SEPARATOR, said + "\0"
            for to, cost, letter in ways:
                read(k + 1, to, total + bigrams[state, to] + cost, said + letter)
            read(k + 1, state, total + drop, kept)

        read(0, 0, 0.0, "")
        return max(found)[1]

    pick = random.Random(8)
    tokens = []
    while len(tokens) < 60:
        t = "".join(pick.choice("abel1@!|.-") for _ in range(pick.randint(1, 8)))
        if all(x != y for x, y in zip(t, t[1:], strict=False)) and any(c.isalpha() for c in t):
            tokens.append(t)
    assert toxicity.decoded(tokens, bigrams) == [best(t) for t in tokens]


def test_word_vectors_by_hand(spark, monkeypatch):
    """Word vectors and pooled features, token by token."""
    monkeypatch.setattr(quality, "OWN", 6)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "a", "cat", "dog!", "x1", "\u00e9t\u00e9", *(f"rare{i}" for i in range(30))][: rng.choice([4, 36])]) for _ in range(rng.randint(0, 40))) for _ in range(25)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    split = [re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\s\u0080-\U0010ffff]+", t or "") for t in texts]

    def hashed(token):
        data = np.frombuffer(token.encode(), dtype=np.uint8)
        return textbytes.word_hash(data, np.array([0]), np.array([len(data)]))[0]

    own = quality.own_tokens(df, "text")
    count = Counter(w for s in split for w in s)
    inside = {w for w in count if hashed(w) in own}
    assert 0 < len(own) == len(inside) <= 6 and min(count[w] for w in inside) >= max(n for w, n in count.items() if w not in inside)
    place = {w: list(own).index(hashed(w)) if w in inside else len(own) + int(hashed(w) % np.uint64(quality.BUCKETS)) for w in count}
    table = np.zeros((len(own) + quality.BUCKETS, quality.DIMENSIONS))
    for s in split:
        for i, w in enumerate(s):
            for j in range(max(0, i - quality.WINDOW), min(len(s), i + quality.WINDOW + 1)):
                if j != i:
                    drawn = int(textbytes.mix(np.array([hashed(s[j])]))[0])
                    for k in range(quality.SIGNS):
                        table[place[w], (drawn >> 16 * k) % quality.DIMENSIONS] += 1 - 2 * (drawn >> (16 * k + 12) & 1)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    vectors = quality.word_vectors(df, "text", own)
    assert np.abs(vectors - table).max() < 1e-5
    raw = [(t or "").encode() for t in texts]
    got = quality.pooled(own, vectors, np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    for s, row in zip(split, got, strict=True):
        if not s:
            assert not row.any()
            continue
        v = np.array([table[place[w]] for w in s])
        want = [*v.mean(axis=0), *v.std(axis=0), sum(float(a @ b) for a, b in zip(v, v[1:], strict=False)) / len(s), sum(i >= 2 and s[i] in (s[i - 1], s[i - 2]) for i in range(len(s))) / len(s), math.log1p(len(s))]
        assert np.allclose(row, want, atol=1e-3)


def test_look_alikes_and_parted_words(spark):
    """Accents, marks, invisible, wide and foreign letters, v twice, and a white space inside are seen through; two usual words are not joined."""
    docs, labels = labelled(spark)
    usual = [(1000 + i, "on the worth less er in th an es") for i in range(60)]
    docs = docs.union(spark.createDataFrame(usual, docs.schema))
    labels = labels.union(spark.createDataFrame([(i, 1, 0) for i, _ in usual], labels.schema))
    tox = toxicity.fit(docs, labels)
    forms = ["worthless", "wōrthless", "wórthless", "wоrthlеss", "ｗｏｒthless", "wor​thless", "wor­thless", "vvorthless", "wor thless", "w orthless", "wоrth1ess"]
    clean = ["worth less", "wor er thless", "thе оn", "savvy er", "́", "​"]
    rows = spark.createDataFrame([(i, f"the on er {f} in an es") for i, f in enumerate(forms + clean)], "doc_id long, text string")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(rows, tox).collect()}
    assert [f for i, f in enumerate(forms) if not got[i]] == []
    assert [f for i, f in enumerate(clean) if got[len(forms) + i]] == []
    assert toxicity.seen("straße".encode()) == b"" and toxicity.seen("но!".encode()) == b""
    assert len(toxicity.usual_words(docs.limit(0).select(F.col("text").alias("_text")))) == 0
