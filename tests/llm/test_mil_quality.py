import random
import zlib

import numpy as np
import pytest

from foliomill.llm import mil_quality as mil
from foliomill.llm import queries, words


def test_word_hashes_tell_words_apart():
    text = "The  a\tb the\nThe é a a\0 a\0\0 " + " ".join(c * n for c in "xy" for n in (*range(1, 70), 9000, 9001))
    text += " " + " ".join("x" * i + "y" + "x" * (16 - i) for i in range(17))
    hashed, plain = words.word_hashes(text), text.encode().split()
    assert len(hashed) == len(plain)
    assert [[a == b for b in hashed] for a in hashed] == [[a == b for b in plain] for a in plain]
    assert words.word_hashes("ÀBc", lower=True) == words.word_hashes("Àbc", lower=False)
    assert len(words.word_hashes(None)) == len(words.word_hashes(" \n")) == 0


def test_shingles():
    def distinct(text, size):
        return len(words.shingles(words.word_hashes(text), size))
    assert [distinct(t, 3) for t in ("", "a", "a b", "a b c", "a a a a", "a b c a b c")] == [0, 1, 1, 1, 1, 3]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = mil.Model(3)
    x, first = rng.normal(size=(9, mil.FEATURES)), np.array([0, 2, 3])
    buckets = np.concatenate([[0], rng.integers(0, mil.WORD_BUCKETS, 30), [mil.WORD_BUCKETS // 2, mil.WORD_BUCKETS - 1]])
    docs = mil.Bag(x, buckets, np.array([0, 1, 5, 9, 10, 14, 20, 25, 29]))
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.forward(docs, first)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    for name, grad in model.gradients(docs, first, y, weight).items():
        flat = model.weights[name].reshape(-1)
        for at in (0, len(flat) // 2, len(flat) - 1):
            kept, step = flat[at], 1e-5
            flat[at] = kept + step
            up = loss()
            flat[at] = kept - step
            down = loss()
            flat[at] = kept
            assert np.isclose((up - down) / (2 * step), grad.reshape(-1)[at], atol=1e-7), name


def test_attention_shares_add_up_and_long_texts_are_read_whole():
    text = "word " * 5000 + "BAD!! " * 64
    bag = mil.encode(text)
    assert len(bag.x) == len(bag.first) == -(-5064 // 64) and len(bag.buckets) == 2 * 5064
    assert not np.allclose(bag.x[-1], bag.x[0])
    assert np.isclose(mil.Model().forward(bag, np.array([0]))["share"].sum(), 1)


def plain_score(model, text):
    """The score of a text word by word and passage by passage."""
    bag = mil.encode(text)
    w, ends = model.weights, list(bag.first[1:]) + [len(bag.buckets)]
    codes, weights = [], []
    for x, start, end in zip(bag.x, bag.first, ends):
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        e = sum(w["E"][b] for b in bag.buckets[start:end]) / (end - start) ** 0.5
        h = np.tanh(x @ w["W"] + e + w["b"])
        codes.append(h)
        weights.append(np.exp((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["G"])))) @ w["u"]))
    z = sum(a * h for a, h in zip(weights, codes)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ w["c"] + w["d"][0])))


def test_scores_are_those_of_a_plain_second_scorer(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = mil.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r.score for r in queries.QUERIES["op2_mil_quality"](spark, folder).collect()}
    assert got == pytest.approx({r.doc_id: plain_score(model, r.text) for r in docs.collect()}, abs=1e-5)


def test_classes_that_differ_only_by_words(spark):
    rng = random.Random(4)
    common = [f"word{i}" for i in range(300)]
    kinds = ["red blue green teal".split(), "cat dogs mouse bird".split()]

    def text(y):
        return " ".join(rng.choice(kinds[y]) if rng.random() < 0.1 else rng.choice(common) for _ in range(150))

    rows = [(i, text(i % 2)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mil.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int"))
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    scores = model.scores([mil.encode(t) for _, t in held])
    assert sum((s >= 0.5) == (i % 2) for s, (i, _) in zip(scores, held)) >= 0.9 * len(held)


def test_long_documents_are_fitted_whole(spark, monkeypatch):
    monkeypatch.setattr(mil, "SAMPLE_PASSAGES", 20)
    long = "word " * 64 * 50
    rows = [(i, long if i < 6 else "a b c") for i in range(40)] + [(2, "another text"), (2, long)]
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taken = {r.label_id: r for r in mil.sample(docs, labels).collect()}
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    sizes = {i: len(mil.unpacked(r.x, r.buckets, r.first).x) for i, r in taken.items()}
    assert all(n == (1 if i >= 6 or i == 2 and n == 1 else 50) for i, n in sizes.items())
    assert 1 <= sum(i < 6 for i in taken) <= 2 and sum(i >= 6 for i in taken) == min(20, sum(i >= 6 for i in free))
    for y, ids in ((1, [i for i in free if i < 6]), (0, [i for i in free if i >= 6])):
        assert sum(r.weight for i, r in taken.items() if r.y == y) == pytest.approx(len(ids))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc the of and".split()) for _ in range(80)) if i % 2
             else " ".join(f"X{i}###" for _ in range(80)), i, "s") for i in range(60)]
    rows += [(None, "a b", 1, "s"), (100, None, 0, "s"), (101, "", 1, "s"), (102, "w " * 50_000, 1, "s"), (1, rows[1][1], 1, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, y string")


def test_odd_rows_are_scored(spark, odd):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(60)] + [(None, 1), (100, 0), (5, 1), (7, 0), (9, None), (999, 1)],
        "doc_id long, quality int")
    model = mil.fit(odd, labels)
    rows = odd.select("doc_id", "score", mil.score(model, odd["text"]).alias("s")).collect()
    assert len(rows) == odd.count() and all(0 <= r.s <= 1 for r in rows)
    assert all((r.s >= 0.5) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 60)
    again = mil.fit(odd, labels)
    assert all(np.array_equal(again.weights[k], model.weights[k]) for k in model.weights)


def test_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = mil.fit(odd, labels)
    assert odd.limit(0).select(mil.score(model, odd["text"])).count() == 0
    assert all(0 <= r[0] <= 1 for r in odd.select(mil.score(model, odd["text"])).collect())


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_mil_quality"](spark, folder).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in tested) >= 0.95 * len(tested)
