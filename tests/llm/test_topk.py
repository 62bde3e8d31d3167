import math
import random

from foliomill.llm import queries, topk


def brute(rows, every, k):
    usable = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
                     if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, q in usable:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, first int")
    return sorted(map(tuple, topk.top_k(df, every, k).collect()))


def test_agrees_with_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS_A_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 300)]
    rows += [(300, None), (None, [1.0] * 4), (305, [1.0, None, 1.0, 1.0]), (310, [float("nan")] * 4),
             (315, [float("inf"), 0.0, 0.0, 0.0]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (325, []), (330, [1.0]),
             (0, rows[0][1]), (10**12, [3.0, 1.0, -1.0, 2.0])]
    assert run(spark, [(*r, "x", 1) for r in rows]) == brute(rows, 5, 5)


def test_continuous_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [float(int(rng.gauss(0, 0.2) * 1e4)) / 2**14 for _ in range(24)]) for i in range(400)]
    assert run(spark, [(*r, "x", 1) for r in rows], every=20) == brute(rows, 20, 5)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], "x", 1)]) == []
    assert run(spark, [(0, [1.0], "x", 1), (1, [2.0], "x", 1)]) == [(0, 1, 1, 131072)]


def test_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op10_exact_topk"](spark, folder).collect()))
    assert got == brute(rows, 50, 5)


def test_ids_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS_A_BLOCK", 40)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(i % 30, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(90)]
    # Large vectors of one id fill the first places of its own queries and of no others.
    rows += [(0, [8.0 + n, 8.0, 8.0, 8.0]) for n in range(7)] + [(7, [8.0, 8.0, 8.0, 8.0])]
    assert run(spark, [(*r, "x", 1) for r in rows]) == brute(rows, 5, 5)


def test_id_with_large_vectors_among_small_ones_has_neighbours(spark):
    rows = [(0, [100.0 + n, 100.0]) for n in range(7)] + [(i, [i / 256, 1 / 256]) for i in range(1, 40)]
    got = run(spark, [(*r, "x", 1) for r in rows], every=50)
    assert got == brute(rows, 50, 5) and len(got) == 35
