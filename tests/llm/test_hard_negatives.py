import math
import random

import duckdb
import numpy as np

from foliomill.llm import hard_negatives, queries


def brute(rows, every=100, positives=5, negatives=10, lowest=30, highest=90):
    usable = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows
                     if i is not None and label is not None and v is not None
                     and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, label, a in usable:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, other) for j, other, v in usable
                        if j != i and len(v) == len(a))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and lowest * -p <= 100 * -s[0] <= highest * -p][:negatives]
            out += [(i, j, rank, n, -p, -score) for rank, (score, n, _) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, **kwargs):
    df = spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, v string, block int, ids int")
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **kwargs).collect()))


def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES_A_BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_BLOCK", 9)


def test_agrees_with_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(250)]
    rows += rows[:20]
    rows += [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (305, 1, None), (310, 1, [1.0, None, 1.0, 1.0]),
             (315, 1, [float("nan")] * 4), (320, 1, [float("inf"), 0.0, 0.0, 0.0]), (325, 0, [1.0, 2.0]),
             (326, 0, [2.0, 2.0]), (327, 1, [1.0, 1.0]), (330, 1, []), (335, 2, []), (-5, 0, [1.0, 1.0, 0.0, 0.0])]
    got = run(spark, rows, every=5)
    assert got == brute(rows, every=5) and len(got) > 500


def test_continuous_vectors_in_clusters(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (4, 12))
    rows = [(i, int(rng.integers(4)), [float(x) for x in centres[i % 4] + rng.normal(0, 0.05, 12)]) for i in range(400)]
    got = run(spark, rows, every=10)
    assert got == brute(rows, every=10) and got


def test_a_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = random.Random(5)
    rows = [(i, i % 2, [0.5, 0.5, 0.25] if i % 3 == 0 else [rng.random(), rng.random(), rng.random()]) for i in range(300)]
    assert run(spark, rows, every=10) == brute(rows, every=10)


def test_ids_with_several_vectors_and_labels(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.randrange(3), [float(rng.randrange(-2, 3)) for _ in range(3)]) for _ in range(250)]
    got = run(spark, rows, every=4)
    assert got == brute(rows, every=4) and got


def test_large_whole_numbers_stay_exact(spark):
    rng = random.Random(7)
    rows = [(i, i % 2, [float(rng.randrange(2**21, 2**22)) for _ in range(3)]) for i in range(80)]
    assert run(spark, rows, every=5) == brute(rows, every=5)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [2.0]), (2, 0, [1.5])]) == [(0, 1, 1, 2, 131072, 98304)]
    assert run(spark, [(0, 1, [1.0]), (1, 1, [-2.0]), (2, 0, [-1.5])]) == []


def test_tree_is_least_and_bounds_leave_candidates_out():
    rng = np.random.default_rng(8)
    points = rng.integers(-50, 50, (60, 3))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order) == list(range(60))
    place = {int(at): i for i, at in enumerate(order)}
    assert all(parent[at] < 0 or place[int(parent[at])] < place[at] for at in place)
    nodes = np.concatenate([points, np.zeros((1, 3))])
    reached, total = {60}, 0.0
    away = np.linalg.norm(nodes[:, None] - nodes[None], axis=2)
    while len(reached) < 61:
        least = min((away[i, j], j) for i in reached for j in range(61) if j not in reached)
        total += least[0]
        reached.add(least[1])
    assert abs(edge.sum() - total) < 1e-9

    class Block(hard_negatives.Candidates):
        def __init__(self, v):
            self.ids, self.v, self.real = np.arange(len(v)), v, v.astype(float)
            self.norms = np.linalg.norm(self.real, axis=1)

    anchors = np.array([1000, 0]) + rng.integers(-3, 4, (50, 2))
    block = Block(rng.integers(-100, 101, (500, 2)))
    scored = 0
    for at, which, scores in hard_negatives.walk(
            anchors, *hard_negatives.spanning_tree(anchors), block, lambda at, low, high: high >= 90_000):
        exact = block.v @ anchors[at]
        assert set(np.flatnonzero(exact >= 90_000)) <= set(which) and (scores == exact[which]).all()
        scored += len(which)
    assert scored < 50 * 500 / 3


def test_query_agrees_with_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op12_hard_negatives"](spark, folder).collect()))
    assert got == brute(rows) and got
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM read_parquet('{folder}/embeddings.parquet')")
    assert sorted(duckdb.sql(queries.ORACLES["op12_hard_negatives"]).fetchall()) == got
    top = sorted(map(tuple, queries.QUERIES["op10_exact_topk"](spark, folder).collect()))
    assert sorted(duckdb.sql(queries.ORACLES["op10_exact_topk"]).fetchall()) == top


def test_blocks_of_candidates_do_not_pass_the_driver(spark):
    anchors = spark.createDataFrame(
        [(2, 3, i % 2, i, i, 1, [i, 1], []) for i in range(4)],
        "dims int, blocks long, anchor_block long, anchor_key long, vec_id long, label long, v array<long>, asked array<long>")
    file = spark.createDataFrame(
        [(2, i % 3, i, 1, [i, 1], [i]) for i in range(9)],
        "dims int, block long, class_id long, label long, v array<long>, ids array<long>")
    pairs = hard_negatives._pairs(anchors, file)
    told = sorted((np.frombuffer(r.anchor_keys, np.int64).tolist(), np.frombuffer(r.class_ids, np.int64).tolist()) for r in pairs.collect())
    assert [(a, sorted(c)) for a, c in told] == [([a, a + 2], [c, c + 3, c + 6]) for a in range(2) for c in range(3)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
