import math
import random

import numpy as np
import pytest

from foliomill.llm import bidiagonal, queries, whitening


def brute(rows, components=32, scale=64):
    """{(row, component): (n, deviation, whitened up to its sign, explained)} by eigenvectors of the covariance."""
    usable = [(at, i, v) for at, (i, v) in enumerate(rows)
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for dims in {len(v) for _, _, v in usable} - {0}:
        part = [r for r in usable if len(r[2]) == dims]
        x = [[math.floor(scale * c) + 1_000_000 for c in v] for _, _, v in part]
        n, sums = len(x), [sum(c) for c in zip(*x)]
        distance = [[n * c - s for c, s in zip(row, sums)] for row in x]
        y = np.array(distance, float) / n
        e, u = np.linalg.eigh(y.T @ y / n)
        e, u = e[::-1], u[:, ::-1]
        kept = int((e > 1e-13 * max(e[0], 1e-300)).sum()) if e[0] > 0 else 0
        for (_, i, _), d, row in zip(part, distance, y):
            for c in range(min(kept, components)):
                out.setdefault((i, c + 1), []).append(
                    (n, sum(v * v for v in d), abs(row @ u[:, c]) / math.sqrt(e[c]), e[c] / e.sum()))
    return out


def run(spark, rows, folder):
    df = spark.createDataFrame(
        [(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dims string, white int, _x int")
    df.write.parquet(f"{folder}/embeddings.parquet")
    out = {}
    for r in queries.QUERIES["op11_whitening"](spark, str(folder)).collect():
        out.setdefault((r.vec_id, r.component), []).append(
            (r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error <= 1e-10
    return out


def same(got, want, close=1e-7):
    assert got.keys() == want.keys()
    for key in want:
        for a, b in zip(sorted(got[key]), sorted(want[key]), strict=True):
            assert a[:2] == b[:2]
            assert a[2:] == pytest.approx(b[2:], abs=close, rel=close)


def spread(rng, n, dims):
    """Rows whose variances are far apart, so that components are told apart."""
    return [(i, [float(np.float32(rng.gauss(0, 3 * 1.4**-j))) for j in range(dims)]) for i in range(n)]


def test_agrees_with_eigenvectors(spark, tmp_path):
    rows = spread(random.Random(1), 300, 10)
    same(run(spark, rows, tmp_path), brute(rows))


def test_odd_rows_lengths_and_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 512)
    rng = random.Random(2)
    rows = spread(rng, 120, 5) + [(1000 + i, v) for i, v in spread(rng, 60, 3)]
    rows += rows[:40] + [(None, rows[3][1]), (5, rows[9][1])]
    rows += [(1, None), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [float("nan")] * 5), (4, [float("inf")] + [0.0] * 4),
             (6, []), (2000, [1.0, 2.0]), (2001, [1.0] * 7), (2002, [1.0] * 7)]
    same(run(spark, rows, tmp_path), brute(rows))


def test_more_components_than_asked_for(spark, tmp_path):
    rows = spread(random.Random(3), 400, 40)
    got = run(spark, rows, tmp_path)
    assert {c for _, c in got} == set(range(1, 33))
    assert sum(got[0, c][0][3] for c in range(1, 33)) < 1
    assert got[0, 1][0][1] == brute(rows)[0, 1][0][1]


def test_without_rows_or_spread(spark, tmp_path):
    assert run(spark, [], tmp_path / "empty") == {}
    assert run(spark, [(1, [1.0, 2.0])], tmp_path / "one") == {}
    assert run(spark, [(i, [1.0, 2.0]) for i in range(5)], tmp_path / "equal") == {}
    got = run(spark, [(i, [float(i), 2.0, 2.0 * i]) for i in range(9)], tmp_path / "line")
    assert {c for _, c in got} == {1} and got[0, 1][0][3] == pytest.approx(1)


def test_many_partitions_and_models(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "MODEL_BYTES", 300)
    rng = random.Random(4)
    rows = spread(rng, 200, 4) + spread(rng, 100, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)
    models = whitening.fit(df, components=4)
    assert len(whitening._batches(models)) == 2
    white = whitening.whiten(df, models)
    assert white.columns == ["vec_id", "embedding", "white"] and white.count() == 300
    assert max(whitening.identity_errors(white).values()) < 1e-10


def test_deviations_beyond_64_bits(spark):
    rows = [(0, [0.0, 0.0]), (1, [2.0**30, 0.0]), (2, [0.0, 2.0**20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.white.deviation) for r in whitening.whiten(df, whitening.fit(df)).collect()}
    x = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values())]
    assert got == {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    assert max(got.values()) > 2**63


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    got = queries.QUERIES["op11_whitening"](spark, folder).collect()
    assert len(got) == len(want) == 32 * len(rows)
    for r in got:
        n, deviation, value, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-10
        assert abs(r.whitened) == pytest.approx(value, abs=1e-6)
        assert r.explained == pytest.approx(explained, rel=1e-9)


@pytest.mark.parametrize("values", [
    [5.0] * 8 + [1.0] * 8, list(5 + 1e-9 * np.arange(16)), list(5 + 1e-13 * np.arange(16)),
    [5.0] * 3 + [2.0, 1.0] + [0.0] * 11, list(10.0 ** -np.linspace(0, 6, 16)), [1.0] * 16, [0.0] * 16])
def test_solver_on_close_and_zero_values(values):
    rng = np.random.default_rng(7)
    turn = [np.linalg.qr(rng.standard_normal((16, 16)))[0] for _ in range(2)]
    a = turn[0] @ np.diag(values) @ turn[1].T
    e, v = bidiagonal.right_vectors(a)
    rank = sum(x > 0 for x in values)
    assert v.shape[1] == rank
    assert np.sqrt(e[:rank]) == pytest.approx(sorted(values, reverse=True)[:rank], rel=1e-8)
    assert np.abs(v.T @ v - np.eye(rank)).max(initial=0) < 1e-11
    assert np.abs(a.T @ (a @ v) - v * e[:rank]).max(initial=0) < 1e-12 * 25


def test_solver_keeps_the_digits_of_small_values():
    rng = np.random.default_rng(8)
    q, e = 10.0 ** rng.uniform(-12, 0, 30), 10.0 ** rng.uniform(-14, -2, 29)
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    # The inverse has the same values the other way up: its largest are the smallest here, to all digits.
    assert bidiagonal.dqds(q, e)[-1] == pytest.approx(np.linalg.svd(np.linalg.inv(b), compute_uv=False)[0] ** -2, rel=1e-10)
    assert bidiagonal.dqds(q, e)[0] == pytest.approx(np.linalg.svd(b, compute_uv=False)[0] ** 2, rel=1e-12)
