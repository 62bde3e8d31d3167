"""Mixing and quality rules against their SQL and against plain Python."""

import collections
import re

import duckdb
import pytest

from checks.compare import TABLES, rows_of
from foliomill.llm import mixing, quality_rules, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = db.execute(queries.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        [d[0] for d in result.description], result.fetchall())


def measured(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x#*$ %&|<> y", "é\n\né\n é\n \nb\x0bc",
         "   x", "one two three " * 400, "w " * 60_000, "l\n" * 500, "The END " * 30 + "\U0001F600"]


def test_measurements(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", "y", 2), (3, "a", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed string, n_words int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measure(docs).collect()]
    assert sorted(got, key=repr) == sorted([(i, *measured(t)) for i, t, *_ in rows], key=repr)
    assert quality_rules.measure(docs.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    entries = quality_rules.ledger(quality_rules.measure(
        spark.read.parquet(f"{SF}/documents.parquet"))).cache()
    rows = entries.collect()
    one = {r.doc_id for r in quality_rules.apply_policy(entries, 1).filter("kept").collect()}
    assert one == {r.doc_id for r in rows if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words}
    for r in quality_rules.ablation(entries).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.failing == sum(bool(x.failed & bit) for x in rows) and r.only == sum(x.failed == bit for x in rows)


def test_targets_fill_up(spark):
    def fill(sizes):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        return {r.source: r.target for r in mixing.targets(df).collect()}
    # Weights a 1, b 2, c 3, null 1: b stops at 30, c at 3, and a and null share the rest.
    got = fill({"a": 1000, "b": 10, "c": 1, None: 500})
    assert got["b"] == 30 and got["c"] == 3 and got["a"] == got[None] == (1511 - 33) / 2
    assert fill({"a": 0, "b": 0}) == {"a": 0, "b": 0}
    assert fill({"a": 10, "b": 10, "c": 10, "d": 10}) == {"a": 40 / 7, "b": 80 / 7, "c": 120 / 7, "d": 40 / 7}
    assert fill({}) == {}


def test_taken_words_meet_the_targets(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 4}" if i % 7 else None, "x", 0.5) for i in range(400)]
    rows += [(None, "a b", "s1", "x", 0.5), (1, "w " * 9, "s1", "x", 0.5), (1, "w " * 9, "s1", "x", 0.5), (5, None, "s9", "x", 0.1),
             (6, "v " * 40_000, "s2", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string, start double")
    mix = mixing.mix(docs)
    out = mix.collect()
    assert len(out) == len(rows) and sorted(map(tuple, mix.collect()), key=repr) == sorted(map(tuple, out), key=repr)
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in out)
    positions = [r.position for r in mixing.curriculum(mix).collect()]
    assert positions == sorted(positions, key=lambda p: -1 if p is None else p)
    assert all(p is None or 0 <= p <= 1 for p in positions)
    again = mixing.copies(docs)
    assert again.columns == docs.columns and mixing.copies(docs.limit(0)).count() == 0
    assert max(collections.Counter(r.doc_id for r in again.collect() if r.doc_id not in (1, None)).values()) <= 3


def test_schedules_invert(spark):
    for weight, tilt in zip((1, 2, 3), mixing.TILTS):
        rows = spark.range(11).selectExpr("id / 10.0D AS u").select("u", mixing.due(mixing.F.col("u"), mixing.F.lit(weight)).alias("t"))
        for r in rows.collect():
            assert abs((1 - tilt) * r.t + tilt * r.t ** 2 - r.u) < 1e-12


@pytest.mark.parametrize("hot", [2_000_000, 20])
def test_an_id_that_half_of_the_rows_share(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "HOT", hot)
    rows = [(None if i % 2 else i, "w " * (i % 7), "ab"[i % 5 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source in "ab":
        mine = sorted((r.start, r.size) for r in got if r.source == source)
        total = 0
        for start, size in sorted(mine, key=lambda r: (r[0], r[1] > 0)):
            assert start == total or size == 0
            total += size
        assert total == sum(i % 7 for i, (_, _, s) in enumerate(rows) if s == source)
        assert sum(r.taken for r in got if r.source == source) == next(r.want for r in got if r.source == source)
    again = mixing.mix(docs.orderBy("text", "source")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
