import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from foliomill.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """(doc_id, n_words, n_hit, spans, items) of every document, by comparing every window."""
    windows = set()
    for i, text in items:
        w = words(text)
        size = min(len(w), window)
        for at in range(len(w) - size + 1) if w else ():
            windows.add((tuple(w[at:at + size]), "" if i is None else str(i)))
    sizes, by_words = {len(w) for w, _ in windows}, {}
    for w, i in windows:
        by_words.setdefault(w, set()).add(i)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                ids = by_words.get(tuple(w[at:at + size]))
                if ids:
                    hit |= set(range(at, at + size))
                    found |= ids
        spans = [(b, next(e for e in range(b, len(w) + 1) if e not in hit)) for b in sorted(hit) if b - 1 not in hit]
        out.append((doc, len(w), len(hit), spans, ",".join(sorted(found))))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, _ids int"),
            spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, class string"))


def run(spark, docs, items, window=10):
    out = []
    found = decontamination.contamination(*frames(spark, docs, items), window)
    assert found.columns == ["doc_id", "text", "spans", "_ids", "benchmark"]
    for r in found.collect():
        b = r.benchmark
        assert b.n_items == len(b["items"].split(",")) if b.n_hit else b.n_items == 0
        assert b.items_sha256 == hashlib.sha256(b["items"].encode()).hexdigest() and (r.spans, r._ids) == ("x", 1)
        out.append((r.doc_id, b.n_words, b.n_hit, [tuple(s) for s in b.spans], b["items"]))
    return sorted(out, key=repr)


def texts(rng, n, vocabulary, most):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(most))) for _ in range(n)]


CASES = [None, "", " ., \n", "É é ÀB àb 日本語 ١٢ x_y\x7fz", "a" * 3, "\U0001F600 ok"]


@pytest.mark.parametrize("passes", [False, True])
@pytest.mark.parametrize("window", [3, 10])
def test_agrees_with_brute_force(spark, monkeypatch, passes, window):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    if passes:
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    rng = random.Random(window)
    few = ["a", "B", "c", "the", "É"]
    items = list(enumerate(texts(rng, 30, few, 40)))
    docs = list(enumerate(texts(rng, 60, few + ["zz"], 50)))
    for i in range(40):
        text = rng.choice(items)[1].split(" ")
        at = rng.randrange(len(text))
        docs.append((100 + i, " -- ".join(["Start", *text[at:at + rng.randrange(30)], "end"]).upper()))
    docs += [(200 + i, t) for i, t in enumerate(CASES)] + docs[:10] + [(None, docs[80][1]), (300, "a " * 300)]
    items += [(50 + i, t) for i, t in enumerate(CASES)] + items[:5] + [(None, items[0][1]), (0, "q r s"), (60, "a " * 90)]
    got = run(spark, docs, items, window)
    assert got == brute(docs, items, window)
    assert sum(r[2] > 0 for r in got) > 20


def test_without_items_or_documents(spark):
    docs = [(1, "one two"), (2, None)]
    assert run(spark, docs, []) == run(spark, docs, [(1, None), (2, "...")]) == brute(docs, [])
    assert run(spark, [], [(1, "one two")]) == []


def test_window_that_very_many_documents_and_items_share(spark):
    lead = "answer the question with one of these letters and nothing else"
    items = [(i, f"{lead} item{i} " + " ".join(f"w{i}x{j}" for j in range(9))) for i in range(400)]
    docs = [(i, f"{lead} and so on {i}") for i in range(600)] + [(1000 + i, t) for i, t in items[:50]]
    assert run(spark, docs, items) == brute(docs, items)


def test_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefgh") for _ in range(300_000))
    items = [(1, long[200_000:200_400]), (2, long[:60]), (3, "zebra " + long[5000:5100])]
    docs = [(1, long), (2, long + " x"), (3, "short")]
    got = run(spark, docs, items)
    assert [(r[0], r[2] > 100, r[4]) for r in got] == [(1, True, "1,2,3"), (2, True, "1,2,3"), (3, False, "")]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for high in (2, 3, 2**25):
        tokens = rng.integers(0, high, 400)
        tokens[50:150] = tokens[200:300]
        tokens[-1] = 0

        def suffix(at):
            return tokens[at:at + np.flatnonzero(tokens[at:] == 0)[0]].tolist()

        array = decontamination.suffix_array(tokens, 1000)
        assert sorted(array) == np.flatnonzero(tokens).tolist()
        read = [suffix(at) for at in array]
        assert read == sorted(read)


def test_longest_matches(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 60)
    rng = random.Random(5)
    items, docs = list(enumerate(texts(rng, 12, "abc", 30))), list(enumerate(texts(rng, 40, "abcd", 60)))
    docs += [(99, None), (98, "")]
    d, i = frames(spark, docs, items)
    classes = {r["class"]: r.words for r in decontamination.item_classes(i).collect()}
    said = {str(k): words(t) for k, t in docs}

    def longest(suffix):
        return max(next((n for n in range(min(len(suffix), len(w) - at) + 1) if n == min(len(suffix), len(w) - at) or
                         suffix[n] != w[at + n])) for w in said.values() for at in range(len(w) + 1))

    got = {(r["class"], r.start): r for r in decontamination.longest_matches(d, i, window=4).collect()}
    for name, w in classes.items():
        for at in range(len(w)):
            least = min(4, len(w))
            n = longest(w[at:])
            if len(w) - at >= least and n >= least:
                r = got.pop((name, at))
                assert r.words == n and said[r.doc][r["at"]:r["at"] + n] == w[at:at + n]
    assert not got


def test_decontaminate_keeps_clean_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, passage), (2, passage[4:]), (3, passage[8:]), (4, None), (5, "x " + passage.upper())]
    d, i = frames(spark, docs, [(7, passage)])
    kept = decontamination.decontaminate(d, i)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_decontamination"](spark, folder)
    rows = sorted(map(tuple, got.collect()))
    for table in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS FROM read_parquet('{folder}/{table}.parquet')")
    assert sorted(duckdb.sql(queries.ORACLES["op13_decontamination"]).fetchall()) == rows
    assert any(r[-1] for r in rows) and not all(r[-1] for r in rows)
