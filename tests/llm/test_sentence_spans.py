import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import queries
from foliomill.llm import sentence_spans as ss


def brute(rows):
    """Removed sentence numbers and first documents of each row, from the words themselves."""
    places = {}
    documents = sorted({(i is None, i, t or "") for i, t in rows}, key=lambda d: (d[0], d[1] or 0))
    order = {}
    for missing, i, t in documents:
        order[i, t] = len(order)
    spans = {}
    for (i, t), at in order.items():
        words = [p.lower().split() for p in ss.pieces(t)]
        full = [k for k, w in enumerate(words) if w]
        chosen = set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                n = sum(len(words[k]) for k in full[a:b + 1])
                inner = [sum(len(words[k]) for k in full[x:y + 1]) >= ss.SPAN_WORDS and y > x for x, y in ((a, b - 1), (a + 1, b))]
                if (a == b and n >= ss.SINGLE_WORDS) or (b > a and n >= ss.SPAN_WORDS and not all(inner)):
                    chosen.add((full[a], full[b], tuple(" ".join(words[k]) for k in full[a:b + 1])))
        spans[i, t] = chosen
        for a, b, text in chosen:
            places.setdefault(text, []).append((at, a, i))
    out = {}
    for (i, t), at in order.items():
        removed, firsts = set(), set()
        for a, b, text in spans[i, t]:
            first = min(places[text], key=lambda p: p[:2])
            if (at, a) != first[:2]:
                removed |= set(range(a, b + 1))
                firsts.add(first[2])
        out[i, t] = removed, firsts - {None}
    return out


def corpus(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 30))) + rng.choice([". ", "! ", ".\n", "\n"])
    passage = "".join(sentence() for _ in range(6))
    rows = []
    for i in range(40):
        own = [sentence() for _ in range(rng.randrange(0, 12))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), passage)
        rows.append((i * 7 % 41, "".join(own)))
    long = "one " * 60 + "end. "
    return rows + [(100, long + "tail."), (101, "head. " + long.upper()), (102, passage + passage), (None, passage), (None, None), (103, None),
                   (104, ""), (7, rows[1][1]), (rows[3][0], rows[3][1])]


def test_agrees_with_brute_force(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_removed int, t string")
    expected = brute(rows)
    out = ss.remove_repeats(docs).collect()
    assert len(out) == len(rows)
    got = sorted(((r.doc_id, r.n_sentences, r.n_removed, tuple(r.first_doc_ids), r.text) for r in out), key=repr)
    wanted = []
    for i, t in rows:
        removed, firsts = expected[i, t or ""]
        parts = ss.pieces(t or "")
        text = None if t is None else "".join(p for k, p in enumerate(parts) if k not in removed)
        wanted.append((i, len(parts), len(removed), tuple(sorted(firsts)), text))
    assert got == sorted(wanted, key=repr)
    assert ss.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("half", [0, 1])
def test_runs_that_agree_in_half_of_their_digest(spark, monkeypatch, half):
    whole = ss.digest
    monkeypatch.setattr(ss, "digest", lambda words, seed: tuple(
        7 if at == half else value for at, value in enumerate(whole(words, seed))))
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    got = sorted(((r.doc_id, r.n_removed) for r in ss.remove_repeats(docs).collect()), key=repr)
    assert got == sorted(((i, len(expected[i, t or ""][0])) for i, t in rows), key=repr)


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + "." for _ in range(8000))
    docs = spark.createDataFrame([(1, long), (2, "Head of it. " + long + " Tail of it."), (3, "short.")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in ss.remove_repeats(docs).collect()}
    assert got == {1: (0, long), 2: (8000, "Head of it. Tail of it."), 3: (0, "short.")}


def test_sizes_of_runs_are_parameters(spark):
    docs = spark.createDataFrame([(1, "one two. three four."), (2, "x. one two. three four. y.")], "doc_id long, text string")
    assert {r.n_removed for r in ss.remove_repeats(docs).collect()} == {0}
    got = {r.doc_id: r.text for r in ss.remove_repeats(docs, span_words=4).collect()}
    assert got == {1: "one two. three four.", 2: "x. y."}


@settings(max_examples=300, deadline=None)
@given(st.text(" ab.!?\n\t", max_size=60))
def test_pieces_are_the_text(text):
    assert "".join(ss.pieces(text)) == text and all(ss.pieces(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_runs_cover_every_passage_of_fifty_words(sizes):
    parts = [" ".join(f"a{i}x{k}" for k in range(n)) + ". " for i, n in enumerate(sizes)]
    covered = {k for _, _, i, j in ss.runs(parts) for k in range(i, j + 1)}
    if sum(sizes) > 50:
        assert covered == set(range(len(sizes)))


def test_query_keeps_the_words_of_the_corpus(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    expected = brute(list(texts.items()))
    rows = queries.QUERIES["op6_sentence_spans"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        removed, firsts = expected[r.doc_id, texts[r.doc_id]]
        assert (r.n_removed, r.first_doc_ids) == (len(removed), sorted(firsts))
