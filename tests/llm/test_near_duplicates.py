import random

import pytest

from foliomill.llm import near_duplicates as nd
from foliomill.llm import queries
from foliomill.llm.components import components


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, shingle, percent):
    """(doc_id, n, component, kept) by comparing everything."""
    sets, parent = [], {}
    for doc_id, text in rows:
        w = words_of(text)
        size = min(shingle, len(w))
        sets.append((doc_id, {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()))

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by_shingle = {}
    for at, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(at)
    pairs = {}
    for list_ in by_shingle.values():
        for i, p in enumerate(list_):
            for q in list_[:i]:
                pairs[p, q] = pairs.get((p, q), 0) + 1
    for (p, q), common in pairs.items():
        (x, sx), (y, sy) = sets[p], sets[q]
        if x is not None and y is not None and 100 * common >= percent * (len(sx) + len(sy) - common):
            low, high = sorted((top(x), top(y)))
            parent[high] = low
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets), key=repr)


def run(spark, rows, shingle=3, percent=85):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, a string")
    return sorted(map(tuple, nd.near_duplicates(docs, shingle, percent).collect()), key=repr)


def copies(rng, base, n, share):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1 + int(share * len(w)))):
            at = rng.randrange(len(w))
            w[at] = rng.choice([f"n{rng.random()}", w[rng.randrange(len(w))]])
        out.append(" ".join(w))
    return out


def corpus(seed, families=((12, 120), (30, 60), (25, 300)), singles=30):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for n, size in families:
        texts += copies(rng, [f"w{rng.randrange(500)}" for _ in range(size)], n, 0.1)
    for _ in range(singles):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80))]
        texts += [" ".join(own + passage), " ".join(own)]
    texts += [texts[3]] * 5 + [texts[3].upper()] * 2
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("short, cell", [(64, 256), (4, 256), (2, 5)])
@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_agrees_with_brute_force(spark, monkeypatch, short, cell, shingle, percent):
    monkeypatch.setattr(nd, "SHORT", short)
    monkeypatch.setattr(nd, "CELL", cell)
    rows = corpus(short + cell)
    assert run(spark, rows, shingle, percent) == brute(rows, shingle, percent)


def template(pages, own=40):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(140)]
    return [(i, " ".join(common[:70] + [f"o{rng.random()}" for _ in range(own)] + common[70:])) for i in range(pages)]


def test_pages_of_one_template_need_no_cells(spark, monkeypatch):
    seen, cells = [], nd._cells
    monkeypatch.setattr(nd, "_cells", lambda members, percent: (seen.append(members.count()), cells(members, percent))[1])
    rows = template(400) + [(1000 + i, t + " end") for i, t in template(400)[:30]]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert seen == [0]


@pytest.mark.parametrize("short", [64, 3])
def test_groups_within_one_template(spark, monkeypatch, short):
    monkeypatch.setattr(nd, "SHORT", short)
    monkeypatch.setattr(nd, "CELL", 8)
    rng = random.Random(11)
    rows = []
    for i, text in template(30):
        rows += [(100 * i + j, t) for j, t in enumerate(copies(rng, text.split(), 12, 0.08))]
    assert run(spark, rows) == brute(rows, 3, 85)


@pytest.fixture
def families(monkeypatch):
    """Numbers of (hub, member) pairs that runs compare."""
    seen, verified = [], nd._verified
    monkeypatch.setattr(nd, "_verified", lambda pairs, *more: (
        seen.append(pairs.filter("family").count()), verified(pairs, *more))[1])
    return seen


def test_pages_with_much_of_their_own_have_few_families(spark, families):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(passage + [f"o{rng.random()}" for _ in range(5 if i < 100 else 200)])) for i in range(400)]
    rows += [(1000 + i, text + " end") for i, text in rows[90:110]]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert families[0] < len(rows)


def test_worn_copies_of_one_text_stand_in_one_family_each(spark, families):
    rng = random.Random(5)
    rows = list(enumerate(copies(rng, [f"w{i}" for i in range(150)], 400, 0.14)))
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)
    assert families[0] < len(rows)


def test_words_that_sums_of_powers_cannot_tell_apart(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([w, *"q r s t u v".split()])) for i, w in enumerate([one, two, one[:64], two[:64], one[:32], two[:32], one])]
    assert run(spark, rows, 3, 100) == brute(rows, 3, 100)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "É x"), (8, "é x"), (None, "a"), (None, None),
            (9, "q r s t"), (9, "q r s t"), (10, "u v w"), (10, "a b"), (11, "u v w"), (12, long), (13, long + " end"), (-5, "a"), (2**62 + 1, "z z")]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert run(spark, []) == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op3_near_duplicates"](spark, folder).collect()), key=repr)
    assert got == brute(rows, 3, 85)
