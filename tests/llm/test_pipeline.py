import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from foliomill.sources import workspace
from tests.llm.test_near_duplicates import brute
from tests.llm.test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"
FUNCTIONS = dict(pipeline.STAGES)


def test_stages_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = workspace.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = before, [tuple(r) for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    before, after = seen["quality"]
    kept = {r[0] for r in after}
    assert set(after) <= set(before)
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)

    before, after = seen["near_dedup"]
    keep = {i for i, _, _, kept in brute([r[:2] for r in before], 5, 80) if kept}
    assert sorted(after) == sorted(r for r in before if r[0] in keep)

    before, after = seen["pii"]
    assert [r[0] for r in sorted(after)] == [r[0] for r in sorted(before)]
    assert not any(base_spans(r[1]) for r in after)
    assert all(r[4] == len(r[1]) for r in after)
    texts = dict(r[:2] for r in before)
    assert all(r[1] == texts[r[0]] for r in after if not base_spans(texts[r[0]]) and "<" not in r[1])

    before, after = seen["mixing"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += len((r[1] or "").split())
    for r in after:
        taken[r[3]] += len(r[1].split())
    assert set(after) <= set(before) and max(Counter(r[0] for r in after).values()) <= 3
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 0.1 * sum(sizes.values())

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = pipeline.tokens(spark, docs, SF).collect()
    assert len(rows) == len(after)
    texts = dict(r[:2] for r in after)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_eos=True)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a@b.cc alone here", "en", "s", 17),
       (3, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", None, 27),
       (4, "ONE two three four five six", "en", "s", 27), (5, "w " * 20_000, "xx", "s", 40_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_go_through(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        docs = workspace.written(stage(spark, docs, SF), name)
    assert docs.count() <= 3 * len(rows)


def test_dedup_of_odd_rows(spark):
    docs = workspace.written(spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", kept string, a int"), "odd")
    out = pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [1, 2, 3, 5, None]


def test_clean_rows_that_share_an_id_stay(spark):
    rng = __import__("random").Random(1)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2] + " end"), (2, texts[2] + " end"), (3, texts[1] + " more"),
            (4, texts[3]), (5, texts[4]), (6, texts[4] + " more"), (7, None), (7, ""), (7, texts[5]), (None, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame([(*r, "en", "s", 1, {"k": i}) for i, r in enumerate(rows)], SCHEMA + ", _key map<string, int>")
    out = pipeline.near_dedup(spark, workspace.written(docs, "clash"), SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    # Ids 1 and 2 stand at two texts each: 3 has one text and comes before them.
    two = {t for i, t in got if i == 2}
    assert len(two) == 1 and two <= {texts[2], texts[2] + " end"}
    del got[2, two.pop()]
    assert got == Counter({(1, texts[0]): 1, (3, texts[1] + " more"): 1, (4, texts[3]): 1, (5, texts[4]): 1, (7, None): 1, (7, ""): 1,
                           (7, texts[5]): 1, (None, texts[5]): 2})
