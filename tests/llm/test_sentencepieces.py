import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import queries, sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b  ", "▁", "▁▁x ▁", "a▁ b", "\n\n a\tb\r\n", "\u0000x",
       "日本語 テスト", "é é ﬁ 　", "\U0001F600 \U0001F600\U0001F600", "</s> <s> <unk> <0x41>", "x" * 3000, "the " * 3000]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(" ▁ab\n<0x41>é", max_size=40)))
def test_chunks_segment_like_the_library(text):
    ids = [i for found in sp.segment(LIBRARY, sp.chunks(text)) for i in found]
    assert ids == LIBRARY.encode(text)


@pytest.mark.parametrize("words", [5, 1_000_000])
def test_encode_and_decode_whole_texts(spark, monkeypatch, words):
    monkeypatch.setattr(sp, "BLOCK_WORDS", words)
    model = sp.load(PATH)
    rows = [(i, text, i, "w") for i, text in enumerate(ODD)] + [(None, None, 1, "w"), (2**62 + 1, "z", 1, "w"), (3, "a", 1, "w"), (3, "a", 1, "w"), (None, "b c", 0, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, word string")
    encoded = sp.encode(docs, model)
    out = encoded.withColumn("text", sp.decode(model, encoded["ids"])).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "", add_eos=True)
        expected.append((doc_id, ids, LIBRARY.decode(ids)))
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(docs, sp.load(PATH)).count() == 0


def test_query_agrees_with_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_sentencepieces"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row.doc_id] or "", add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
