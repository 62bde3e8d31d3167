"""SentencePiece encoding by a table of distinct chunks.

In a vocabulary where no piece holds a whitespace marker behind another character, no merge can
cross from one marked word into the next. A text is then the sequence of its marked words, and it
is enough to segment each distinct one once:

1. texts are read in blocks of a bounded number of words; a block's table lists its distinct words,
   and each text becomes a sequence of places in that table,
2. every word of the table is segmented, once,
3. the table's ids are joined back to the texts by place.

The table is a block's, not the corpus's. Most distinct words are rare, so a table of the corpus
would send each of them through two shuffles to save segmenting few: it was built and measured, and
took three times the disk that the texts take (see README). A block needs no shuffle at all, its
memory is bounded, and a lost executor costs the blocks of its own tasks.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNKS = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")
BLOCK_WORDS = 300_000  # words of one block; a longer text is a block of its own


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def load(path: str) -> bytes:
    """The model file, checked for what the method needs; its bytes travel with the tasks."""
    with open(path, "rb") as file:
        model = file.read()
    pieces = processor(model)
    crossing = [p for p in map(pieces.id_to_piece, range(len(pieces))) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross whitespace markers, e.g. {crossing[0]!r}")
    for text in (" a  b\nÅﬁ　c ", "x", MARK):
        if pieces.normalize(text) != (MARK + text).replace(" ", MARK):
            raise ValueError("the model rewrites texts before it splits them")
    return model


def chunks(text: str | None) -> list[str]:
    """Marked words of a text, each without its first marker."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    if MARK * 2 in marked or marked[0] == MARK or marked[-1] == MARK:
        return CHUNKS.findall(MARK + marked)
    return marked.split(MARK)


def segment(pieces: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[list[int]]:
    """Ids of marked words given without their first marker, which the library adds itself."""
    ids = pieces.encode([word.replace(MARK, " ") for word in words], num_threads=1)
    return [found if word else [pieces.piece_to_id(MARK)] for word, found in zip(words, ids)]


class Table(dict):
    """Distinct words of a block with their places, which are given out as words come."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def joined(pieces: sentencepiece.SentencePieceProcessor, table: Table, places: list[np.ndarray]) -> list[np.ndarray]:
    """Ids of each text of a block: those of its words, put together by place, and the end id."""
    found = segment(pieces, list(table))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, starts[-1])
    out = []
    for text in places:
        lengths = sizes[text]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.empty(total + 1, np.int32)
        # Element n of the text is element n - (where its word begins) of the word's ids.
        ids[:total] = flat[np.arange(total) + np.repeat(starts[text] - (ends - lengths), lengths)]
        ids[total] = pieces.eos_id()
        out.append(ids)
    return out


def encode(docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text",
           decoded: str | None = None) -> DataFrame:
    """(``id_column``, ids): ids of every whole text as the library's encode() gives them, with the
    end id added. With ``decoded`` named, that column holds what decode() makes of the ids, worked
    out in the same task.

    A null text is an empty one: the end id alone. Null and repeated ids and repeated rows come back
    as they are; other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType
    # Ids go as text: pandas would make doubles of numbers that stand beside a null.
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = processor(model)

        def ready(names: pd.Series, table: Table, places: list[np.ndarray]) -> pd.DataFrame:
            out = pd.DataFrame({"id": names, "ids": joined(pieces, table, places)})
            return out.assign(decoded=[pieces.decode(ids.tolist()) for ids in out["ids"]]) if decoded else out

        for batch in batches:
            table, places, read, first = Table(), [], 0, 0
            for at, text in enumerate(batch["text"]):
                words = chunks(text)
                if read and read + len(words) > BLOCK_WORDS:
                    yield ready(batch["id"].iloc[first:at], table, places)
                    table, places, read, first = Table(), [], 0, at
                read += len(words)
                places.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
            yield ready(batch["id"].iloc[first:], table, places)

    encoded = rows.mapInPandas(blocks, "id string, ids array<int>" + (", decoded string" if decoded else "")).withColumn(
        "id", F.col("id").cast(kind))
    names = {"id": id_column} | ({"decoded": decoded} if decoded else {})
    return encoded.withColumnsRenamed(names)


def decode(model: bytes, ids: Column) -> Column:
    """Text of an id array, by the library's decode(). A null array gives null."""
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = processor(model)
        for arrays in batches:
            yield arrays.map(lambda ids: None if ids is None else pieces.decode(np.asarray(ids).tolist()))

    return F.pandas_udf(decoded, "string")(ids)
