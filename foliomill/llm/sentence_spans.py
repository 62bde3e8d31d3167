"""Repeated passages by sliding spans of sentences.

Every run of several consecutive sentences that holds enough words is hashed: the shortest one from
each sentence and the shortest one up to each. Runs are counted over the corpus; sentences covered
by a run that stands elsewhere first are removed. The counting is a mergeable aggregate, so a run
that very many documents share is one row for each task, and the join back to its places is a plain
one that adaptive execution can split. A group is never more than one document's sentences.

A run is known by 128 bits of its words, a document by its id and 128 bits of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.sources import workspace

SPAN_WORDS = 25    # words of a run of two or more sentences
SINGLE_WORDS = 50  # words of a sentence that is a run alone
BOUNDARY = re.compile(r"(?<=[.!?])[ \t]+|\n+")


def pieces(text: str) -> list[str]:
    """Sentences and lines with the blanks behind them: joined, they are the text."""
    out, done = [], 0
    for match in BOUNDARY.finditer(text):
        out.append(text[done:match.end()])
        done = match.end()
    return out + [text[done:]] * (done < len(text))


def digest(words: bytes, seed: int) -> tuple[int, int]:
    """128 bits as two numbers."""
    both = xxhash.xxh3_128_digest(words, seed=seed)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def runs(parts: list[str], span_words: int = SPAN_WORDS, single_words: int = SINGLE_WORDS) -> list[tuple[int, int, int, int]]:
    """(hash, other hash, first, last) of every run, by sentence numbers; case and blanks make no difference."""
    words = [part.lower().split() for part in parts]
    at = [i for i, w in enumerate(words) if w]
    sizes = np.array([len(words[i]) for i in at], np.int64)
    hashes = [xxhash.xxh3_128_digest(" ".join(words[i])) for i in at]
    sums = np.concatenate(([0], np.cumsum(sizes)))
    n = len(at)
    if not n:
        return []
    starts = np.arange(n)
    # First end at which the words suffice and there are two sentences; last start likewise.
    ahead = np.maximum(np.searchsorted(sums, sums[:-1] + span_words) - 1, starts + 1)
    back = np.minimum(np.searchsorted(sums, sums[1:] - span_words, side="right") - 1, starts - 1)
    found = {(i, j) for i, j in zip(starts.tolist(), ahead.tolist()) if j < n}
    found |= {(i, j) for i, j in zip(back.tolist(), starts.tolist()) if i >= 0}
    found |= {(i, i) for i in np.flatnonzero(sizes >= single_words).tolist()}
    return [(*digest(b"".join(hashes[i:j + 1]), j - i), at[i], at[j]) for i, j in sorted(found)]


DOCUMENT = ["id", "t", "u"]


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, id, t, u): a document and its text by name; rows without an id come last."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumns({
        "id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
        "t": F.xxhash64("text"), "u": F.xxhash64(F.lit("text"), "text")})


def _spans(docs: DataFrame, span_words: int, single_words: int) -> DataFrame:
    """(id, t, u, runs) of documents."""
    def spanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), 500):
                part = batch.iloc[at:at + 500]
                found = [runs(pieces(text or ""), span_words, single_words) for text in part["text"]]
                yield pd.DataFrame({
                    **{name: part[name].to_numpy() for name in DOCUMENT},
                    **{name: [[r[k] for r in f] for f in found] for k, name in enumerate("hgij")}})

    return docs.mapInPandas(
        spanned, "id long, t long, u long, h array<long>, g array<long>, i array<int>, j array<int>")


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   span_words: int = SPAN_WORDS, single_words: int = SINGLE_WORDS) -> DataFrame:
    """(id, t, u, removed, firsts) of documents that repeat a run: the numbers of the sentences that it
    covers, and the ids of the documents where the runs stand first.

    First is the smallest id; within a document the first place. Rows without an id come last, in
    the order of a hash of their text; rows that repeat an id and text are one document.
    """
    spans = workspace.written(_spans(_named(docs, id_column, text_column).select(*DOCUMENT, "text"), span_words, single_words), "sentence-spans")
    each = spans.select(*DOCUMENT, F.explode(F.arrays_zip("h", "g", "i", "j")).alias("r")).select(
        *DOCUMENT, "r.h", "r.g", "r.i", "r.j")
    place = F.struct(*DOCUMENT, "i")
    counted = each.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Stored, so that the join has a shuffle of its own on either side and a hot run can be split.
    again = workspace.written(counted.filter("first <> last").select("h", "g", "first"), "repeated-runs")
    later = each.join(again, ["h", "g"]).filter(place != F.col("first"))
    covered = later.groupBy(*DOCUMENT).agg(
        F.collect_set(F.struct("i", "j")).alias("runs"), F.collect_set("first.id").alias("firsts"))
    numbers = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["j"]))))
    return covered.select(*DOCUMENT, F.array_sort(numbers).alias("removed"), F.array_sort("firsts").alias("firsts"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   span_words: int = SPAN_WORDS, single_words: int = SINGLE_WORDS) -> DataFrame:
    """Same rows with the text without its repeated sentences: (doc_id, n_sentences, n_removed,
    first_doc_ids, text).

    A run is two or more sentences of ``span_words`` words together, or one of ``single_words``.
    ``n_sentences`` counts sentences and lines. Null texts stay null and have none; empty texts,
    and texts too short for a run, stay as they are. Other columns are not read. Texts are compared
    whole, whatever their length.
    """
    found = repeated_spans(docs, id_column, text_column, span_words, single_words)
    rows = _named(docs, id_column, text_column)

    def kept(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, removed):
            parts = pieces(text or "")
            if gone is not None and len(gone):
                dropped = set(np.asarray(gone).tolist())
                text = "".join(part for at, part in enumerate(parts) if at not in dropped)
            out.append((len(parts), text))
        return pd.DataFrame(out, columns=["n", "text"])

    cleaned = F.pandas_udf(kept, "n int, text string")(F.col("text"), F.col("removed"))
    return rows.join(found, DOCUMENT, "left").select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.filter("firsts", lambda i: i < (1 << 63) - 1), F.array().cast("array<long>")).alias("first_doc_ids"),
        cleaned.alias("cleaned"),
    ).select("doc_id", F.col("cleaned.n").alias("n_sentences"), "n_removed", "first_doc_ids", "cleaned.text")
