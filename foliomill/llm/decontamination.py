"""Benchmark passages in documents, by suffix arrays over the documents.

The words of a shard of documents are numbered by the benchmark's vocabulary, exactly, with 0 for any
other word and between documents: no match can hold one. The shard's suffixes that begin with a known
word are sorted into a suffix array (prefix doubling on the ranks that are still tied). Every suffix of
the benchmark is then searched in it, all at once and word by word: two binary searches narrow the range
of suffixes that agree so far, until it is empty. That gives each suffix's longest verbatim match and
where it is, and on the way the range that agrees with a whole window. A shard lives in one task; documents
are not shuffled.

The benchmark is dealt into blocks of at most about a million words, equal items in one. Nearly always that
is one block, which travels with the tasks: one scan, no shuffle. A larger benchmark takes a scan for each
block, whose hits are joined by the digest of the text. Windows with the same items are one group, and each
set of groups is spelt out once a task, so a passage that very many documents and items share is not paired.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.sources import workspace

WINDOW = 10
BLOCK_WORDS = 1_000_000  # of the benchmark, about
BLOCK_IDS = 1_000_000  # item ids that travel with the tasks
PIECE_WORDS = 100_000  # longer items are searched in overlapping pieces
SHARD_WORDS = 1_000_000  # of documents; a longer document is a shard of its own
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of words as they are, A-Z as a-z, all others as blanks. In UTF-8 all bytes of other letters are above 127.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# -- the benchmark --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """A block of the benchmark: item pieces as numbered words, and their windows."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray  # pieces one after another, -1 behind each
    run: np.ndarray  # words from a place to the end of its piece
    piece: np.ndarray  # the piece of each place
    size: np.ndarray  # words of the window that begins at a place, 0 where none does
    group: np.ndarray  # the group of the window at each place: windows with the same items
    classes: list[str]  # the item class of each piece
    starts: np.ndarray  # where a piece begins in its item
    members: list[list[str]]  # the item classes of each group
    ids: dict[str, list[str]]  # the item ids of each class, if there is but one block


def item_classes(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(class, words, ids): each distinct sequence of words with the items that have it.

    Items without a word are in none. A null id is kept as an empty one; an id with several texts is in
    the class of each.
    """
    found = F.regexp_extract_all(F.translate(F.col(text_column), UPPER, LOWER), F.lit(WORDS), F.lit(0))
    split = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), found.alias("words"))
    return split.filter(F.size("words") > 0).withColumn("class", F.sha2(F.array_join("words", " "), 256)).groupBy(
        "class").agg(F.first("words").alias("words"), F.sort_array(F.collect_set("id")).alias("ids"))


def _pieces(classes: DataFrame, window: int) -> DataFrame:
    """(class, start, words): long items cut so that each window is whole in one piece."""
    step = PIECE_WORDS
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    return classes.select("class", "words", F.explode(starts).alias("start")).select(
        "class", "start", F.slice("words", F.col("start") + 1, step + window - 1).alias("words"))


def _packed(rows: list, window: int) -> Block:
    """Pieces as one array of numbers, and which items share which windows."""
    vocabulary: dict[bytes, int] = {}
    numbered = [[vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in r.words] for r in rows]
    length = np.array([len(n) for n in numbered], np.int64)
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    tokens = np.full(int((length + 1).sum()), -1, np.int64)
    for at, n in zip(begin, numbered):
        tokens[at:at + len(n)] = n
    piece = np.repeat(np.arange(len(rows)), length + 1)
    run = np.repeat(begin + length, length + 1) - np.arange(len(tokens))
    size = np.where(run >= np.minimum(length, window)[piece], np.minimum(length, window)[piece], 0)
    at = np.flatnonzero(size)
    # Equal windows, padded, have equal rows; each is known by the classes of the pieces it is in.
    padded = np.concatenate([tokens, np.full(window, -1)])
    spread = np.where(np.arange(window) < size[at, None], padded[at[:, None] + np.arange(window)], -1)
    window_of = np.unique(spread, axis=0, return_inverse=True)[1].reshape(-1)
    names = [r["class"] for r in rows]
    number = {name: i for i, name in enumerate(sorted(set(names)))}
    pairs = np.unique(np.stack([window_of, np.array([number[n] for n in names])[piece[at]]]), axis=1)
    cuts = np.flatnonzero(np.diff(pairs[0])) + 1
    groups: dict[bytes, int] = {}
    members, group_of = [], []
    ordered = sorted(number)
    for classes in np.split(pairs[1], cuts):
        key = classes.tobytes()
        if key not in groups:
            groups[key] = len(members)
            members.append([ordered[c] for c in classes])
        group_of.append(groups[key])
    group = np.full(len(tokens), -1, np.int64)
    group[at] = np.array(group_of, np.int64)[window_of]
    return Block(
        vocabulary, tokens, run, piece, size, group, names, np.array([r.start for r in rows], np.int64), members, {})


def blocks(classes: DataFrame, window: int) -> tuple[int, Iterator[Block]]:
    """(number, blocks): the benchmark in blocks of bounded size, read one at a time."""
    total = classes.agg(F.sum(F.size("words")).alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    number = max(math.ceil((total.n or 0) / BLOCK_WORDS), math.ceil((total.ids or 0) / BLOCK_IDS))
    dealt = _pieces(classes, window).withColumn("block", F.pmod(F.xxhash64("class"), F.lit(max(1, number))))

    def read() -> Iterator[Block]:
        for at in range(number):
            rows = dealt.filter(F.col("block") == at).orderBy("class", "start").collect()
            if rows:
                yield _packed(rows, window)

    return number, read()


# -- a shard of documents -------------------------------------------------------------------------


def numbered(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words as numbers, 0 for unknown ones and behind each text; where each text begins, and the end)."""
    known, numbers, starts = vocabulary.get, [], [0]
    for text in texts:
        found = words(text)
        part = np.zeros(len(found) + 1, np.int64)
        part[:-1] = [known(w, 0) for w in found]
        numbers.append(part)
        starts.append(starts[-1] + len(part))
    return np.concatenate(numbers), np.array(starts, np.int64)


def suffix_array(tokens: np.ndarray, longest: int) -> np.ndarray:
    """Places of known words, in the order of the words from there to the next unknown one.

    Ties beyond ``longest`` words are left in any order.
    """
    n = len(tokens)
    places = np.flatnonzero(tokens)
    if not len(places):
        return places
    stops = np.flatnonzero(np.append(tokens, 0) == 0)
    run = stops[np.searchsorted(stops, places)] - places  # known words from each place
    next_two = np.concatenate([tokens, [0, 0]])
    bits = int(tokens.max()).bit_length()
    first, second = tokens[places], next_two[places + 1]
    width = 3 if 3 * bits <= 62 else 2
    key = (first << bits) | second
    if width == 3:
        key = (key << bits) | np.where(second > 0, next_two[places + 2], 0)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)

    def settle(at: np.ndarray, sorted_places: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
        """Ranks the places by their first position of equal keys; which of them are still tied."""
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank[sorted_places] = at[head] + 1
        return ~(new & np.append(new[1:], True))

    array, run = places[order], run[order]
    tied = settle(np.arange(len(array)), array, key[order])
    depth = width
    open_at = np.flatnonzero(tied & (run >= depth))
    while len(open_at) and depth < longest:
        part = array[open_at]
        key = rank[part] * (n + 2) + rank[part + depth]
        order = np.argsort(key, kind="stable")
        array[open_at], run[open_at] = part[order], run[open_at][order]
        tied = settle(open_at, part[order], key[order])
        depth *= 2
        open_at = open_at[tied & (run[open_at] >= depth)]
    return array


@dataclass
class Found:
    """What the search of all benchmark suffixes in a shard gave."""

    array: np.ndarray
    longest: np.ndarray  # words of the longest match of each benchmark place
    at: np.ndarray  # a place of that match in the shard, the first in the suffix array
    low: np.ndarray  # of the range of suffixes that agree with the whole window
    high: np.ndarray


def search(tokens: np.ndarray, block: Block) -> Found:
    """Binary searches of every benchmark suffix, a word deeper each time, while any suffix agrees."""
    array = suffix_array(tokens, int(block.run.max(initial=0)))
    longest, at = np.zeros(len(block.tokens), np.int64), np.zeros(len(block.tokens), np.int64)
    low, high = longest.copy(), longest.copy()
    padded = np.concatenate([tokens, np.zeros(int(block.run.max(initial=0)) + 1, np.int64)])
    asked = np.flatnonzero(block.tokens > 0)
    firsts = padded[array]
    start = np.searchsorted(firsts, block.tokens[asked], "left")
    end = np.searchsorted(firsts, block.tokens[asked], "right")
    depth = 1
    while True:
        left = end > start
        asked, start, end = asked[left], start[left], end[left]
        if not len(asked):
            return Found(array, longest, at, low, high)
        longest[asked], at[asked] = depth, array[start]
        whole = block.size[asked] == depth
        low[asked[whole]], high[asked[whole]] = start[whole], end[whole]
        more = block.run[asked] > depth
        asked, start, end = asked[more], start[more], end[more]
        word = block.tokens[asked + depth]
        start, end = (_bisect(padded, array, depth, word, start, end, right) for right in (False, True))
        depth += 1


def _bisect(tokens, array, depth, word, low, high, right: bool) -> np.ndarray:
    """The first place in each range whose word at ``depth`` is not below (``right``: above) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        there = tokens[array[middle] + depth]
        # A suffix that ended before this word holds a 0 there, below every word.
        below = there <= word[open_] if right else there < word[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def _hits(found: Found, block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each word is in an occurrence of a window; places and groups of the occurrences)."""
    windows = np.flatnonzero(found.high > found.low)
    # Equal windows have the same range: one of them stands for all.
    windows = windows[np.unique(found.low[windows] * (WIDEST + 1) + np.minimum(block.size[windows], WIDEST),
                                return_index=True)[1]] if len(windows) else windows
    counts = found.high[windows] - found.low[windows]
    which = np.repeat(np.arange(len(windows)), counts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = found.array[found.low[windows][which] + offset]
    edges = np.bincount(places, minlength=length + 1)
    edges = edges - np.bincount(places + block.size[windows][which], minlength=length + 1)
    return np.cumsum(edges)[:length] > 0, places, block.group[windows][which]


WIDEST = 1 << 20
SPANS = "array<struct<start: int, end: int>>"
FOUND = f"struct<n_words: bigint, n_hit: bigint, spans: {SPANS}, n_items: bigint, items: string, items_sha256: string>"
HITS = f"struct<n_hit: bigint, spans: {SPANS}, classes: array<string>>"


def _shards(texts: list, vocabulary: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Consecutive texts, numbered, in shards of bounded size."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        more = len(text or "") // 4 + 1
        if at > start and size + more > SHARD_WORDS:
            yield numbered(texts[start:at], vocabulary)
            start, size = at, 0
        size += more
    if start < len(texts):
        yield numbered(texts[start:], vocabulary)


def _scanned(texts: list, block: Block) -> Iterator[tuple[int, int, list[dict], np.ndarray]]:
    """Of each text: its words, how many are hit, the hit spans, and the groups of the windows that hit."""
    for tokens, starts in _shards(texts, block.vocabulary):
        hit, places, group = _hits(search(tokens, block), block, len(tokens))
        number, many = len(starts) - 1, len(block.members) + 1
        # The word behind a text is never hit, so spans end with their text.
        edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        doc, of_doc = np.divmod(np.unique((np.searchsorted(starts, places, "right") - 1) * many + group), many)
        first_span = np.searchsorted(begins, starts)
        first_group = np.searchsorted(doc, np.arange(number + 1))
        for at in range(number):
            own = slice(first_span[at], first_span[at + 1])
            b, e = begins[own] - starts[at], ends[own] - starts[at]
            yield (int(starts[at + 1] - starts[at] - 1), int((e - b).sum()),
                   [{"start": int(x), "end": int(y)} for x, y in zip(b, e)],
                   of_doc[first_group[at]:first_group[at + 1]])


def _contaminated(block: Block, listed: bool):
    """What one block, the whole benchmark, says of each text."""
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        told: dict[bytes, tuple] = {}

        def items(groups: np.ndarray) -> tuple:
            key = groups.tobytes()
            if key not in told:
                if len(told) > 1000:
                    told.clear()
                classes = {c for g in groups for c in block.members[g]}
                ids = sorted({i for c in classes for i in block.ids[c]})
                joined = ",".join(ids)
                told[key] = len(ids), joined if listed else None, hashlib.sha256(joined.encode()).hexdigest()
            return told[key]

        for texts in batches:
            rows = [(n, h, spans, *items(groups)) for n, h, spans, groups in _scanned(texts.tolist(), block)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "n_items", "items", "items_sha256"])
    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return scan


def _hit_by(block: Block):
    """What one block of several says of each text: hit spans and item classes."""
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([
                (h, spans, sorted({c for g in groups for c in block.members[g]}))
                for _, h, spans, groups in _scanned(texts.tolist(), block)], columns=["n_hit", "spans", "classes"])
    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return scan


NONE = np.zeros(0, np.int64)
EMPTY = Block({}, NONE, NONE, NONE, NONE, NONE, [], NONE, [], {})


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_column: str = "text",
                  id_column: str = "item_id", into: str = "benchmark", listed: bool = True) -> DataFrame:
    """The documents, all columns kept, with ``into``: what of the items stands in them verbatim.

    A struct of n_words, n_hit (words inside an occurrence of a window), spans (array of start and end,
    counted in words), n_items, items (those ids sorted as strings, comma-joined; null unless ``listed``) and
    items_sha256 of that. Words are runs of letters a-z, digits and characters beyond ASCII, A-Z
    lower-cased; a window is ``window`` consecutive words of an item, or the whole of a shorter one.

    A null or empty text has no words and no hits; items without a word are in no document. A null item id is
    an empty string. Repeated rows of documents get the same result each; repeated items count once. Without
    items nothing is hit; an empty table of documents stays one. A column of the name ``into`` is replaced.
    All ids of equal items stand in one row, as the list of ids asks for them anyway.
    """
    classes = workspace.written(item_classes(items, id_column), "benchmark-items")
    number, packed = blocks(classes, window)
    if number > 1:
        return _in_passes(docs, classes, packed, text_column, into, listed)
    block = next(packed, EMPTY)
    block.ids.update({r["class"]: r.ids for r in classes.select("class", "ids").collect()})
    return docs.withColumn(into, F.pandas_udf(_contaminated(block, listed), FOUND)(text_column))


KEY = "_text_sha256"


def _in_passes(docs: DataFrame, classes: DataFrame, packed: Iterator[Block], text_column: str, into: str,
               listed: bool) -> DataFrame:
    """A scan for each block; its hits by the digest of the text, once for equal texts, then joined."""
    text = F.col(text_column)
    parts = [
        workspace.written(
            docs.select(text.alias("text")).filter("text IS NOT NULL").withColumn(
                "f", F.pandas_udf(_hit_by(block), HITS)("text")).filter("f.n_hit > 0").select(
                F.sha2("text", 256).alias(KEY), "f.spans", "f.classes").dropDuplicates([KEY]), "contamination")
        for block in packed]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    spans = hits.groupBy(KEY).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("s")).select(
        KEY, _union(F.col("s")).alias("_spans"))
    named = hits.select(KEY, F.explode("classes").alias("class")).join(classes.select("class", "ids"), "class").select(
        KEY, F.explode("ids").alias("id")).distinct().groupBy(KEY).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    # One column beside the documents' own, under a name that they do not have.
    key = _free(docs, "_key")
    found = spans.join(named, KEY).select(
        F.col(KEY).alias(key), F.struct("_spans", "_ids").alias(_free(docs, "_found")))
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    joined = docs.withColumn(key, F.sha2(text_column, 256)).join(found, key, "left")
    told = F.col(_free(docs, "_found"))
    spans = F.coalesce(told["_spans"], F.array().cast(SPANS))
    ids = F.coalesce(told["_ids"], F.array().cast("array<string>"))
    items = F.array_join(ids, ",")
    return joined.withColumn(into, F.struct(
        F.size(F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))).cast("long").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        spans.alias("spans"), F.size(ids).cast("long").alias("n_items"),
        (items if listed else F.lit(None).cast("string")).alias("items"), F.sha2(items, 256).alias("items_sha256"),
    )).drop(key, _free(docs, "_found")).select(*[c for c in docs.columns if c != into], into)


def _free(df: DataFrame, name: str) -> str:
    """The name, with more underscores while the frame has a column of it."""
    while name in df.columns:
        name += "_"
    return name


def _union(spans: Column) -> Column:
    """Sorted spans as the fewest that cover the same words."""
    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.concat(done, F.array(s))).cast(SPANS)

    return F.aggregate(spans, F.array().cast(SPANS), add)


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_column: str = "doc_id",
                    text_column: str = "text", id_column: str = "item_id") -> DataFrame:
    """(class, start, words, doc, at): the longest verbatim match of each item suffix over all shards.

    ``class`` is that of ``item_classes``, ``start`` the suffix's place in the item, ``at`` where the match
    begins in the document ``doc``; both count words. Where several places match as many words it is one of
    them. Suffixes that match fewer words than their window are left out; a match ends with its piece of an
    item of over 100,000 words. Rows and nulls as for ``contamination``.
    """
    classes = workspace.written(item_classes(items, id_column), "benchmark-items")
    schema = "class string, start long, words long, doc string, at long"
    parts = []
    for block in blocks(classes, window)[1]:
        least = np.where(block.size > 0, block.size, WIDEST)

        def scan(batches: Iterator[pd.DataFrame], block=block, least=least) -> Iterator[pd.DataFrame]:
            for batch in batches:
                done = 0
                for tokens, starts in _shards(batch["text"].tolist(), block.vocabulary):
                    found = search(tokens, block)
                    which = np.flatnonzero(found.longest >= least)
                    at = found.at[which]
                    doc = np.searchsorted(starts, at, "right") - 1
                    begin = np.searchsorted(block.piece, block.piece[which])
                    yield pd.DataFrame({
                        "class": [block.classes[p] for p in block.piece[which]],
                        "start": which - begin + block.starts[block.piece[which]], "words": found.longest[which],
                        "doc": batch["doc"].to_numpy()[done + doc], "at": at - starts[doc]})
                    done += len(starts) - 1

        read = docs.select(F.col(doc_column).cast("string").alias("doc"), F.col(text_column).alias("text"))
        parts.append(read.mapInPandas(scan, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("class", "start").agg(F.max(F.struct("words", "doc", "at")).alias("m")).select("class", "start", "m.*")


def decontaminate(docs: DataFrame, items: DataFrame, **kwargs) -> DataFrame:
    """The documents in which no window of an item stands; columns as they were."""
    into = _free(docs, "_benchmark")
    return contamination(docs, items, into=into, listed=False, **kwargs).filter(F.col(into)["n_hit"] == 0).drop(into)
