"""Near-duplicate documents from bottom-k sketches.

One hash function orders the shingles of a document; its sketch is the ``sketch`` smallest values.

1. Documents with equal shingle sets are one class and go on as one row.
2. Retained values are counted. A class is listed under its first values only: so many that two classes that
   may link share at least one of them (prefix filter over the sketch). Rare values come first, the rarest leading;
   those of more than SHORT classes follow, ordered by the hubs of their lists.
3. Lists of up to SHORT classes give pairs. In a longer list every class that may have a partner there
   beyond the short lists is paired with one central class, the hub, alone. Lists that have good hubs in
   common share one and stand together in the order, so a class seldom has more than one.
4. The sketch of the union of a pair estimates its similarity; pairs that cannot link are dropped.
5. The full sets of the rest decide. Members of a hub's family also get the difference of their set
   from the hub's. Two of them that both link to the hub need no further look. Any other two that link
   must share a part of their differences, so they meet in the short lists of the rarest shingles of
   these (the prefix filter once more); members of a list that is long even then are compared in
   bounded cells. Differences give the exact similarity.
6. Components of the links name the groups.

So a group of very many near copies, and very many pages of one template, cost in proportion to their
number; no list is collected beyond SHORT classes, and no link between different sets is left out.

Chances: for sets that fit a sketch, steps 2 and 4 are exact. For larger ones they could miss a
pair right at the threshold with a chance of MISS at most, as the values that a sketch of the union
holds of the intersection follow a (hyper-)binomial law.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import words
from foliomill.llm.components import components
from foliomill.sources import workspace

SKETCH = 32
MISS = 1e-8
SHORT = 64    # classes of a list that are paired with each other
CELL = 256    # members of a family in one block; a cell compares two blocks
_SIGN = np.uint64(1 << 63)


@functools.cache
def needed(size: int, percent: int) -> int:
    """Values that two sketches of ``size`` share but with a chance of MISS, at the threshold."""
    p, tail = percent / 100, 0.0
    for shared in range(size + 1):
        tail += math.comb(size, shared) * p**shared * (1 - p) ** (size - shared)
        if tail > MISS:
            return max(1, shared)
    return size


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct shingles as signed values; A-Z are folded, words stand between ASCII blanks."""
    runs = words.shingles(words.word_hashes(text, lower=True), shingle)
    return (runs ^ _SIGN).view(np.int64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    return tuple(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches cut to a few hundred rows, so results of long texts do not add up."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), rows):
            yield batch.iloc[at:at + rows]


def _signatures(docs: DataFrame, shingle: int, sketch: int) -> DataFrame:
    """(id, n, a, b, sketch) of (id, text) rows."""
    kind = docs.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            # Only the sketch and the numbers of a set are kept, not the set.
            rows = []
            for text in batch["text"]:
                values = shingle_set(text, shingle)
                rows.append((len(values), *fingerprint(values), values[:sketch].copy()))
            out = pd.DataFrame(rows, columns=["n", "a", "b", "sketch"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    # As text: pandas would make doubles of numbers that stand beside a null.
    return docs.withColumn("id", F.col("id").cast("string")).mapInPandas(
        signed, "id string, n long, a long, b long, sketch array<long>").withColumn("id", F.col("id").cast(kind))


def _prefixes(classes: DataFrame, sketch: int, percent: int) -> DataFrame:
    """(a, n, values, places, apart): the shared values of each class, rarest first, as (df, v, p), p its place
    in the sketch; how many of them it is listed under; and what a partner in long lists alone leaves out.

    Classes that share a short value at all share one that both are listed under. Any others share long values
    only, and must have ``needed`` of them among the ``sketch`` smallest of their union: so of the values
    that a class has before its ``needed``-th long one, those that are not long, ``apart`` in number, stand in this
    union beside the common ones, as do those of the partner.
    """
    held = classes.select("a", "n", F.size("sketch").alias("m"), F.posexplode("sketch").alias("p", "v"))
    # Stored, so that the join has a shuffle of its own on either side and a hot value can be split.
    shared = workspace.written(held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values")
    marked = held.join(shared, "v").groupBy("a", "n", "m").agg(
        F.array_sort(F.collect_list(F.struct("df", "v", "p"))).alias("values"))
    # A smaller set than the sketch must share at least this part of itself: the other set is at
    # most its size over the threshold, and so is what the other sketch can have cut off.
    part = 2 * percent - 100
    need = F.when(F.col("m") < sketch, F.greatest(F.lit(1), F.ceil(F.col("m") * part / percent - 1e-9))).otherwise(
        F.lit(needed(sketch, percent)))
    # Values that no other class has come first in the order and take their places of the prefix.
    places = F.greatest(F.lit(0), F.col("m") - need + 1 - (F.col("m") - F.size("values"))).cast("int")
    most = needed(sketch, percent)
    long = F.array_sort(F.transform(F.filter("values", lambda x: x["df"] > SHORT), lambda x: x["p"]))
    apart = F.when(F.col("m") == sketch, F.coalesce(F.get(long, F.lit(most - 1)) - (most - 1), F.lit(0))).otherwise(F.lit(0))
    return marked.select("a", "n", "values", places.alias("places"), apart.alias("apart"))


def _listed(prefixes: DataFrame, classes: DataFrame, sketch: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs from short lists, and (hub, member) pairs from longer ones."""
    short = prefixes.select("a", F.explode(F.filter(F.slice("values", 1, F.col("places")), lambda x: x["df"] <= SHORT)).alias("x"))
    lists = short.groupBy(F.col("x.v").alias("v")).agg(F.array_sort(F.collect_list("a")).alias("list")).filter(F.size("list") > 1)
    first = lists.select("list", F.posexplode("list").alias("at", "x"))
    pairs = first.select("x", F.explode(F.slice("list", F.col("at") + 2, F.size("list"))).alias("y")).distinct()

    near = F.size(F.filter("values", lambda y: (y["df"] * 5 >= F.col("x.df") * 2) & (y["df"] * 2 <= F.col("x.df") * 5)))
    # Sizes of classes that may link are in the same step or in neighbouring ones.
    step = F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-6))
    places = F.col("places") - F.size(F.filter("values", lambda y: y["df"] <= SHORT))
    long = workspace.written(prefixes.withColumn("places", places).select(
        "a", "n", "apart", "values", "places", F.explode("values").alias("x")).filter(F.col("x.df") > SHORT).select(
        "a", F.col("x.v").alias("v"), near.alias("near"), "places", step.alias("step"), "apart"), "long-values")
    # Long values come behind the short ones, those of one hub together, so that a class has its places in few families.
    ranked = long.filter("places > 0").join(_hubs(long, classes), "v").groupBy("a", "places", "step", "apart").agg(
        F.array_sort(F.collect_list(F.struct("rank", "votes", "hub", "v"))).alias("lists"))
    members = workspace.written(ranked.select(
        "a", "step", "apart", F.explode(F.slice("lists", F.lit(1), F.col("places"))).alias("l")).select(
        "l.v", "l.hub", "a", "step", "apart"), "members")
    # Members of which nobody in the list is of a like size and has enough in common go no further.
    least = workspace.written(members.groupBy("v", "step").agg(F.min("apart").alias("least")).select(
        "v", "least", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")).groupBy(
        "v", "step").agg(F.min("least").alias("least")), "least-apart")
    likely = members.join(least, ["v", "step"]).filter(F.col("apart") + F.col("least") <= sketch - needed(sketch, percent))
    families = likely.filter("a <> hub").select(F.col("hub").alias("x"), F.col("a").alias("y")).distinct()
    return pairs, families


def _hubs(long: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, hub, rank, votes) of each long list that may have members, to be sorted by rank, votes and hub.

    A good hub is a class most of whose values are about as frequent as the list's own: the one that the
    list's members are copies of has nothing that they have not. Among the good ones each list takes the one that
    is best for the most members of all lists, so lists of the same members make one family and not one each.

    Hubs that share three quarters of the sketch with those who hold their values come first: near copies
    meet beside such a one, and not beside the page of a template that they all fill in. Within either
    rank the hub with the most votes leads, as it may serve for the lists of the others.
    """
    holders = long.filter("places > 0").select("v", "a")
    most = workspace.written(long.groupBy("v").agg(F.max("near").alias("most")).join(
        holders.groupBy("v").agg(F.count(F.lit(1)).alias("members")), "v"), "nearest")
    good = long.join(most, "v").filter(F.col("near") * 10 >= F.col("most") * 7)
    votes = good.groupBy("a").agg(
        F.sum(F.expr("100 * members * near div most")).alias("votes"), F.collect_list("v").alias("lists"))
    hubs = workspace.written(votes.select("votes", "a", F.explode("lists").alias("v")).groupBy("v").agg(
        F.max(F.struct("votes", "a")).alias("best")).select("v", F.col("best.a").alias("hub"), "best.votes"), "hubs")
    sketches = classes.select("a", "sketch")
    near = holders.join(hubs, "v").filter("a <> hub").select("hub", "a").distinct().join(sketches, "a").join(
        sketches.select(F.col("a").alias("hub"), F.col("sketch").alias("own")), "hub")
    common, whole = F.size(F.array_intersect("sketch", "own")), F.least(F.size("sketch"), F.size("own"))
    close = workspace.written(near.groupBy("hub").agg(
        (4 * F.sum(common) >= 3 * F.sum(whole)).alias("close")).filter("close").select("hub"), "close-hubs")
    return hubs.join(close.withColumn("rank", F.lit(0)), "hub", "left").select(
        "v", "hub", F.coalesce("rank", F.lit(1)).alias("rank"), (-F.col("votes")).alias("votes"))


def _estimated(pairs: DataFrame, classes: DataFrame, sketch: int, percent: int) -> DataFrame:
    """Pairs whose union sketch allows a link."""
    known = classes.select("a", "n", "sketch")
    both = pairs.join(known.select(F.col("a").alias("x"), F.col("n").alias("n_x"), F.col("sketch").alias("s_x")), "x").join(
        known.select(F.col("a").alias("y"), F.col("n").alias("n_y"), F.col("sketch").alias("s_y")), "y")
    sized = both.filter(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    union = F.slice(F.array_sort(F.array_union("s_x", "s_y")), 1, sketch)
    met = sized.select("x", "y", union.alias("union"), F.array_intersect("s_x", "s_y").alias("common"))
    hits = F.size(F.filter("common", lambda v: v <= F.element_at("union", -1)))
    whole = F.size("union") < sketch
    return met.filter(F.when(whole, 100 * hits >= percent * F.size("union")).otherwise(
        hits >= needed(sketch, percent))).select("x", "y")


def _texts(docs: DataFrame, classes: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(a, node, blob): compressed text of one document of each class asked for.

    Texts are compressed before they travel. A document whose id also stands at another text may
    come out of the join with both; only the text of the class goes on.
    """
    def compressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in _slices(batches):
            yield batch.assign(text=[pack((text or "").encode()) for text in batch["text"]])

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right = [fingerprint(shingle_set(_opened(row.text), shingle)) == (row.a, row.b) for row in batch.itertuples()]
            yield batch[right][["a", "node", "text"]]

    blobs = docs.filter(F.col("id").isNotNull()).mapInPandas(compressed, "id long, text binary")
    nodes = classes.join(asked.distinct(), "a", "left_semi").select(F.col("node").alias("id"), "node", "a", "b")
    found = blobs.join(nodes, "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "a", "h"])
    return workspace.written(found.select("a", "b", "node", "text").mapInPandas(
        checked, "a long, node long, text binary"), "texts")


def _opened(blob: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(blob).decode()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(x, y, u, v, n_x, n_y, linked, lacking, added): pairs decided on full sets.

    ``lacking`` and ``added`` are what only the first and only the second set holds, for families alone.
    """
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, one = None, None
        for batch in _slices(batches):
            rows = []
            for row in batch.itertuples(index=False):
                if last != row.text_x:
                    last, one = row.text_x, shingle_set(_opened(row.text_x), shingle)
                two = shingle_set(_opened(row.text_y), shingle)
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked = 100 * common >= percent * (len(one) + len(two) - common)
                lacking = added = None
                if row.family:
                    lacking, added = (np.setdiff1d(*sets, assume_unique=True) for sets in ((one, two), (two, one)))
                elif not linked:
                    continue
                rows.append((row.x, row.y, row.u, row.v, len(one), len(two), linked, lacking, added))
            yield pd.DataFrame(rows, columns=["x", "y", "u", "v", "n_x", "n_y", "linked", "lacking", "added"])

    right = texts.select(F.col("a").alias("y"), F.col("node").alias("v"), F.col("text").alias("text_y"))
    left = texts.select(F.col("a").alias("x"), F.col("node").alias("u"), F.col("text").alias("text_x"))
    return pairs.join(right, "y").join(left, "x").mapInPandas(
        decide, "x long, y long, u long, v long, n_x long, n_y long, linked boolean, lacking array<long>, added array<long>")


def _family_links(verified: DataFrame, percent: int) -> DataFrame:
    """(u, v) links between members of a family that are not both linked to its hub.

    R is what a member lacks of the hub, A what it has beside it, n its size, p the threshold. Two members
    have n_hub - |R1 or R2| + |A1 and A2| shingles in common, and must have p n1 and p n2.

    * So A1 and A2 share at least |A1| - (1 - p) n1. Where that is over zero for one of the two, they meet in
      the lists of what was added.
    * With D both A and R, and w = p |A| + |R|, D1 and D2 share at least (w1 + w2 - (1 - p) n_hub) / (1 + p); w
      is over (1 - p) n_hub if and only if a member does not link to the hub. That is over zero unless both
      link to it. All other pairs meet in the lists of these.
    """
    members = verified.filter(F.col("added").isNotNull())
    sizes = members.groupBy("x").agg(F.count(F.when(~F.col("linked"), 1)).alias("open")).filter("open > 0").select("x")
    added, lacking = F.size("added").cast("long"), F.size("lacking").cast("long")
    spare = 100 * added - (100 - percent) * F.col("n_y")
    rows = workspace.written(
        members.join(sizes, "x", "left_semi").withColumns({"bound": spare > 0, "difference": F.concat("lacking", "added")}),
        "family-members")
    weight = percent * added + 100 * lacking
    over = weight - (100 - percent) * F.col("n_x")
    # The least overlap with any partner: of a member that links to the hub, one that does not.
    least = F.when(F.col("linked"), F.floor(weight / (100 + percent)) + 1).otherwise(F.ceil(over / (100 + percent) - 1e-9))
    by_added, long_added = _meetings(rows, "added", F.ceil(spare / 100 - 1e-9), "bound", "bound", percent)
    loose = rows.filter("NOT bound")
    by_all, long_all = _meetings(loose.withColumn("any", F.lit(True)), "difference", least, "any", "open", percent)
    pairs = by_added.unionByName(by_all).distinct()
    known = rows.select("x", "v", F.col("n_x").alias("hub"), "n_y", "difference")
    met = pairs.join(known, ["x", "v"]).join(known.select(
        "x", F.col("v").alias("u"), F.col("n_y").alias("m_y"), F.col("difference").alias("other")), ["x", "u"])
    lacked = F.expr("(hub + size(difference) - n_y) div 2 + (hub + size(other) - m_y) div 2")
    common = F.col("hub") - lacked + F.size(F.array_intersect("difference", "other"))
    close = met.filter(100 * common >= percent * (F.col("n_y") + F.col("m_y") - common)).select("u", "v")
    rest = long_added.unionByName(long_all).distinct()
    return close.unionByName(_cells(rows.join(rest, ["x", "v"], "left_semi"), percent))


def _meetings(rows: DataFrame, shingles: str, least, asked: str, asking: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(x, u, v) pairs from the short lists of the shingles in a column, and (x, v) members of longer lists.

    ``least`` is how many of them a member shares with a partner; lists that nobody asks for are left out, and
    so are pairs whose sizes alone keep them apart.
    """
    marked = rows.select(
        "x", "v", "linked", F.col(asked).alias("asked"), F.col("n_y").alias("n"), (~F.col("linked")).alias("open"), "bound",
        F.col(shingles).alias("all"), F.greatest(least, F.lit(1)).alias("least"))
    held = marked.select("x", "v", asking, F.explode("all").alias("e"))
    # Stored, so that the join has a shuffle of its own on either side and a hot shingle can be split.
    shared = workspace.written(held.groupBy("x", "e").agg(
        F.count(F.lit(1)).alias("df"), F.max(asking).alias("any")).filter("df > 1 AND any").drop("any"), "family-shingles")
    values = held.join(shared, ["x", "e"]).groupBy("x", "v").agg(
        F.array_sort(F.collect_list(F.struct("df", "e"))).alias("values"))
    # Rarest first, so that what very many members have is in no list. Shingles that no other member has come
    # before these and take their places of the prefix.
    unshared = F.size("all") - F.size("values")
    places = F.greatest(F.size("all") - F.col("least") + 1 - unshared, F.lit(0)).cast("int")
    listed = workspace.written(marked.join(values, ["x", "v"]).select(
        "x", "v", "linked", "asked", "n", F.explode(F.slice("values", F.lit(1), places)).alias("l")).select(
        "x", "v", "linked", "asked", "n", F.col("l.df").alias("df"), F.col("l.e").alias("e")), "family-lists")
    lists = listed.filter(F.col("df") <= SHORT).groupBy("x", "e").agg(
        F.array_sort(F.collect_list(F.struct("v", "linked", "asked", "n"))).alias("list")).filter(F.size("list") > 1)
    one = F.col("one")

    def may_link(two):
        return (~(one["linked"] & two["linked"]) & (one["asked"] | two["asked"])
                & (100 * F.least(one["n"], two["n"]) >= percent * F.greatest(one["n"], two["n"])))

    first = lists.select("x", "list", F.posexplode("list").alias("place", "one"))
    others = F.filter(F.slice("list", F.col("place") + 2, F.size("list")), may_link)
    met = first.select("x", one["v"].alias("u"), F.explode(others).alias("two")).select("x", "u", F.col("two.v").alias("v"))
    return met, listed.filter(F.col("df") > SHORT).select("x", "v")


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """(u, v) links between members of long lists: blocks of those that do not link to the hub, against all.

    A cell returns no more links than join its members, so at most one less than it has.
    """
    sizes = members.groupBy("x", "linked").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("n")).groupBy("x").agg(
        F.coalesce(F.max(F.when(~F.col("linked"), F.col("n"))), F.lit(0)).alias("open"),
        F.coalesce(F.max(F.when(F.col("linked"), F.col("n"))), F.lit(0)).alias("closed"))
    # Blocks of open members come first; a cell is two blocks, of which the first is one of these.
    blocked = members.join(sizes.filter("open > 0"), "x").withColumn("i", F.when(
        F.col("linked"), F.col("open") + F.pmod(F.xxhash64("y"), F.greatest("closed", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("y"), F.col("open"))))
    others = F.when(F.col("linked"), F.sequence(F.lit(0).cast("long"), F.col("open") - 1)).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("open") + F.col("closed") - 1))
    cells = blocked.withColumn("j", F.explode(others)).select(
        "x", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "v", "n_x", "n_y", "linked", "lacking", "difference")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        n, hub = part["n_y"].to_numpy(), int(part["n_x"].iloc[0])
        linked, node = part["linked"].to_numpy(), part["v"].tolist()
        found: list[tuple[int, int]] = []
        if not linked.all():
            common = hub - part["lacking"].map(len).to_numpy()
            common = common[:, None] - (hub - common)[None, :] + _overlaps(part["difference"].tolist())
            links = 100 * common >= percent * (n[:, None] + n[None, :] - common)
            links &= ~(linked[:, None] & linked[None, :])
            block = part["i"].to_numpy()
            if part["low"].iloc[0] != part["high"].iloc[0]:
                links &= block[:, None] != block[None, :]
            root = list(range(len(part)))

            def top(at: int) -> int:
                while root[at] != at:
                    root[at] = root[root[at]]
                    at = root[at]
                return at

            for p, q in np.argwhere(np.triu(links, 1)).tolist():
                p_top, q_top = top(p), top(q)
                if p_top != q_top:
                    root[p_top] = q_top
                    found.append((node[p], node[q]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return cells.groupBy("x", "low", "high").applyInPandas(compare, "u long, v long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a cell, by a product of membership matrices in slices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(every), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), 4096):
        inside = (column >= at) & (column < at + 4096)
        held = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        held[owner[inside], column[inside] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def links(signed: DataFrame, docs: DataFrame, shingle: int, percent: int, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of the signatures of (id, text) rows: one row for each distinct shingle set with its
    smallest id as ``node``, and links (u, v) between nodes that join the same nodes as all links would."""
    classes = workspace.written(signed.filter("n > 0 AND id IS NOT NULL").groupBy("a", "b").agg(
        F.min("id").alias("node"), F.min("n").alias("n"), F.min_by("sketch", "id").alias("sketch")), "classes")
    short, families = _listed(workspace.written(_prefixes(classes, sketch, percent), "prefixes"), classes, sketch, percent)
    pairs = workspace.written(
        _estimated(short, classes, sketch, percent).withColumn("family", F.lit(False)).unionByName(
            families.withColumn("family", F.lit(True))), "pairs")
    texts = _texts(docs, classes, pairs.select(F.explode(F.array("x", "y")).alias("a")), shingle)
    verified = workspace.written(_verified(pairs, texts, shingle, percent), "verified")
    found = verified.filter("linked").select("u", "v").unionByName(_family_links(verified, percent))
    return classes, found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text", sketch: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked if their sets of ``shingle``-word runs are to ``percent`` per cent
    alike (Jaccard); a text with fewer words is one run. ``component_id`` is the smallest id that
    links lead to, and the document that has it is kept. Texts that are null or hold no word have
    an empty set and are linked with nothing. Rows with the same id are one document to the links:
    whatever either text links to joins the group, and both rows are kept or not together. A row
    without an id is in no group: its component is null and it is kept. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = workspace.written(_signatures(rows, shingle, sketch), "signatures")
    classes, found = links(signed, rows, shingle, percent, sketch)
    keys = signed.drop("sketch")
    placed = workspace.written(keys.join(
        classes.filter("node IS NOT NULL").select("a", "b", "node"), ["a", "b"], "left").withColumn(
        "node", F.when(F.col("id").isNotNull(), F.col("node"))).select("id", "n", "node"), "placed")
    again = placed.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    groups = components(found.unionByName(again.filter("u < v").select("u", "v")))
    return placed.join(groups, "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "node", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "node", "id") == F.col("id"))).alias("kept"))
