"""Hard negatives by spanning-tree bounds.

The anchors of a block hang on a spanning tree of least length, rooted at the zero vector, whose score
with anything is zero. A candidate's score with a child anchor is its score with the parent, give or
take the edge's length times the candidate's norm. Walking down the tree, a candidate is scored again
only where these bounds meet the window of scores that is looked for; an exact score makes the bounds
of the children narrow, a score that was left out makes them wider by one edge. Whatever the tree is,
the result is exact.

The tree is walked twice. The first time the window is that of the best rows of the anchor's own label;
the second time there is one for each of those, of the scores that make another label's row a hard
negative. Rows that share vector and label are one class with its smallest ids, so a vector that very
many rows share is one candidate. Every pair of an anchor block and a candidate block is a row of its
own: the work is anchors x classes at most, in bounded, independent tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.vectors import EXACT, floored, matrix, usable
from foliomill.sources import workspace

CANDIDATES_A_BLOCK = 4096
ANCHORS_A_BLOCK = 512
TASKS_A_CORE = 4
SALTS = 16  # shares in which the ids of one class are first ranked
SLACK = 1e-9  # of a bound, for the rounding of norms and edges
NO_ID = np.iinfo(np.int64).max


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(label, v, ids): each distinct vector and label with its smallest k ids, ranked in shares first."""
    def first_ids(df: DataFrame, *key: str) -> DataFrame:
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id")))
        return ranked.filter(F.col("r") <= k).drop("r")

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    return first_ids(first_ids(salted, "label", "v", "salt"), "label", "v").groupBy("label", "v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _dealt(df: DataFrame, size: int, block: str, *key: str) -> DataFrame:
    """``block`` by the hash of the key, so that blocks hold about ``size`` rows, and ``blocks`` of them by length."""
    total = df.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"{block}s"))
    return df.join(F.broadcast(total), "dims").withColumn(block, F.pmod(F.xxhash64(*key), F.col(f"{block}s")))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a least spanning tree of the points and the zero vector.

    ``order`` lists points so that a parent comes before its children; ``parent`` is -1 for the zero
    vector; ``edge`` is the distance to the parent.
    """
    x = points.astype(np.float64)
    norms = (x * x).sum(axis=1)
    nearest, parent = norms.copy(), np.full(len(x), -1)
    order, left = [], np.ones(len(x), bool)
    for _ in range(len(x)):
        at = int(np.argmin(np.where(left, nearest, np.inf)))
        order.append(at)
        left[at] = False
        away = norms + norms[at] - 2 * (x @ x[at])
        nearer = left & (away < nearest)
        nearest[nearer], parent[nearer] = away[nearer], at
    edge = np.linalg.norm(x - np.where(parent[:, None] >= 0, x[parent], 0.0), axis=1)
    return np.array(order, np.int64), parent, edge


class Candidates:
    """A block of classes: labels, norms, vectors, and the two smallest ids of each."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.class_ids, np.int64)
        self.first, self.second = np.frombuffer(row.firsts, np.int64), np.frombuffer(row.seconds, np.int64)
        self.labels = np.frombuffer(row.labels, np.int64)
        self.v = np.frombuffer(row.v, np.int64).reshape(len(self.ids), row.dims)
        self.real = self.v.astype(np.float64)
        self.norms = np.linalg.norm(self.real, axis=1)

    def smallest_id(self, own: int) -> np.ndarray:
        """The smallest id that is not ``own``; NO_ID where a class holds no other."""
        return np.where(self.first == own, self.second, self.first)

    def scores(self, which: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: as doubles while sums stay whole, else as 64-bit integers."""
        size = np.linalg.norm(anchor.astype(np.float64)) * (self.norms[which].max() if len(which) else 0.0)
        if size < EXACT:
            return (self.real[which] @ anchor.astype(np.float64)).astype(np.int64)
        return self.v[which] @ anchor


def walk(anchors: np.ndarray, order: np.ndarray, parent: np.ndarray, edge: np.ndarray, block: Candidates, wanted):
    """(anchor, candidates, exact scores) down the tree.

    ``wanted(anchor, low, high)`` tells which candidates to score from the bounds of their scores.
    """
    children = np.bincount(parent[parent >= 0], minlength=len(anchors))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    zero = np.zeros(len(block.ids))
    for at in order:
        up = int(parent[at])
        low, high = bounds[up] if up >= 0 else (zero, zero)
        reach = edge[at] * block.norms * (1 + SLACK)
        low, high = low - reach, high + reach
        # Sums of doubles this large are rounded; scores are whole numbers.
        low, high = low - SLACK * np.abs(low) - 0.5, high + SLACK * np.abs(high) + 0.5
        which = np.flatnonzero(wanted(at, low, high))
        scores = block.scores(which, anchors[at])
        if children[at]:
            low[which] = high[which] = scores
            bounds[int(at)] = low, high
        if up >= 0:
            children[up] -= 1
            if not children[up]:
                del bounds[up]  # only anchors with children still to come keep theirs
        yield int(at), which, scores


def _kth_greatest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _block_of(row):
    anchors = np.frombuffer(row.anchors, np.int64).reshape(len(row.anchor_ids) // 8, row.dims)
    tree = [np.frombuffer(getattr(row, name), kind) for name, kind in (
        ("tree", np.int64), ("parent", np.int64), ("edge", np.float64))]
    told = [np.frombuffer(getattr(row, name), np.int64) for name in ("anchor_ids", "anchor_keys", "anchor_labels")]
    return anchors, tree, told, Candidates(row)


def _positives(k: int):
    """The k best classes of each anchor's label in a block."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                anchors, tree, (ids, keys, labels), block = _block_of(row)

                def wanted(at, low, high):
                    fits = (block.labels == labels[at]) & (block.smallest_id(ids[at]) != NO_ID)
                    return fits & (high >= _kth_greatest(low[fits], k))

                out = []
                for at, which, scores in walk(anchors, *tree, block, wanted):
                    best = _best(scores, block.smallest_id(ids[at])[which], k)
                    out.append((np.full(len(best), keys[at]), block.ids[which[best]], scores[best]))
                if out:
                    key, found, score = map(np.concatenate, zip(*out))
                    yield pd.DataFrame({"anchor_key": key, "class_id": found, "score": score})
    return scan


def _negatives(k: int, lowest: int, highest: int):
    """The k best classes of other labels within each window of each anchor, in a block."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                anchors, tree, (ids, keys, labels), block = _block_of(row)
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(row.windows, np.int64))])
                asked = np.frombuffer(row.asked, np.int64)
                # lowest * positive <= 100 * score <= highest * positive, in whole numbers.
                bottom = np.array([-(-lowest * int(p) // 100) for p in asked], np.int64)
                top = np.array([highest * int(p) // 100 for p in asked], np.int64)

                def fits(at):
                    return (block.labels != labels[at]) & (block.smallest_id(ids[at]) != NO_ID)

                def wanted(at, low, high):
                    needed = np.zeros(len(low), bool)
                    for w in range(ends[at], ends[at + 1]):
                        inside = fits(at) & (high >= bottom[w]) & (low <= top[w])
                        sure = inside & (low >= bottom[w]) & (high <= top[w])
                        needed |= inside & (high >= _kth_greatest(low[sure], k))
                    return needed

                out = []
                for at, which, scores in walk(anchors, *tree, block, wanted):
                    for w in range(ends[at], ends[at + 1]):
                        inside = (scores >= bottom[w]) & (scores <= top[w])
                        best = _best(scores[inside], block.smallest_id(ids[at])[which[inside]], k)
                        out.append((np.full(len(best), keys[at]), np.full(len(best), asked[w]),
                                    block.ids[which[inside][best]], scores[inside][best]))
                if out:
                    key, positive, found, score = map(np.concatenate, zip(*out))
                    yield pd.DataFrame({
                        "anchor_key": key, "positive_score": positive, "class_id": found, "score": score})
    return scan


def _packed_candidates(part: pd.DataFrame) -> pd.DataFrame:
    dims = int(part["dims"].iloc[0])
    seconds = np.array([i[1] if len(i) > 1 else NO_ID for i in part["ids"]], np.int64)
    return pd.DataFrame({
        "dims": [dims], "block": [part["block"].iloc[0]],
        "class_ids": [part["class_id"].to_numpy(np.int64).tobytes()],
        "firsts": [np.array([i[0] for i in part["ids"]], np.int64).tobytes()], "seconds": [seconds.tobytes()],
        "labels": [part["label"].to_numpy(np.int64).tobytes()], "v": [matrix(part["v"], dims).tobytes()],
    })


def _packed_anchors(part: pd.DataFrame) -> pd.DataFrame:
    dims = int(part["dims"].iloc[0])
    part = part.sort_values("anchor_key")
    points = matrix(part["v"], dims)
    order, parent, edge = spanning_tree(points)
    return pd.DataFrame({
        "dims": [dims], "blocks": [part["blocks"].iloc[0]], "anchors": [points.tobytes()],
        "anchor_ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
        "anchor_keys": [part["anchor_key"].to_numpy(np.int64).tobytes()],
        "anchor_labels": [part["label"].to_numpy(np.int64).tobytes()],
        "tree": [order.tobytes()], "parent": [parent.astype(np.int64).tobytes()], "edge": [edge.tobytes()],
        "windows": [np.array([len(a) for a in part["asked"]], np.int64).tobytes()],
        "asked": [np.concatenate([np.array(a, np.int64) for a in part["asked"]]).tobytes()],
    })


CANDIDATES = ("dims int, block long, class_ids binary, firsts binary, seconds binary, labels binary, v binary")
ANCHORS = ("dims int, blocks long, anchors binary, anchor_ids binary, anchor_keys binary, anchor_labels binary, "
           "tree binary, parent binary, edge binary, windows binary, asked binary")


def _pairs(anchors: DataFrame, file: DataFrame) -> DataFrame:
    """A row for each anchor block and candidate block of the same length of vectors.

    Spark guesses the size of packed rows from the far smaller file: without the hint it would send all
    candidates to the driver and from there to every task.
    """
    tasks = TASKS_A_CORE * file.sparkSession.sparkContext.defaultParallelism
    packed = anchors.groupBy("dims", "anchor_block").applyInPandas(_packed_anchors, ANCHORS).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    candidates = file.groupBy("dims", "block").applyInPandas(_packed_candidates, CANDIDATES)
    return packed.repartition(tasks, "dims", "block").join(
        candidates.repartition(tasks, "dims", "block").hint("merge"), ["dims", "block"])


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, lowest: int = 30,
                   highest: int = 90, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become floor(scale * x); a score is an inner product. Anchors are the rows whose id is divisible
    by ``every``; an anchor's positives are the best rows of its label, its negatives for each of them the
    best rows of another label with ``lowest`` to ``highest`` per cent of the positive's score. Ties go to the
    smaller id; where there are fewer, all are returned.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of
    different length are not compared. Rows that repeat id, label and vector are one row. An id with several
    vectors or labels is an anchor and a candidate with each, but never a partner of its own id. A positive
    of negative score has no negatives. Components times ``scale`` must stay below 2^31 in size. An empty
    table gives an empty result; other columns are not read.
    """
    k = max(positives, negatives)
    read = vectors.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & usable(vector_column))
    rows = workspace.written(read.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"),
        floored(vector_column, scale).alias("v")).distinct(), "vectors")
    # The query's own id may stand in a class, so one id more is kept than can be among the best.
    named = classes(rows, k + 1).withColumns({"class_id": F.monotonically_increasing_id(), "dims": F.size("v")})
    stored = workspace.written(named, "classes")
    file = workspace.written(_dealt(stored, CANDIDATES_A_BLOCK, "block", "class_id"), "class-blocks")
    ids = stored.select("class_id", "ids")
    asking = workspace.written(
        rows.filter(F.col("vec_id") % every == 0).withColumns(
            {"anchor_key": F.monotonically_increasing_id(), "dims": F.size("v")}), "anchors")
    anchors = _dealt(asking, ANCHORS_A_BLOCK, "anchor_block", "anchor_key").join(
        file.select("dims", "blocks").distinct(), "dims")

    def ranked(found: DataFrame, k: int, *key: str) -> DataFrame:
        each = found.join(ids, "class_id").withColumn("other_id", F.explode("ids")).join(
            asking.select("anchor_key", F.col("vec_id").alias("anchor_id")), "anchor_key").filter("other_id <> anchor_id")
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "other_id", "class_id")
        return each.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)

    first = _pairs(anchors.withColumn("asked", F.array().cast("array<long>")), file).mapInPandas(
        _positives(positives), "anchor_key long, class_id long, score long")
    best = workspace.written(ranked(first, positives, "anchor_key").select(
        "anchor_key", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives")
    windows = best.groupBy("anchor_key").agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))
    second = _pairs(anchors.join(windows, "anchor_key"), file).mapInPandas(
        _negatives(negatives, lowest, highest), "anchor_key long, positive_score long, class_id long, score long")
    found = ranked(second, negatives, "anchor_key", "positive_score").select(
        "anchor_key", "positive_score", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
