"""Exact top-k inner products with a vector-approximation file.

The file holds, for each distinct vector, the cell it falls into in every dimension: 64 cells a
dimension, so six bits that bound the component from both sides. Queries scan the cells, block
against block. The bounds of the k-th best lower bound discard nearly all vectors; the rest are
read exactly in the order of their upper bounds, until the k-th exact score is at least the next
bound. Whatever the cells are, the result is exact.

Equal vectors are stored once with their smallest k + 1 ids: no other of their ids can be among
the k best of a query, the query's own row included, as ties go to the smaller id. Blocks are
bounded; a class is known by its smallest id and the hash of its vector, as an id may have several.
Every pair of a query block and a vector block is a row of its own, so neither side is
ever held whole: the work is queries x vectors, as an exact scan must be, in independent tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.sources import workspace

CELLS = 64
VECTORS_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024
FIRST_READ = 16  # candidates of a query that are read before the others are looked at again
SALTS = 16  # shares in which the ids of one vector are first ranked


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; unusable vectors and null ids left out."""
    components = F.col(vector_column).cast("array<double>")
    bad = F.exists(components, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~bad).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(components, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its smallest k + 1 ids.

    Ids are ranked in shares first, so a vector that very many rows share is spread over several
    tasks, and k + 1 ids of each share go on.
    """
    def first_ids(df: DataFrame, *key: str) -> DataFrame:
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id")))
        return ranked.filter(F.col("r") <= k + 1).drop("r")

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    return first_ids(first_ids(salted, "v", "salt"), "v").groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dims)


def approximation(distinct: DataFrame, cells: int = CELLS) -> DataFrame:
    """(dims, block, firsts, keys, counts, low, step, cell bytes): vectors in blocks, as cell numbers.

    Edges are those of the block itself: the range of each dimension in equal integer steps.
    """
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        dims = int(part["dims"].iloc[0])
        v = _matrix(part["v"], dims)
        low = v.min(axis=0) if dims else np.zeros(0, np.int64)
        step = np.maximum(1, -(-(v.max(axis=0) - low + 1) // cells)) if dims else np.zeros(0, np.int64)
        cell = ((v - low) // np.maximum(step, 1)).astype(np.uint8)
        return pd.DataFrame({
            "dims": [dims], "block": [part["block"].iloc[0]],
            "firsts": [part["first"].to_numpy(np.int64).tobytes()],
            "keys": [part["key"].to_numpy(np.int64).tobytes()],
            "counts": [part["ids"].map(len).to_numpy(np.int64).tobytes()],
            "low": [low.tobytes()], "step": [step.tobytes()], "cell": [cell.tobytes()],
        })

    return distinct.groupBy("dims", "block").applyInPandas(
        pack, "dims int, block long, firsts binary, keys binary, counts binary, low binary, step binary, cell binary")


def _query_blocks(queries: DataFrame) -> DataFrame:
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        dims = int(part["dims"].iloc[0])
        return pd.DataFrame({
            "dims": [dims], "query_block": [part["query_block"].iloc[0]],
            "query_ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
            "query_keys": [part["query_key"].to_numpy(np.int64).tobytes()],
            "q": [_matrix(part["v"], dims).tobytes()],
        })

    return queries.groupBy("dims", "query_block").applyInPandas(
        pack, "dims int, query_block long, query_ids binary, query_keys binary, q binary")


def _scan(k: int):
    """Bounds of every vector of a block for every query of a block; what may be among the best."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                firsts = np.frombuffer(row.firsts, np.int64)
                keys = np.frombuffer(row.keys, np.int64)
                counts = np.frombuffer(row.counts, np.int64)
                query_ids = np.frombuffer(row.query_ids, np.int64)
                query_keys = np.frombuffer(row.query_keys, np.int64)
                cell = np.frombuffer(row.cell, np.uint8).reshape(len(firsts), row.dims)
                step = np.frombuffer(row.step, np.int64).astype(np.float64)
                low = np.frombuffer(row.low, np.int64).astype(np.float64) + cell * step
                high = low + step - 1
                q = np.frombuffer(row.q, np.int64).reshape(len(query_ids), row.dims).astype(np.float64)
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                upper, lower = up @ high.T + down @ low.T, up @ low.T + down @ high.T
                # Rounding of sums beyond 2^53 can only be covered by widening the bounds.
                slack = 1e-12 * (np.abs(upper) + np.abs(lower)) * (np.abs(upper) > 2.0**50)
                upper, lower = upper + slack, lower - slack
                # A class that holds the query's id alone has no candidate: it is last and not sent.
                own = (firsts[None, :] == query_ids[:, None]) & (counts == 1)[None, :]
                lower[own] = -np.inf
                # A class of c equal vectors fills c places, one fewer if the query is in it.
                places = np.minimum(np.maximum(counts - 1, 1), k)
                order = np.argsort(-lower, axis=1, kind="stable")
                filled = np.cumsum(places[order], axis=1)
                enough = np.minimum((filled < k).sum(axis=1), len(firsts) - 1)
                sure = filled[:, -1] >= k
                rows = np.arange(len(query_ids))
                bound = np.where(sure, lower[rows, order[rows, enough]], -np.inf)
                which, what = np.nonzero((upper >= bound[:, None]) & ~own)
                yield pd.DataFrame({
                    "dims": np.full(len(which), row.dims, np.int32), "query_id": query_ids[which],
                    "query_key": query_keys[which], "first": firsts[what], "key": keys[what],
                    "upper": upper[which, what], "lower": lower[which, what],
                })
    return scan


def top_k(vectors: DataFrame, every: int, k: int = 5, id_column: str = "vec_id",
          vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """The k largest integer inner products of every query: (query_id, rank, vec_id, score).

    Vectors become floor(scale * x). Queries are the rows whose id is divisible by ``every``;
    candidates all rows but those of the query's own id. Ties go to the smaller id; with fewer than
    k candidates all are returned. Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part; vectors of different length are not compared. Rows that
    repeat an id and vector are one row; an id with several vectors
    is a candidate, and asks, with each. Scores are
    64-bit integers: components times ``scale`` must stay below 2^31 in size for them to be whole.
    An empty table gives an empty result; other columns are not read.
    """
    rows = workspace.written(
        quantised(vectors, id_column, vector_column, scale).distinct(), "vectors")
    distinct = distinct_vectors(rows, k).select(
        F.size("v").alias("dims"), F.element_at("ids", 1).alias("first"), F.xxhash64("v").alias("key"), "ids", "v")
    total = distinct.groupBy("dims").agg(
        F.ceil(F.count(F.lit(1)) / VECTORS_A_BLOCK).alias("blocks"))
    blocked = distinct.join(total, "dims").withColumn(
        "block", F.pmod(F.xxhash64("first", "key"), F.col("blocks")))
    file = workspace.written(
        blocked.select("dims", "block", "blocks", "first", "key", "ids", "v"), "vector-file")
    queries = rows.filter(F.col("vec_id") % every == 0).withColumns(
        {"dims": F.size("v"), "query_key": F.xxhash64("v")})
    asked = queries.groupBy("dims").agg(
        F.ceil(F.count(F.lit(1)) / QUERIES_A_BLOCK).alias("query_blocks"))
    query_blocks = _query_blocks(queries.join(asked, "dims").withColumn(
        "query_block", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks"))))
    # Every block of queries meets every block of vectors of its length: one row for each such pair.
    sent = query_blocks.join(file.select("dims", "blocks").distinct(), "dims").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bounds = workspace.written(
        sent.drop("blocks").join(approximation(file), ["dims", "block"]).mapInPandas(_scan(k), BOUNDS), "bounds")
    # The k-th best lower bound over all blocks: each class that was sent has a candidate. A query with
    # fewer keeps what it has.
    query = ["dims", "query_id", "query_key"]
    best = Window.partitionBy(*query).orderBy(F.desc("lower"))
    certain = bounds.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy(*query).agg(
        F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("bound"))
    left = bounds.join(certain, query).filter(F.col("bound").isNull() | (F.col("upper") >= F.col("bound")))
    left = workspace.written(left.select(*query, "first", "key", "upper"), "candidates")

    def scored(candidates: DataFrame) -> DataFrame:
        """Exact scores of candidates, a row for each id, without the query's own."""
        read = candidates.join(file.select("dims", "first", "key", "v", "ids"), ["dims", "first", "key"]).join(
            queries.select("dims", F.col("vec_id").alias("query_id"), "query_key", F.col("v").alias("q")), query)
        product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)
        each = read.select(*query, product.alias("score"), F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
        order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # In the order of their bounds: the first few are read and give a k-th score, then those whose
    # bound is not below it. No other can be among the k best.
    order = Window.partitionBy(*query).orderBy(F.desc("upper"), "first", "key")
    few = left.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIRST_READ).drop("r")
    kth = scored(few).groupBy(*query).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    certain = left.join(kth, query, "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth")
    return scored(certain).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


BOUNDS = "dims int, query_id long, query_key long, first long, key long, upper double, lower double"
