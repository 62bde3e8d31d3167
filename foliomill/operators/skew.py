"""Per-key numbering and look-back that never gather one key's rows in one task.

A plain window sends all rows of a key to one task. Here the key is cut into buckets that follow
the wanted order; rows are ranked inside their bucket, and what the bucket needs to know about
the ones before it (a row count, a last row) comes from a pre-aggregated table with one row for
each key and bucket. The results equal the plain window's. A NULL key is a key like any other.

Few keys are that large. ``sized_row_number`` cuts those alone, at split points sampled from their
rows; all others take one plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT = 20_000   # rows of a key that one task takes
SPLITS = 200   # buckets of larger keys
SAMPLED = 20_000  # rows of larger keys that split points are taken from


def _attach(df: DataFrame, side: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Join ``value`` on the keys and ``_bucket``; the window already partitioned rows that way."""
    names = [*keys, "_bucket"]
    right = side.select(*[F.col(name).alias(f"_side{at}") for at, name in enumerate(names)], value)
    same = [F.col(name).eqNullSafe(F.col(f"_side{at}")) for at, name in enumerate(names)]
    return df.join(right, same, "left").drop(*[f"_side{at}" for at in range(len(names))])


def bucketed_running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], weight: Column, name: str
) -> DataFrame:
    """Sum of ``weight`` over ``keys`` up to each row by ``order``.

    ``bucket`` must not decrease along ``order``, and ``order`` must be unique within a key.
    """
    df = df.withColumns({"_bucket": bucket, "_weight": weight})
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    summed = df.withColumn("_inside", F.sum("_weight").over(inside))
    return _attach(summed, offsets, keys, "_before").withColumn(
        name, F.col("_inside") + F.coalesce("_before", F.lit(0))
    ).drop("_inside", "_before", "_bucket", "_weight")


def bucketed_row_number(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``."""
    return bucketed_running_sum(df, keys, bucket, order, F.lit(1), name)


def bucketed_lag(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str
) -> DataFrame:
    """``lag(value)`` over ``keys`` by ``order``; ``value`` must not be NULL."""
    df = df.withColumns({"_bucket": bucket, "_value": value})
    lasts = df.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = lasts.withColumn(
        "_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    looked = df.withColumn("_in", F.lag("_value").over(inside))
    return _attach(looked, carried, keys, "_carried").withColumn(
        name, F.coalesce("_in", "_carried")
    ).drop("_in", "_carried", "_bucket", "_value")


def large_keys(sizes: DataFrame, keys: list[str], rows: str) -> DataFrame | None:
    """The keys with more than HOT rows, or None if there are none."""
    large = sizes.filter(F.col(rows) > HOT).select(*keys)
    return large if large.limit(1).count() else None


def within(df: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join on the keys; NULL equals NULL."""
    right = side.select(*[F.col(name).alias(f"_side{at}") for at, name in enumerate(keys)])
    return df.join(right, [F.col(name).eqNullSafe(F.col(f"_side{at}")) for at, name in enumerate(keys)], how)


def split_points(df: DataFrame, column: str, parts: int = SPLITS) -> list:
    """Values that cut the rows into about ``parts`` even ranges, from a bounded sample of them."""
    total = df.count()
    share = min(1.0, SAMPLED / max(total, 1))
    seen = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).sample(share, 17).limit(2 * SAMPLED).collect())
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []


def range_bucket(column: str, points: list) -> Column:
    """How many split points are not above the value: never less for a greater value."""
    if not points:
        return F.lit(0)
    marks = F.array(*[F.lit(p) for p in points])
    return F.coalesce(F.size(F.filter(marks, lambda p: p <= F.col(column))), F.lit(0))


def sized_row_number(df: DataFrame, keys: list[str], order: str, name: str, sizes: DataFrame, rows: str) -> DataFrame:
    """``row_number`` over ``keys`` by the column ``order``; ``sizes`` tells the ``rows`` of each key."""
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    large = large_keys(sizes, keys, rows)
    if large is None:
        return df.withColumn(name, plain)
    hot = within(df, large, keys, "left_semi")
    cut = bucketed_row_number(hot, keys, range_bucket(order, split_points(hot, order)), [F.col(order)], name)
    return within(df, large, keys, "left_anti").withColumn(name, plain).unionByName(
        cut.withColumn(name, F.col(name).cast("int")))
