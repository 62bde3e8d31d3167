"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral is the source's weight
and so its share of the whole; the inverse of its running integral tells at which moment each of
the source's words is due. Documents are given positions that way and range-sorted by them.

Only DataFrame functions are used. Words are counted once; sizes and keys are stored without the texts.
The running word count inside a source is taken in two steps (inside 4096 hash buckets, then over the
buckets' totals), so one source with a third of all rows is spread over as many tasks. A bucket that
one id fills is cut further, by id, size and a hash of the text. The plan over sources is made in one
task, which sees one row for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.sources import workspace

SPACES = r"[\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # 16^3 hash buckets for each source
HOT = 2_000_000    # rows of a bucket that one task takes
SALTS = 64         # shares of the rows of a hot bucket that agree in id and size
CAP = 3            # a source is read at most so many times
TILTS = (-0.5, 0.0, 0.5)  # by weight 1, 2, 3: falling, level and rising schedules


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; a null text has none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
    return F.size(words).cast("long")


def _source_key(source: Column) -> Column:
    """A key that joins null sources like any other value."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Weights and target words of (source, source_size) rows.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Together they get as many
    words as they have. A target stops at ``cap`` times its source's size; the excess is shared
    among the others by weight until none is above: water-filling in the order of the ratio of
    limit to weight, where the level is the first that the next source's limit can bear.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sources.withColumn("weight", (
        F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    limited = weighed.withColumns({
        "limit": (F.col("source_size") * cap).cast("long"),
        "total": F.sum("source_size").over(every),
    }).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    filled = limited.withColumns({
        "filled": F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "weights_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "place": F.row_number().over(order),
    }).withColumn("left", F.col("total") - F.coalesce("filled", F.lit(0)))
    bears = (F.col("left").cast("decimal(38,0)") * F.col("weight")
             <= F.col("limit").cast("decimal(38,0)") * F.col("weights_left"))
    level = F.min(F.when(bears, F.struct("place", "left", "weights_left"))).over(every)
    return filled.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("place") < F.col("level.place"), F.col("limit").cast("double")).otherwise(
            F.col("level.left").cast("double") * F.col("weight") / F.col("level.weights_left")
        ).alias("target"),
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", cap: int = CAP) -> DataFrame:
    """Words taken of every document: (doc_id, size, source, source_size, weight, target, want,
    passes, start, part, taken).

    A source's documents stand in the order of a digest of their id. The mix reads the source
    ``passes`` whole times and then its first words up to the target, rounded to a word, so the
    document at the end is taken in part and no document more than ``cap`` times. ``start`` is the
    number of the source's words before the document. Null texts have size 0, null ids stand like
    an empty id, null sources are a source of their own; rows that repeat an id are documents of
    their own. An empty table gives an empty result. Reruns agree: nothing depends on row order.
    """
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    sized = workspace.written(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"), key.alias("_order"),
        F.xxhash64(text_column).alias("_text"), _source_key(F.col(source_column)).alias("_source"),
        F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"),
    ), "sizes")
    rows = sized.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    if rows.limit(1).count():
        # The finer key follows the order of the rows: digest, size, then which share of those that agree in both.
        fine = F.concat("_bucket", F.lit("-"), "_order", F.lit("-"), F.lpad(F.col("size").cast("string"), 19, "0"), F.lit("-"),
                        F.lpad(F.pmod("_text", F.lit(SALTS)).cast("string"), 3, "0"))
        hot = rows.select("_source", "_bucket", F.lit(True).alias("_hot"))
        sized = workspace.written(sized.join(hot, ["_source", "_bucket"], "left").withColumn(
            "_bucket", F.when(F.col("_hot"), fine).otherwise(F.col("_bucket"))).drop("_hot"), "sizes")
    buckets = sized.groupBy("_source", "_bucket").agg(
        F.first("source").alias("source"), F.sum("size").alias("_bucket_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_offset", F.coalesce(F.sum("_bucket_size").over(before), F.lit(0)))
    plan = targets(
        buckets.groupBy("_source").agg(
            F.first("source").alias("source"), F.sum("_bucket_size").cast("long").alias("source_size")
        ).drop("_source"), cap,
    ).withColumn("_source", _source_key(F.col("source"))).drop("source")
    placed = offsets.select("_source", "_bucket", "_offset").join(plan, "_source")

    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "size", "_text").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = ranked.join(placed, ["_source", "_bucket"]).withColumns({
        "want": F.floor(F.col("target") + 0.5).cast("long"),
        "start": F.col("_offset") + F.col("_inside"),
    }).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0))
    ).withColumn(
        "part", F.greatest(F.lit(0), F.least(
            F.col("size"), F.col("want") - F.col("passes") * F.col("source_size") - F.col("start"))),
    )
    return taken.select(
        "doc_id", "size", "source", "source_size", "weight", "target", "want", "passes", "start", "part",
        (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )


def due(share: Column, weight: Column) -> Column:
    """Moment at which a source has given ``share`` of its words.

    The schedule of a source is weight * (1 + a (2t - 1)); its integral from 0 to t, over that
    from 0 to 1, is (1 - a) t + a t^2, and this is the inverse.
    """
    tilt = F.element_at(F.array(*map(F.lit, TILTS)), weight.cast("int"))
    return 2 * share / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share))


def position(mixed: DataFrame, copy: Column) -> Column:
    """Training position, 0 to 1, of a document's copy number ``copy`` (from 0)."""
    offset = copy * F.col("source_size") + F.col("start")
    return due(F.least(F.lit(1.0), offset / F.col("want")), F.col("weight"))


def curriculum(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the position of their first copy; those not taken come first."""
    placed = mixed.withColumn(
        "position", F.when(F.col("taken") > 0, position(mixed, F.lit(0))))
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           source_column: str = "source", cap: int = CAP) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, a row for each copy, by training position.

    Only whole documents are repeated here: the one that a source's target cuts is taken once more
    if at least half of it fits. Rows that agree in id, source and size are read alike, as often as
    the longest share of one of them says; documents that the mix does not take, and those without
    words, are left out.
    """
    mixed = mix(docs, id_column, text_column, source_column, cap)
    rounded = F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    wanted = mixed.filter("size > 0").withColumn("copies", F.col("passes") + rounded).filter("copies > 0")
    shares = wanted.groupBy("doc_id", "source", "size").agg(F.max_by(
        F.struct("copies", "source_size", "start", "want", "weight"), F.struct("copies", "start")).alias("share"))
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(id_column).alias("row_id"),
        F.col(source_column).alias("row_source"), word_count(F.col(text_column)).alias("row_size"))
    matches = (F.col("row_id").eqNullSafe(F.col("doc_id")) & F.col("row_source").eqNullSafe(F.col("source"))
               & (F.col("row_size") == F.col("size")))
    each = rows.join(shares, matches).select(
        "doc", "row_id", "share.*",
        F.explode(F.sequence(F.lit(0), (F.col("share.copies") - 1).cast("int"))).alias("copy"))
    placed = each.withColumn("position", position(each, F.col("copy")))
    return placed.repartitionByRange("position", "row_id").sortWithinPartitions(
        "position", "row_id").select("doc.*")
