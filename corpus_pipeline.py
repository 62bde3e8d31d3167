"""A training corpus from raw documents: filter, deduplicate, mask, mix, tokenise.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import mil_quality, mixing, near_duplicates, pii, sentencepieces
from foliomill.sources import workspace
from foliomill.sources.tables import read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on a bounded sample of the
    labelled ones among them. Null and empty texts are scored like any other."""
    model = mil_quality.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return docs.filter(mil_quality.score(model, F.col("text")) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity of 0.8 or more.

    The smallest id of a group stays. An id that stands at several texts is a document with each: those texts
    are grouped by their shingles alone, and in a group come behind the ids that have one text. Rows that
    repeat id and text are one, of which the first by its JSON text stays. Null and empty texts, texts
    without words and rows without an id stay, however often. An empty table gives an empty one; further
    columns of any type and name go along.
    """
    names, text = docs.columns, F.coalesce("text", F.lit(""))
    key, digest = _free(docs, "_key"), _free(docs, "_digest")
    told = docs.withColumn(digest, F.md5(text))
    texts = told.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(digest).alias("least"), F.max(digest).alias("most"), F.count(F.lit(1)).alias("n"))
    shared = workspace.written(texts.filter("n > 1").drop("n"), "repeated-ids")
    several = shared.filter("least <> most").select("doc_id")
    keyed = told.withColumn(key, F.col("doc_id"))
    if several.limit(1).count():
        # Numbers beyond all ids for the texts of such ids, kept apart from the texts themselves.
        most = docs.agg(F.max("doc_id")).first()[0]
        numbers = workspace.written(told.join(several, "doc_id", "left_semi").select("doc_id", digest).distinct().withColumn(
            "n", F.lit(most) + 1 + F.monotonically_increasing_id()), "text-keys")
        keyed = told.join(numbers, ["doc_id", digest], "left").withColumn(key, F.coalesce("n", "doc_id")).drop("n")
    keyed = workspace.written(keyed.select(*names, key), "keyed") if several.limit(1).count() else keyed.select(*names, key)
    found = near_duplicates.near_duplicates(keyed.select(key, "text"), shingle=5, percent=80, id_column=key)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    kept = keyed.join(dropped, key, "left_anti")
    # Of rows that repeat id and text, and have words, one.
    twice = found.filter("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("doc_id").alias(key)).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    row = F.struct(*[F.col(name) for name in names])
    once = kept.join(twice, key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(twice, key, "left_anti").select(*names).unionByName(once)


def _free(df: DataFrame, name: str) -> str:
    """The name, with more underscores while the frame has a column of it."""
    while name in df.columns:
        name += "_"
    return name


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind, and n_chars set anew.

    Every row stays, repeated ones too. Null and empty texts stay as they are, and so does the n_chars of a
    null; an empty table stays empty. Further columns go along.
    """
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast("long"))) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, whole documents repeated, in the order of training.

    A null source is a source of its own, the last. Null, empty and wordless texts have size 0 and are not
    taken; rows that repeat an id are documents of their own. An empty table gives an empty one; further columns
    go along.
    """
    return mixing.copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and a digest of the text that they decode to.

    A null text counts as an empty one: the end id alone. Repeated rows are told each; an empty table gives
    an empty one. Columns but doc_id and text are left out, whatever their names.
    """
    model = sentencepieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepieces.encode(docs, model, decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

# Hash sketches, attention and byte-pair merges are not SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole documents table; of each only its result is left."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = workspace.fresh(spark, f"stage-{name}")
        with workspace.scope(spark):
            docs = workspace.written(stage(spark, docs, sf_dir), name, path)
    return docs
