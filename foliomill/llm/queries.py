"""One query for each operator, (spark, table folder) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import (
    decontamination, hard_negatives, license_scan, mil_quality, mixing, near_duplicates, pii, quality_rules, sentence_spans,
    sentencepieces, topk, warc, whitening,
)
from foliomill.sources import workspace
from foliomill.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepieces(spark, folder):
    """Digests of the ids of every whole document and of the text they decode to."""
    model = sentencepieces.load(PIECES)
    encoded = sentencepieces.encode(read(spark, folder, "documents"), model, decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_mil_quality(spark, folder):
    """Every whole document scored by a model that never saw the labels of held-out ones."""
    docs = read(spark, folder, "documents")
    model = mil_quality.fit(docs, read(spark, folder, "labels"))
    scored = docs.select(
        "doc_id", mil_quality.held_out("doc_id").alias("held_out"), mil_quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query
def op3_near_duplicates(spark, folder):
    """Groups of documents whose three-word shingles are to 85 per cent alike."""
    return near_duplicates.near_duplicates(read(spark, folder, "documents"), shingle=3, percent=85)


@query
def op4_pii(spark, folder):
    """Personal data in every whole document."""
    found = read(spark, folder, "documents").select("doc_id", pii.spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[pii.count("found", kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"),
        F.aggregate("found", F.lit(0.0), lambda most, s: F.greatest(most, s["score"])).alias("top_score"))


@query
def op5_license_scan(spark, folder):
    """Licence notices in every whole document."""
    found = read(spark, folder, "documents").select("doc_id", license_scan.licenses(F.col("text")).alias("found"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda f: F.concat_ws(
            ":", f["license"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("spans"),
        F.aggregate("found", F.lit(0.0), lambda most, f: F.greatest(most, f["dice"])).alias("best_dice"))


@query
def op6_sentence_spans(spark, folder):
    """All documents without the passages that stand in an earlier one, or earlier in themselves."""
    return sentence_spans.remove_repeats(read(spark, folder, "documents"))


@query
def op7_warc(spark, folder):
    """All pages archived, and what the archive read back says of each."""
    archive = workspace.fresh(spark, "warc")
    warc.write(read(spark, folder, "pages"), archive)
    return warc.described(warc.read(spark, archive)).drop("stated_digest")


@query
def op8_mixing(spark, folder):
    """All documents mixed to the source weights, by training position."""
    return mixing.curriculum(mixing.mix(read(spark, folder, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken", "position")


@query
def op9_quality_rules(spark, folder):
    """The rule ledger of all documents under the newest policy; the base rules are version 1."""
    entries = quality_rules.ledger(quality_rules.measure(read(spark, folder, "documents")))
    base = quality_rules.apply_policy(entries, 1).withColumnRenamed("kept", "base_kept")
    return quality_rules.apply_policy(base).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "NOT base_kept AS base_failed", "kept", "failed", "n_lines", "n_capitals")


@query
def op10_exact_topk(spark, folder):
    """The five nearest by inner product for every fiftieth embedding, among all of them."""
    return topk.top_k(read(spark, folder, "embeddings"), every=50, k=5)


@query
def op11_whitening(spark, folder):
    """Every usable embedding on its first 32 whitened components, with the share each explains."""
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    models = whitening.fit(vectors)
    white = whitening.whiten(vectors, models)
    errors = whitening.identity_errors(white)
    dims = F.size("embedding")

    def told(value):
        return whitening.components_of(models, dims, value)

    return white.select(
        "vec_id", "white.deviation", told(lambda d, m: F.lit(m.n)).cast("long").alias("n"),
        told(lambda d, m: F.lit(errors.get(d))).cast("double").alias("identity_error"),
        told(lambda d, m: F.array(*[F.lit(float(x)) for x in m.explained])).cast("array<double>").alias("explained"),
        F.posexplode("white.whitened").alias("at", "whitened"),
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


@query
def op12_hard_negatives(spark, folder):
    """For every hundredth embedding and each of its five positives, the ten best hard negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, folder, "embeddings").withColumn("label", label))


@query
def op13_decontamination(spark, folder):
    """Which benchmark items stand in every whole document, and in how many of its words."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, read(spark, folder, "benchmark"), listed=False)
    return found.select(
        "doc_id", *[F.col("benchmark")[name].alias(name) for name in ("n_words", "n_hit", "n_items", "items_sha256")]
    ).withColumn("contaminated", F.col("n_hit") > 0)


_WHOLE_VECTORS = r"""
  SELECT DISTINCT vec_id, {label} AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

ORACLES = {
    "op10_exact_topk": "WITH e AS MATERIALIZED (" + _WHOLE_VECTORS.format(label="0") + r"""),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op12_hard_negatives": "WITH e AS MATERIALIZED (" + _WHOLE_VECTORS.format(
        label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") + r"""    AND label IS NOT NULL),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (
    PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
""",
    "op8_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
    3 * source_size AS top, sum(source_size) OVER () AS total FROM sources),
filled AS (
  SELECT *, total - coalesce(sum(top) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    row_number() OVER w AS place
  FROM weighed WINDOW w AS (ORDER BY top / weight, source NULLS LAST)),
level AS (
  SELECT place AS bound, remaining AS level_words, weights AS level_weights FROM filled
  WHERE remaining * weight <= top * weights ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, weight, CASE WHEN place < bound THEN top::DOUBLE
    ELSE level_words::DOUBLE * weight / level_weights END AS target FROM filled, level),
placed AS (
  SELECT doc_id, size, source_size, weight, target, floor(target + 0.5)::BIGINT AS want,
    coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
taken AS (
  SELECT *, size * (want // greatest(source_size, 1)) + greatest(0, least(size,
    want - (want // greatest(source_size, 1)) * source_size - start)) AS taken,
    least(1.0, start::DOUBLE / want) AS share, [-0.5, 0.0, 0.5][weight::INT] AS tilt FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN 2 * share / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)) END AS position
FROM taken
""",
    "op9_quality_rules": r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS window_words
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, window_words) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM docs LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (100 * n_dup_lines > 40 * n_lines)::INT
    + 16 * (n_words > 0 AND (10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words))::INT
    + 32 * (100 * n_capitals > 50 * word_chars)::INT)::BIGINT AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  failed = 0 AS kept, failed, n_lines, n_capitals FROM bits
""",
    "op13_decontamination": r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS MATERIALIZED (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS MATERIALIZED (
  SELECT DISTINCT r, i, n, item_id FROM doc_windows JOIN item_windows USING (n, said)),
words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits)
  GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""",
}
