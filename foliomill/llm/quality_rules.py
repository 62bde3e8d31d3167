"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one failure bit for each rule.
Policies are masks over the bits, with a version each, so changing a policy, or asking what a rule
alone costs, reads the ledger and never the texts. Only DataFrame functions are used: no shuffle,
and every step is linear in the text but for sorting the windows of texts that repeat some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Rule -> condition over the measurements under which a document fails. The order gives the bits.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "n_words > 0 AND (10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words)",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
BIT = {rule: 1 << at for at, rule in enumerate(RULES)}
# Version -> mask of the rules that reject.
POLICIES = {1: BIT["too_few_words"] | BIT["repeated_words"], 2: (1 << len(RULES)) - 1}


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array, first ones included.

    Windows are compared by a 64-bit hash. Arrays without a repeated window end at a hash set;
    in others the windows are sorted with their places, equal neighbours marked, and the words
    under them counted once each.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(hashes)


def _covered(windows: Column) -> Column:
    size = F.size(windows)
    places = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i")))
    ordered = F.array_sort(places)

    def marked(window: Column) -> Column:
        equal = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (
            (F.get(window, i)["h"] == F.get(window, i - 1)["h"]).eqNullSafe(F.lit(True))
            | (F.get(window, i)["h"] == F.get(window, i + 1)["h"]).eqNullSafe(F.lit(True))))
        starts = F.transform(equal, lambda i: F.get(window, i)["i"])
        under = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
        return F.size(F.array_distinct(under))

    # One-element transform: binds the sorted array once instead of sorting for every reference.
    return F.get(F.transform(F.array(ordered), marked), 0)


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements of every whole text: a null text is measured as an empty one.

    Columns doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word that equal an earlier line), n_repeat_words, n_lines (lines with a word), n_capitals
    (A-Z). Null ids and repeated rows are measured like any row; other columns are not read.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
    split = texts.withColumns({
        "_words": F.array_remove(F.split("_text", SPACES), ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)),
    })
    counted = split.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("_windows"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size(F.split("_text", "[A-Z]")) - 1).cast("long").alias("n_capitals"),
    )
    repeats = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(0)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeats.cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def ledger(measured: DataFrame) -> DataFrame:
    """Measurements with ``failed``: the bits of the rules that the document fails."""
    bits = [F.when(F.expr(condition), F.lit(BIT[rule])).otherwise(0) for rule, condition in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(entries: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """Ledger with ``kept``: no bit of the policy's mask is set."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(entries: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """What each rule of a policy costs: (rule, failing, only): documents that fail it, and those
    that fail no other rule of the policy and so would come back without it.

    The ledger is first counted by its distinct bit patterns, of which there are at most two to the
    number of rules.
    """
    mask = POLICIES[version]
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(bit).cast("long").alias("bit"))
        for rule, bit in BIT.items() if bit & mask])
    return patterns.select("bits", "n", F.explode(rules).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only"))
