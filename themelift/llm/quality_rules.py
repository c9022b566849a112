"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks over the result.

The ledger has the measurements of each whole text and ``failures``, a bit for each rule that the
document breaks. A policy version is a set of rules; a document is kept under it if it breaks none
of them. Ablations need neither the texts nor the rules again: documents are counted by their
failure bits, and what a policy would keep without one of its rules follows by bit operations.

Defined results: a null or empty text has no words, all its measurements are 0 and it breaks the
rule for few words. Repeated rows have a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.llm.doc_stats import measured

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims",
    "n_bars", "n_word_repeats",
)

#: Rule by rule, in the order of their bits: name and the SQL condition under which it is broken.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_passages", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("exclamations", "5 * n_exclaims > n_words"),
    ("bars", "5 * n_bars > n_words"),
    ("equal_lines", "2 * n_dup_lines > n_lines"),
    ("stutter", "4 * n_word_repeats > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
NAMES = tuple(name for name, _ in RULES)

#: Versions are never changed; a new set of rules is a new version.
POLICIES = {
    "base": ("few_words", "repeated_passages"),
    "2": ("few_words", "repeated_passages", "symbols", "exclamations"),
    "3": NAMES,
}
CURRENT = "3"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << NAMES.index(rule) for rule in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failures``: bit k is set if rule k is broken."""
    bits = sum((F.when(F.expr(test), F.lit(1 << k)).otherwise(0) for k, (_, test) in enumerate(RULES)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return measured(rows, MEASURES).withColumn("failures", bits.cast("long"))


def breaks(policy: str) -> Column:
    """Whether a ledger row breaks a rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many ledger rows break it, how many break no other rule of
    the policy, and how many the policy keeps with and without it."""
    every = mask(POLICIES[policy])
    sums = rows.groupBy(F.col("failures").bitwiseAND(F.lit(every)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = sums.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")

    def count(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
