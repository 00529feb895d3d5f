"""Operator 13: quality rules as a bitmask ledger, in DataFrame functions only.

1. Every text is measured once (``MEASURES``), in its own row: no shuffle.
2. Every rule is evaluated once, on the measurements; a rule that fails sets its
   bit in ``failed``. Measurements and bits are the ledger, which can be stored.
3. A policy is a version and the rules it applies. It reads the bits only
   (``failed & mask``), so other policies and thresholds cost no pass over texts.
4. Ablations come from the counts of each bit pattern: what a policy would keep
   without one of its rules, and what only that rule removes. There are
   2 ** rules patterns at most, whatever the corpus.

Words of the three-word windows are sorted with their positions in the row; equal
neighbours are windows that stand twice or more, and the words they cover are
counted from the sorted positions, once each.

Defined cases: a null or empty text has no words and no lines, so all measures are
0 and ``few_words`` fails; texts of fewer than three words have no windows; rules
that compare a share of words or lines hold where there are none; a very long
text is measured whole, in memory in proportion to its words; repeated rows are
measured each; null and repeated doc_ids are carried; an empty table gives an
empty ledger and ablations of zeros; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import read_table

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measures; true where a document breaks the rule."""
    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


# Thresholds of published heuristics for web text, as whole numbers.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "short_words", "word_chars < 3 * n_words"),
    Rule(4, "long_words", "word_chars > 10 * n_words"),
    Rule(5, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
)

BASE = ("few_words", "repeated_phrases")
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "short_words", "long_words"),
    3: (*BASE, "symbols", "short_words", "long_words", "duplicate_lines"),
}
CURRENT = 3


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: r.mask for r in rules}
    return sum(known[n] for n in set(names))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    out = out.select("doc_id", "text", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"))
    n = F.size("words")
    # window i: words i, i + 1, i + 2; none where there are fewer than three words
    windows = F.when(n >= WINDOW, F.sort_array(F.arrays_zip(
        F.slice("words", 1, n - 2).alias("a"), F.slice("words", 2, n - 2).alias("b"), F.slice("words", 3, n - 2).alias("c"),
        F.sequence(F.lit(1), n - 2).alias("at"))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), lines.alias("lines"), windows.alias("windows"))

    def same(x: Column, i: Column) -> Column:
        other = F.get("windows", i)
        return (other["c"] == x["c"]) & (other["b"] == x["b"]) & (other["a"] == x["a"])
    again = F.filter("windows", lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
                     (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                     F.sort_array(F.transform(again, lambda x: x["at"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), lambda s, p: F.struct(
        (s["n"] + p + WINDOW - F.greatest(s["upto"], p)).alias("n"), (p + WINDOW).alias("upto")), lambda s: s["n"])
    return out.select("doc_id", *MEASURES[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, and ``failed``: the bits of the rules that the document breaks."""
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("every rule needs a bit of its own, from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(r.mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("failed", bits)


def judged(book: DataFrame, policy: tuple[str, ...] = POLICIES[CURRENT], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy, which always holds the base rules."""
    broken = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) != 0
    return book.withColumns({"base_failed": broken(BASE), "kept": ~broken((*BASE, *policy))})


def ablations(book: DataFrame, policy: tuple[str, ...] = POLICIES[CURRENT], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, kept by the policy and kept without the rule;
    ``any_document`` and ``every_document`` say whether the rule's bit is set in some or in all of them."""
    whole = mask_of(policy, rules)
    patterns = (book.select(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("failed")).groupBy("failed").agg(F.count("*").alias("n")))
    own = [r for r in rules if r.name in policy]
    columns = []
    for r in own:
        bit = F.lit(r.mask).cast("long")
        rest = F.col("failed").bitwiseAND(F.lit(whole & ~r.mask).cast("long"))
        count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        columns.append(F.struct(
            F.lit(r.name).alias("rule"), count(F.col("failed").bitwiseAND(bit) != 0).alias("fails"),
            count(F.col("failed") == bit).alias("fails_alone"), count(F.col("failed") == 0).alias("kept"),
            count(rest == 0).alias("kept_without"),
            (F.coalesce(F.bit_or("failed"), F.lit(0)).bitwiseAND(bit) != 0).alias("any_document"),
            (F.coalesce(F.bit_and("failed"), F.lit(0)).bitwiseAND(bit) != 0).alias("every_document")))
    return patterns.agg(F.array(*columns).alias("r")).select(F.inline("r"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(ledger(read_table(spark, sf_dir, "documents")))
