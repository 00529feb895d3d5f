"""Operator 12: audit of how removal filters interact, by Lehmer ranks and difference arrays.

Five filters are applied in every order. Which of them a document fails is a mask
of five bits, and all that the audit asks depends on the mask alone:

1. Masks. Four filters look at the text, in the document's row. The fifth, whether
   a smaller doc_id has the same text, needs the smallest doc_id of every text: a
   grouped minimum over digests, joined back by digest. Only digests, masks and
   labels are shuffled, never texts; the minimum is combined before the shuffle, and
   stored (for texts that stand twice or more), so both sides of the join are plain
   exchanges and AQE can split a hot text.
2. Counts of (part, mask): 32 rows a part at most.
3. Difference arrays. The orders that share a prefix have neighbouring
   lexicographic ranks (Lehmer codes). A document leaves at step s where the s-th
   filter is the first of the order in its mask, so each mask and step owns a few
   rank intervals. The counts are added at an interval's start and taken off at its
   end; the running sum over the 120 ranks is what each order removes at each step.

Parts are dealt over tasks; a task holds 32 counts and 600 result rows of a part.

Defined cases: null texts are empty, and identical to other empty ones; a null
doc_id stands behind all others, so such a row is a duplicate of any named one
with its text, never of another unnamed one; rows of one id and text are not
duplicates of each other; a null source is the part ''; several labels of a
document count if any of them is 1, null labels not at all; a very long text is
judged whole in its row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import NULL_ID, materialized, read_table

LETTERS = "ABCDE"
STEPS = len(LETTERS)
ORDERS = math.factorial(STEPS)
MASKS = 1 << STEPS
SPACE = r"[\x20\x09-\x0D]"


def intervals(steps: int = STEPS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): the orders in which a document of that mask leaves at that step.

    Intervals of one mask and step that touch are one.
    """
    out: dict[tuple[int, int], list[list[int]]] = {}

    def extend(prefix: tuple[int, ...], lo: int) -> None:
        rest = [f for f in range(steps) if f not in prefix]
        width = math.factorial(len(rest) - 1)
        passed = sum(1 << f for f in prefix)
        for code, f in enumerate(rest):                 # the next digit of the Lehmer code
            first = lo + code * width
            for mask in range(1 << steps):
                if mask >> f & 1 and not mask & passed:
                    own = out.setdefault((mask, len(prefix)), [])
                    if own and own[-1][1] == first:
                        own[-1][1] = first + width
                    else:
                        own.append([first, first + width])
            if len(rest) > 1:
                extend((*prefix, f), first)
    extend((), 0)
    return sorted((mask, step, lo, hi) for (mask, step), found in out.items() for lo, hi in found)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each row of ``docs``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", f"{SPACE}+"), "")
    rows = rows.select("id", "part", "text", words.alias("words"))
    fails = (F.size("words") < 50,
             100 * F.size(F.array_distinct("words")) < 65 * F.size("words"),
             100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long"),
             F.col("text").rlike(r"[#$%&*|]"))
    bits = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    rows = rows.select("id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = materialized(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), narrow=True)
    rows = rows.join(first, "digest", "left").select(
        "id", "part", (F.col("bits") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
             .where("id IS NOT NULL").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic")))
    no = F.lit(False)
    return rows.join(marks, "id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows for each part from its counts by mask."""
    names = list(permutations(range(STEPS)))
    filter_at = np.array(names)                                         # rank, step
    owned = intervals()
    fails = np.array([[m >> f & 1 for f in range(STEPS)] for m in range(MASKS)])
    for whole in batches:
        for lo in range(0, whole.num_rows, 64):
            batch = whole.slice(lo, 64)
            n = batch.num_rows
            counts = np.zeros((3, n, MASKS), np.int64)                  # documents, good ones, toxic ones
            for p, cells in enumerate(batch.column(1).to_pylist()):
                for c in cells:
                    counts[:, p, c["mask"]] += (c["n"], c["good"], c["toxic"])
            ends = np.zeros((3, n, STEPS, ORDERS + 1), np.int64)
            for mask, step, first, behind in owned:
                ends[:, :, step, first] += counts[:, :, mask]
                ends[:, :, step, behind] -= counts[:, :, mask]
            removed, good, toxic = ends.cumsum(axis=3)[..., :ORDERS].transpose(0, 1, 3, 2)     # part, rank, step
            total = counts[0].sum(axis=1)[:, None, None]
            kept = total - removed.cumsum(axis=2)
            failing = (counts[0] @ fails)[:, filter_at]
            alone = counts[0][:, 1 << np.arange(STEPS)][:, filter_at]
            every = np.zeros((n, STEPS), np.int64)
            np.add.at(every, (slice(None), filter_at), removed)
            columns = (kept, removed, failing - removed, alone, good, toxic, every[:, filter_at])
            order = pa.array(["".join(LETTERS[f] for f in x) for x in names]).take(pa.array(np.tile(np.repeat(np.arange(ORDERS), STEPS), n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), ORDERS * STEPS))), order,
                 pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), n * ORDERS)), *(pa.array(x.ravel()) for x in columns)],
                names=["part", "filter_order", "step", *COUNTS])


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and the counts of that step; 600 rows a part."""
    as_one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    cells = masks(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), as_one("good"), as_one("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))     # 32 at most
    return parts.mapInArrow(_swept, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
