"""Operator 6: maximal repeats of the corpus from common-prefix interval trees.

``passages`` brings all windows of 50 bytes that share an anchor into one
shard. A shard builds an enhanced suffix array (suffixes sorted, common
prefixes of neighbours) over its distinct contexts and scans it once with a
stack, which visits the tree of common-prefix intervals bottom-up. An interval
is a repeat group: all suffixes in it, not just neighbours, start with the
same bytes. It is kept if its occurrences are left-diverse: preceded by
different bytes, or standing at the edge of a context, where the byte before
belongs to another anchor. A group that is not left-diverse has the same
occurrences as its extension to the left, which is visited too.

A repeat longer than a context (80 bytes at most) is found as overlapping groups,
one for each anchor on it; their union is the whole repeat. ``maximal_repeats``
joins those that overlap and have the same occurrences; a long repeat stays in
parts where a part of more than one context also stands elsewhere without the rest.
It reports repeats within one document too; the removal, by documents, needs neither.

Defined cases: null text is empty; empty texts and texts below the length have
no repeats; rows with a null ``doc_id`` count as one document after all
others; rows with the same ``doc_id`` count as one document; a very long text is in
one block, whose memory grows with it; an empty table
gives an empty result; other columns are ignored (``dedup`` carries them).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm import passages
from loanlens.llm.common import materialized, read_table

MIN_BYTES = 50
GRAM = 20
BLOCK_BYTES = 4 << 20
SHARD_WINDOWS = 100_000


def interval_groups(lcp: list[int], left: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """Left-diverse intervals with a common prefix of ``least`` or more: (length, first, last).

    ``lcp[i]`` is of the suffixes i-1 and i; ``left[i]`` is the byte before
    suffix i, or -1 at an edge, which differs from every byte.
    """
    length, first, last = [], [], []
    stack: list[list[int]] = []          # [common prefix, first suffix, left byte if they all have it, else -1]
    n = len(left)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        lo, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            depth, lo, seen = stack.pop()
            byte = seen if seen == byte else -1
            if byte == -1:
                length.append(depth)
                first.append(lo)
                last.append(i - 1)
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != byte:
                    stack[-1][2] = -1
            else:
                stack.append([now, lo, byte])
    return length, first, last


def suffix_array(texts: list[bytes], windows: np.ndarray):
    """Sorted suffixes that start a window: (rows of bytes, lengths, context, offset, byte before)."""
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size
    width = int(-(-size.max() // 8) * 8)
    buf = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    counts = windows.astype(np.int64)
    ctx = np.repeat(np.arange(len(texts)), counts)
    at = passages._ramp(counts)
    start, length = base[ctx] + at, size[ctx] - at
    rows = np.lib.stride_tricks.sliding_window_view(buf, width)[start]
    rows[np.arange(width) >= length[:, None]] = 0
    order = rows.view(f"S{width}").ravel().argsort(kind="stable")
    left = np.where(at > 0, buf[np.maximum(start - 1, 0)].astype(np.int64), -1)
    return rows[order], length[order], ctx[order], at[order], left[order]


def common_prefixes(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[0, np.minimum(lcp, np.minimum(length[1:], length[:-1]))]


def repeat_spans(shard: passages.Shard):
    """Finder: each occurrence of each maximal repeat, with the smallest document of the group."""
    rows, length, ctx, at, left = suffix_array(shard.texts, shard.windows)
    lcp = common_prefixes(rows, length)
    size, first, last = (np.array(x, np.int64) for x in interval_groups(lcp.tolist(), left.tolist(), MIN_BYTES))
    doc = np.r_[shard.first_doc[ctx], np.iinfo(np.int64).max]
    least = np.minimum.reduceat(doc, np.stack([first, last + 1], 1).ravel())[::2] if len(first) else first
    rid = np.array([xxhash.xxh3_64_intdigest(rows[i, :n].tobytes()) for i, n in zip(first.tolist(), size.tolist())], np.uint64)
    count = last - first + 1
    suffix = np.repeat(first, count) + passages._ramp(count)
    # a context that stands in several documents is a group by itself
    own = np.flatnonzero(shard.recurs)
    item = np.r_[ctx[suffix], own]
    return (item, np.r_[at[suffix], np.zeros(len(own), np.int64)],
            np.r_[np.repeat(size, count), np.array([len(shard.texts[i]) for i in own.tolist()], np.int64)],
            np.r_[np.repeat(least, count), shard.first_doc[own]], np.zeros(len(item), np.int64),
            np.r_[np.repeat(rid, count), np.array([xxhash.xxh3_64_intdigest(shard.texts[i]) for i in own.tolist()], np.uint64)])


SPEC = passages.Spec(unit="byte", length=MIN_BYTES, gram=GRAM, by_start=False)
#: For the repeats themselves, also within one document.
WITHIN = passages.Spec(unit="byte", length=MIN_BYTES, gram=GRAM, by_start=True)


def _find(docs: DataFrame, output: str, keep_row: bool = False) -> DataFrame:
    return passages.find(docs, WITHIN if output == "repeats" else SPEC, repeat_spans, output=output, block_bytes=BLOCK_BYTES, shard_windows=SHARD_WINDOWS,
                         keep_row=keep_row)


def joined(rows: DataFrame) -> DataFrame:
    """Overlapping groups with the same occurrences, moved by one distance, as one group."""
    group = ["repeat_id", "length"]
    first = rows.groupBy(*group).agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count("*").alias("n"))
    moved = F.col("start") - F.col("first.start")
    # equal for groups that are the same places, moved: their first place's document, their number, hashes of all
    sets = rows.join(first, group).groupBy(*group, "first", "n").agg(
        F.bit_xor(F.xxhash64("doc_id", "row", moved)).alias("set_a"), F.bit_xor(F.xxhash64(moved, "row", "doc_id", F.lit(1))).alias("set_b"))
    sets = sets.select(*group, "n", "set_a", "set_b", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("row"),
                       F.col("first.start").alias("start"), (F.col("first.start") + F.col("length")).alias("stop"))
    same = ["doc", "row", "n", "set_a", "set_b"]
    order = Window.partitionBy(*same).orderBy("start", F.desc("stop"), "repeat_id")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chains = sets.withColumn("new", F.when(F.col("start") < reached, 0).otherwise(1)).withColumn(
        "chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chains.groupBy(*same, "chain").agg(
        F.min(F.struct("start", (-F.col("length")).alias("shorter"), *group)).alias("head"), F.max("stop").alias("stop"),
        F.array_sort(F.collect_list(F.struct("start", *group))).alias("parts"))
    parts = F.transform("parts", lambda p: F.struct((p["start"] - F.col("head.start")).alias("at"), p["repeat_id"].alias("id")))
    whole = whole.select(F.col("head.repeat_id").alias("repeat_id"), F.col("head.length").alias("length"),
                         F.when(F.size("parts") > 1, F.xxhash64(parts)).otherwise(F.col("head.repeat_id")).alias("id"),
                         (F.col("stop") - F.col("head.start")).alias("size"))
    return rows.join(whole, group).select(F.col("id").alias("repeat_id"), "doc_id", "start", F.col("size").alias("length"))


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """Every occurrence of every repeat group: repeat_id, doc_id, start and length in bytes."""
    return joined(materialized(_find(docs, "repeats").distinct()))


def removal_report(docs: DataFrame) -> DataFrame:
    """Bytes of each document that a repeat with an occurrence in a smaller doc_id covers."""
    return _find(docs, "report").select(
        "doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with those bytes removed from ``text`` (cut characters go); a null text stays null."""
    done = _find(docs, "report", keep_row=True)
    return done.select(*(
        F.when(~F.col("__row.no_text"), F.col("kept")).alias(c) if c == "text" else F.col("__row.rest")[c].alias(c)
        for c in docs.columns))


def op6_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
