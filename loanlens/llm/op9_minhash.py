"""Operator 9: near duplicates by one-permutation hashing.

Each text's set of 5-word shingles is hashed once; the hash range is cut into
bins and each bin keeps its minimum. Empty bins take the value of another bin
by optimal densification: bin i tries the bins hash(i, 1), hash(i, 2), ...
until one is filled, the same sequence for every document. Bands of bins are
buckets. A bucket proposes a star: its most central document (the one that shares
most buckets with others) against the rest, so the pairs grow with the rows and not with their square.

Proposed pairs are confirmed on the full sets. Two members of a bucket that are
both not linked to its centre can still be linked to each other; ``_unstarred``
finds all such pairs exactly, by the shingles in which they differ from the
centre. So no link is lost because a star's centre was not linked; only a pair
that shares none of the bands is (at the threshold itself about 1 in 700
million at 0.85 and 8 in a million at 0.8, see ``miss_probability``).

Texts with equal sets are one node from the start; copies are never paired.

Defined cases: a null or blank text has the empty set and is linked with
nothing; a very long text's set is hashed whole, in a slice of its own; rows with the same ``doc_id`` are one document that has the links of
all its texts; a row without ``doc_id`` cannot be named as a component, is
linked with nothing and kept; an empty table gives an empty result; other
columns are ignored (``dedup`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import WordHashes, arrow_binary, gram_hashes, materialized, mix, pieces, read_table, tidied
from loanlens.llm.components import components

SHINGLE = 5
PERCENT = 85                    # linked from this Jaccard similarity, in hundredths
NEAR_PERCENT = 80               # the same in the pipeline
BANDS, ROWS = 64, 8
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 1000                    # documents signed at a time


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of that similarity share no band."""
    return (1 - similarity ** rows) ** bands


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles (a shorter text: of all its words)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    symbols = hashes.array(words)
    return np.unique(gram_hashes(symbols, min(SHINGLE, len(words))))


def densified(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures, a row for each non-empty set."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    at = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    cell = doc * bins + at
    first = np.r_[True, cell[1:] != cell[:-1]]          # sets are sorted: the first of a bin is its minimum
    own = np.full(len(sets) * bins, EMPTY)
    own[cell[first]] = h[first]
    filled = np.zeros(len(own), bool)
    filled[cell[first]] = True
    out, rest, attempt = own.copy(), np.flatnonzero(~filled), 0
    every = np.arange(bins, dtype=np.uint64)
    while len(rest):
        attempt += 1
        to = (mix(every * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        source = rest - rest % bins + to[rest % bins]
        ok = filled[source]
        out[rest[ok]] = own[source[ok]]
        rest = rest[~ok]
    return out.reshape(len(sets), bins)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signatures), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(signatures), band + 1, np.uint64)
        for j in range(rows):
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + signatures[:, band * rows + j])
        out[:, band] = h
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    raw, off = arrow_binary(batch.column(1))
    data = raw.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[a:b]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for batch in pieces(whole, 1, PIECE):
            sets = [shingles(t, hashes) for t in _texts(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), BANDS), np.uint64)
            if full:
                keys[full] = band_keys(densified([sets[i] for i in full], BANDS * ROWS), BANDS, ROWS)
            n = np.array([len(s) for s in sets], np.int64)
            flat = pa.array(keys.ravel().view(np.int64))
            identity = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(identity[:, 0]), pa.array(identity[:, 1]),
                 pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, flat)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for batch in pieces(whole, 1, PIECE):
            sets = [shingles(t, hashes) for t in _texts(batch)]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))], names=["node", "shingles"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    b = sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    return (pairs.join(a, "x").join(b, "y").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.size("sx") + F.size("sy") - F.col("both")))
            .select("x", "y").distinct())


def _sized(percent: int, a: str, b: str) -> F.Column:
    """Sets of such sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _unstarred(families: DataFrame, links: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of a family (the members of a centre's buckets) across components, which the star has not found.

    With D = the shingles in which a member and the centre differ, members x and y differ in
    |Dx| + |Dy| - 2 |Dx & Dy| shingles; linked ones in at most k (|x| + |y|), k = (100 - percent) / (100 + percent).
    A member far from the centre (not linked to it) has |Dy| > k (|y| + |centre|). So x and a far y have at least
    c(x) = (|Dx| - k (|x| - |centre|)) / 2 differing shingles in common, of those that two members or more have (S); in any
    one order, one of them is among the first |S| - c + 1 of x's, and of y's if x is far too. The order is the rarest
    first, and edits seldom meet, so few pairs do, also in a large family of copies of one text. The sizes of D and the
    shared S give the similarity of the full sets exactly. Members linked to the centre need no pair among themselves,
    and those of one size that differ from it alike in S are linked to the same far ones: one stands for all.
    """
    k = (100 - percent) / (100 + percent)
    linked = links.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.lit(True).alias("near"))
    known = (families.withColumn("lx", F.least("centre", "node")).withColumn("ly", F.greatest("centre", "node"))
             .join(linked, ["lx", "ly"], "left").join(label, "node", "left")
             .select("centre", "m", "node", "n", F.coalesce("near", F.lit(False)).alias("near"),
                     F.coalesce("component", "node").alias("component")))
    open_ = known.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    known = known.join(open_.select("centre"), "centre", "left_semi")
    apart = F.concat(F.array_except("sn", "sc"), F.array_except("sc", "sn"))
    member = ["centre", "m", "node", "n", "near", "component", "d"]
    tokens = materialized(
        known.join(sets.select("node", F.col("shingles").alias("sn")), "node")
        .join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("sc")), "centre")
        .select(*member[:-1], apart.alias("apart")).select(*member[:-1], F.size("apart").alias("d"), F.explode("apart").alias("token")), narrow=True)
    often = tokens.groupBy("centre", "token").agg(F.count("*").alias("often")).where("often > 1")
    shared = tokens.join(often, ["centre", "token"]).groupBy(*member).agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("s"))
    least = F.greatest(F.ceil((F.col("d") - k * (F.col("n") - F.col("m"))) / 2 - 1e-9), F.lit(1)).cast("int")
    shared = shared.select(*member, F.col("s.token").alias("s"), least.alias("c"))
    near = shared.where("near").groupBy("centre", "m", "n", "near", "component", "d", "s", "c").agg(F.min("node").alias("node"))
    # a member shares at least |D| - k (|x| + |y|) with any partner, whose size the threshold bounds
    most = k * (1 + 100 / percent)
    far = shared.where("NOT near").where(F.size("s") >= F.col("d") - most * F.col("n") - 1e-9)
    rows = materialized(near.where("size(s) >= c").unionByName(far)
                        .select("centre", "node", "n", "near", "component", "d", "s", "c", F.posexplode("s").alias("at", "token"))
                        .withColumn("short", F.col("at") <= F.size("s") - F.col("c")))
    a = rows.where("short").select("centre", "token", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "near", "component", "d", "s")))
    b = rows.where("NOT near")
    differ = F.col("d") + F.col("d_a") - 2 * F.size(F.array_intersect("s", "s_a"))
    both, either = F.col("n") + F.col("n_a") - differ, F.col("n") + F.col("n_a") + differ          # twice the sizes
    return (a.join(b, ["centre", "token"]).where(
        (F.col("component") != F.col("component_a")) & (F.col("near_a") | (F.col("short") & (F.col("node_a") < F.col("node"))))
        & _sized(percent, "n", "n_a") & (100 * both >= percent * either))
        .select(F.least("node", "node_a").alias("x"), F.greatest("node", "node_a").alias("y")).distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialized(source.mapInArrow(tidied(_sign), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    nodes = materialized(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")))

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    placed = materialized(banded.join(sizes.hint("merge"), "bucket"), narrow=True)
    # the member that meets most others: the text that the others are copies of
    score = placed.groupBy("node").agg(F.sum("size").alias("score"))
    members = materialized(placed.select("bucket", "node").join(score, "node").join(nodes.select("node", "n"), "node"), narrow=True)
    chosen = members.groupBy("bucket").agg(F.min(F.struct(-F.col("score"), "node", "n")).alias("c")).select(
        "bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("m"))
    chosen = materialized(chosen, narrow=True)
    candidates = members.select(F.col("node").alias("doc_id")).distinct()
    # by a shuffle at any size: the number of candidates grows with the documents
    sets = materialized(source.join(candidates.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
                        .mapInArrow(tidied(_full_sets), "node long, shingles array<long>"))

    families = materialized(members.join(chosen, "bucket").where("node != centre").select("centre", "m", "node", "n").distinct(), narrow=True)
    pairs = families.where(_sized(percent, "n", "m")).select(F.least("centre", "node").alias("x"), F.greatest("centre", "node").alias("y"))
    # one id with several texts is one document
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_a", "set_b").distinct()
    own = named.join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("doc_id", "node").distinct()
    several = own.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("z")).where("x < z")
    links = materialized(_linked(pairs, sets, percent).union(
        own.join(several.select("doc_id", "x"), "doc_id").select("x", F.col("node").alias("y")).where("x < y")), narrow=True)
    label = components(links)
    rest = materialized(_unstarred(families, links, label, sets, percent), narrow=True)
    if not rest.isEmpty():
        label = components(label.select(F.col("node").alias("x"), F.col("component").alias("y")).union(rest))
    of_set = nodes.select("set_a", "set_b", "node").join(label, "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("c"))
    done = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(materialized(of_set), ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.least("c", "doc_id")).otherwise(F.col("doc_id"))
    return done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id.

    Of rows with the same doc_id the one with the smallest text stays; rows without doc_id stay.
    """
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    row = F.struct(*docs.columns).alias("__row")
    turn = F.row_number().over(Window.partitionBy("__id").orderBy(F.col("__row.text").asc_nulls_last()))
    named = (docs.select(F.col("doc_id").alias("__id"), row).join(kept.hint("merge"), F.col("__id") == F.col("__kept"), "left_semi")
             .withColumn("__turn", turn).where("__turn = 1").select("__row.*"))
    return named.union(docs.where("doc_id IS NULL"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
