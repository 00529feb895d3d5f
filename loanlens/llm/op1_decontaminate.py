"""Operator 1: benchmark decontamination with an FM-index per training shard.

A shard is a slice of an Arrow batch. Its documents become sequences over the
words of the benchmark; a word that no item has cannot be in a phrase, so it
only ends a segment, and segments shorter than the shortest phrase are left
out. An FM-index of the segments answers all phrases (windows of 13 item words)
by backward search through wavelet ranks, finds the occurrences by sampled
suffix positions, and merges them to spans of words.

The corpus is not shuffled. The benchmark goes to the tasks in blocks of
bounded size, one step of the same task for each block: every step holds its block's
windows in a worker of its own, so time and memory grow with the benchmark's blocks.

Defined cases: null text has no words; an item with no words has no window; an
item shorter than a window is one window; items with one ``item_id`` are one
item, and an item without id is named by the empty string; an empty benchmark
hits nothing; an empty table gives an empty result; documents are judged row by
row, so repeated rows get equal results; a very long text is indexed whole, in a shard
of its own; other columns are ignored
(``decontaminate`` carries them).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import arrow_binary, read_table, sha256_hex, tidied
from loanlens.llm.fm_index import FMIndex

WINDOW = 13
PERCENT_HIT = 5                     # contaminated from this share of hit words
BLOCK_BYTES = 16 << 20              # benchmark text in one broadcast
SHARD_SYMBOLS = 500_000             # words of the benchmark's vocabulary in one index
SHARD_DOCS = 4000

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_WORD).split()


class Phrases:
    """The windows of some items, by length, over the vocabulary 1.. of these items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                k = number.setdefault(tuple(ids[i:i + window]), len(number))
                if k == len(owners):
                    owners.append(set())
                owners[k].add(name)
        self.owners = owners
        self.by_length = {}
        for length, group in itertools.groupby(sorted(number.items(), key=lambda x: len(x[0])), lambda x: len(x[0])):
            rows = list(group)
            self.by_length[length] = np.array([p for p, _ in rows], np.int64), np.array([k for _, k in rows], np.int64)
        self.shortest = min(self.by_length, default=0)


def occurrences(phrases: Phrases, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(document, first word, words, phrase) of every occurrence in documents of vocabulary numbers (0: none)."""
    size = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([np.r_[d, 0] for d in docs]) if docs else np.zeros(0, np.int64)
    known = np.r_[False, flat != 0, False]
    lo, hi = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long = hi - lo >= phrases.shortest
    lo, count = lo[long], (hi - lo)[long] + 1             # with the 0 behind
    none = np.zeros(0, np.int64)
    if not len(lo):
        return none, none, none, none
    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    index = FMIndex(np.r_[0, flat[at]], len(phrases.vocabulary))
    place = np.r_[-1, at]
    found = []
    for length, (rows, numbers) in phrases.by_length.items():
        a, b = index.search(rows)
        n = b - a
        suffix = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pos = place[index.locate(suffix)]
        found.append((pos, np.full(len(pos), length), np.repeat(numbers, n)))
    pos, length, number = (np.concatenate(x) for x in zip(*found))
    begin = np.cumsum(size + 1) - (size + 1)
    doc = np.searchsorted(begin, pos, side="right") - 1
    return doc, pos - begin[doc], length, number


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, merged spans (first word, end)."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FOUND = T.StructType([T.StructField("n_words", T.LongType()),
                       T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                       T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _scan(items, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items.value, window)
        get = phrases.vocabulary.get
        for batch in batches:
            raw, off = arrow_binary(batch.column(batch.schema.get_field_index("__text")))
            data, found, shard, load = raw.tobytes(), [], [], 0
            before = batch.column(batch.schema.get_field_index("__found")).to_pylist()
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                words = words_of(data[a:b])
                shard.append(np.fromiter(map(get, words, itertools.repeat(0)), np.int64, len(words)))
                load += int(np.count_nonzero(shard[-1]))
                if load >= SHARD_SYMBOLS or len(shard) == SHARD_DOCS or i + 1 == batch.num_rows:
                    found += _found(phrases, shard)
                    shard, load = [], 0
            for old, new in zip(before, found):
                if old is not None:
                    new["spans"] = merged([*map(tuple, old["spans"]), *new["spans"]])
                    new["items"] = sorted({*old["items"], *new["items"]})
            yield pa.RecordBatch.from_arrays(
                [batch.column(j) if n != "__found" else pa.array(found, _FOUND_ARROW) for j, n in enumerate(batch.schema.names)],
                names=batch.schema.names)
    return run


def _found(phrases: Phrases, docs: list[np.ndarray]) -> list[dict]:
    out = [{"n_words": len(d), "spans": [], "items": []} for d in docs]
    doc, first, length, number = occurrences(phrases, docs)
    order = np.argsort(doc, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(doc[order]) != 0]) if len(doc) else order
    for part in np.split(order, cut[1:]) if len(doc) else []:
        own = out[int(doc[part[0]])]
        own["spans"] = merged(list(zip(first[part].tolist(), (first[part] + length[part]).tolist())))
        own["items"] = sorted(set().union(*(phrases.owners[k] for k in set(number[part].tolist()))))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of about ``block_bytes``, each fetched by itself."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
                             F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for k in range(max(1, n)):
        part = items if n <= 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r.name, bytes(r.text)) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, percent: int = PERCENT_HIT,
                  keep_row: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges), items."""
    sc = docs.sparkSession.sparkContext
    carried = F.struct(*docs.columns) if keep_row else F.struct("doc_id")
    rows = docs.select(carried.alias("__row"), F.col("text").cast("binary").alias("__text"), F.lit(None).cast(_FOUND).alias("__found"))
    for items in _blocks(benchmark, block_bytes):
        rows = rows.mapInArrow(tidied(_scan(sc.broadcast(items), window)), rows.schema)
    n_hit = F.aggregate("__found.spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    out = rows.select(
        "__row", F.col("__row.doc_id").alias("doc_id"), F.col("__found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("__found.items").cast("long").alias("n_items"),
        sha256_hex(F.array_join(F.array_sort("__found.items"), ",")).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("__found.n_words"))).alias("contaminated"),
        F.col("__found.spans").alias("spans"))
    return out if keep_row else out.drop("__row")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return contamination(docs, benchmark, keep_row=True).where("NOT contaminated").select("__row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
