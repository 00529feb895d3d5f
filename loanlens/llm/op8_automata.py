"""Operator 8: repeated phrases located by sharded Aho-Corasick automata.

``passages`` brings all windows of 20 words that share an anchor into one
shard. The shard confirms the windows that recur, compiles an automaton
(pyahocorasick, words as integers) of them, and streams all texts that hold one
of its anchors through it; a text without a recurring anchor holds no recurring
window. Each match is an occurrence; the first one in (doc_id, start) order
stays, the others are removed.

Defined cases: null text has no words; documents below 20 words have no
windows; rows with a null ``doc_id`` count as one document after all others;
rows with the same ``doc_id`` count as one document in which equal starts stay;
a very long text is in one block, whose memory grows with it; an empty table
gives an empty result; other columns are ignored (``dedup``
carries them).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import passages
from loanlens.llm.common import gram_hashes, mix, read_table

WINDOW_WORDS = 20
GRAM = 8
BLOCK_BYTES = 4 << 20
SHARD_WINDOWS = 25_000


def confirmed(shard: passages.Shard, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places in ``symbols`` of one window of each that stands in more than one place."""
    windows = shard.windows.astype(np.int64)
    at = np.repeat(begins, windows) + passages._ramp(windows)
    if not len(at):
        return at
    hashed = gram_hashes(symbols, WINDOW_WORDS)[at]
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    places = np.bincount(number, 1 + np.repeat(shard.recurs, windows))
    return at[first[places > 1]]


def automaton(phrases: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, phrase in enumerate(phrases):
        a.add_word(phrase, number)
    a.make_automaton()
    return a


def phrase_spans(shard: passages.Shard):
    """Finder: each occurrence of each confirmed window, runs of them with one first occurrence merged."""
    size = np.array([len(t) // 8 for t in shard.texts], np.int64)
    symbols = np.frombuffer(b"".join(shard.texts), np.uint64)
    begins = np.cumsum(size) - size
    places = confirmed(shard, symbols, begins)
    if not len(places):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, np.zeros(0, np.uint64)
    dense = np.unique(symbols, return_inverse=True)[1].tolist()
    machine = automaton([tuple(dense[p:p + WINDOW_WORDS]) for p in places.tolist()])
    item, at, number = [], [], []
    for i, (a, n) in enumerate(zip(begins.tolist(), size.tolist())):
        for stop, k in machine.iter(tuple(dense[a:a + n])):
            item.append(i)
            at.append(stop - WINDOW_WORDS + 1)
            number.append(k)
    item, at, number = (np.array(x, np.int64) for x in (item, at, number))
    doc, start = shard.first_doc[item], shard.first_start[item] + at
    order = np.lexsort((start, doc, number))
    head = order[np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])]
    doc, start = doc[head][number], start[head][number]
    # consecutive windows of a context whose first occurrences are consecutive too
    new = np.r_[True, (np.diff(item) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(start) != 1)]
    lo = np.flatnonzero(new)
    run = np.diff(np.r_[lo, len(item)])
    rid = mix(doc[lo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[lo].astype(np.uint64))
    return item[lo], at[lo], run + WINDOW_WORDS - 1, doc[lo], start[lo], rid


SPEC = passages.Spec(unit="word", length=WINDOW_WORDS, gram=GRAM, by_start=True)


def _find(docs: DataFrame, output: str, keep_row: bool = False) -> DataFrame:
    return passages.find(docs, SPEC, phrase_spans, output=output, block_bytes=BLOCK_BYTES, shard_windows=SHARD_WINDOWS,
                         keep_row=keep_row)


def phrase_occurrences(docs: DataFrame) -> DataFrame:
    """Every occurrence of every recurring passage: repeat_id (of its first place), doc_id, start and length in words."""
    return _find(docs, "repeats")


def removal_report(docs: DataFrame) -> DataFrame:
    """Words of each document that a window covers which starts earlier elsewhere."""
    return _find(docs, "report").select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with those words removed from ``text``, the kept words joined by one space; a null text stays null."""
    done = _find(docs, "report", keep_row=True)
    return done.select(*(
        F.when(~F.col("__row.no_text"), F.col("kept")).alias(c) if c == "text" else F.col("__row.rest")[c].alias(c)
        for c in docs.columns))


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
