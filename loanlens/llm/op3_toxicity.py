"""Operator 3: toxicity by a classifier chain.

Categories, predicted in this order:

* ``abusive``: the text holds a term that marks toxic documents. Terms are the
  words and word beginnings that at least ``TERM_DOCS`` labelled documents hold,
  ``TERM_SHARE`` of them or more toxic, counted over all of them.
* ``toxic``: the label.
* ``severe``: labelled toxic and holding ``SEVERE_TERMS`` such terms or more.

Each link is a logistic regression on the text's features and on the
probabilities of the links before it. Training gives a later link the earlier
ones' out-of-fold predictions, from models that have not seen the document, so
it learns from probabilities as good as those it meets when it scores.

Features (words and beginnings of 3 to 7 letters, hashed to ``FEATURES``
numbers) are counted over all labelled documents where they are read, and the
``SELECTED`` with the largest log-odds by their error are kept; the models fit at
most ``MAX_TRAIN`` labelled documents (those with the smallest hashed ids). All
documents are scored where they are read.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out, for measuring: their
labels are never read.

Defined cases: null and empty texts have no features and get the intercepts'
probabilities; a row without doc_id is held out; several labels of a document
count by their mean (0.5 and above is 1), null labels not at all; a link whose
training rows are of one class gives that class's smoothed share; repeated rows get
equal results; of features with equal log-odds the smaller number is kept; a very
long text is read whole, in a slice of its own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import arrow_binary, pieces, read_table, tidied
from loanlens.llm.op4_quality import held_out

CATEGORIES = ("abusive", "toxic", "severe")
FEATURES, SELECTED, PREFIXES = 1 << 20, 2048, range(3, 8)
TERM_DOCS, TERM_SHARE, SEVERE_TERMS = 10, 0.9, 3
MAX_TRAIN = 20_000
FOLDS, STEPS, RATE, DECAY = 3, 120, 0.1, 1e-3
THRESHOLD = 0.5
PIECE_ROWS = 500

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Features(dict):
    """word -> numbers of its features, or their places among the selected ones."""

    LIMIT = 150_000

    def __init__(self, place: dict[int, int] | None = None):
        super().__init__()
        self.place = place

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        text = word.decode("utf-8", "replace")
        parts = ["=" + text, *("^" + text[:k] for k in PREFIXES if k <= len(text))]
        ids = [xxhash.xxh3_64_intdigest(p) % FEATURES for p in parts]
        out = self[word] = tuple(ids if self.place is None else (self.place[i] for i in ids if i in self.place))
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    raw, off = arrow_binary(batch.column(batch.schema.get_field_index("__text")))
    data = raw.tobytes().lower()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[a:b]


def _counts(text: bytes, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature numbers, how often each)."""
    flat = [i for w in _WORD.findall(text) for i in features[w]]
    return np.unique(np.array(flat, np.int64), return_counts=True)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature of the partition: documents of either class that hold it."""
    features, total = Features(), np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        for y, text in zip(batch.column(batch.schema.get_field_index("label")).to_pylist(), _texts(batch)):
            total[int(y), _counts(text, features)[0]] += 1
    seen = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], names=["feature", "clean", "toxic"])


@dataclass
class Selection:
    place: dict[int, int]           # feature number -> column
    term: np.ndarray                # of the columns: marks toxic documents


def select(known: DataFrame) -> Selection:
    n = known.groupBy("label").count().collect()
    size = {int(r.label): r["count"] for r in n}
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (size.get(1, 0) - F.col("toxic") + 0.5)) - F.log(b / (size.get(0, 0) - F.col("clean") + 0.5))
    weight = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    rows = (known.mapInArrow(tidied(_document_counts), "feature long, clean long, toxic long").groupBy("feature")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 3")
            .orderBy(weight.desc(), "feature").limit(SELECTED).collect())
    hold = np.array([r.clean + r.toxic for r in rows])
    share = np.array([r.toxic / (r.clean + r.toxic) for r in rows])
    return Selection({r.feature: j for j, r in enumerate(rows)}, (hold >= TERM_DOCS) & (share >= TERM_SHARE))


def _vectors(place) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(place.value)
        for batch in batches:
            found = [_counts(t, features) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("label")), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()),
                 pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], names=["label", "columns", "counts"])
    return run


@dataclass
class Rows:
    """Sparse rows: log(1 + count) of the selected features."""
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        size = [len(i) for i, _ in found]
        column = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.int64)
        count = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        return cls(np.repeat(np.arange(len(found)), size), column.astype(np.int64), np.log1p(count), len(found))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, miss: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * miss[self.row], width)

    def take(self, keep: np.ndarray) -> Rows:
        at, number = keep[self.row], np.cumsum(keep) - 1
        return Rows(number[self.row[at]], self.column[at], self.value[at], int(keep.sum()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Link:
    w: np.ndarray           # of the features
    u: np.ndarray           # of the earlier links' probabilities
    bias: float

    def probability(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.w) + earlier @ self.u + self.bias)


def fit_link(x: Rows, earlier: np.ndarray, y: np.ndarray) -> Link:
    width, k = SELECTED, earlier.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    p = np.r_[np.zeros(width + k), np.log(share / (1 - share))]
    if len(y) and y.min() != y.max():
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, STEPS + 1):
            miss = (_sigmoid(x.dot(p[:width]) + earlier @ p[width:-1] + p[-1]) - y) / len(y)
            g = np.r_[x.back(miss, width), earlier.T @ miss, miss.sum()]
            g[:-1] += DECAY / 10 * p[:-1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Link(p[:width], p[width:-1], float(p[-1]))


def fit_chain(x: Rows, targets: list[np.ndarray]) -> list[Link]:
    fold, earlier, chain = np.arange(x.n) % FOLDS, np.zeros((x.n, 0)), []
    for number, y in enumerate(targets):
        chain.append(fit_link(x, earlier, y))
        if number + 1 == len(targets):
            break
        out = np.zeros(x.n)
        for f in range(FOLDS):
            own = fold == f
            if own.any():
                out[own] = fit_link(x.take(~own), earlier[~own], y[~own]).probability(x.take(own), earlier[own])
        earlier = np.c_[earlier, out]
    return chain


def predict(chain: list[Link], x: Rows) -> np.ndarray:
    earlier = np.zeros((x.n, 0))
    for link in chain:
        earlier = np.c_[earlier, link.probability(x, earlier)]
    return earlier


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Selection, list[Link]]:
    sc = docs.sparkSession.sparkContext
    label = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
             .agg((F.avg("toxic") >= 0.5).cast("long").alias("label")).withColumnRenamed("doc_id", "__id"))
    texts = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("binary").alias("__text"))
    # labels grow with the documents: joined by a shuffle at any size
    chosen = select(texts.join(label.hint("merge"), F.col("__doc") == F.col("__id")).select("label", "__text"))
    # at most MAX_TRAIN rows of 16 bytes, so they can be broadcast
    few = label.orderBy(F.xxhash64("__id"), "__id").limit(MAX_TRAIN)
    rows = (texts.join(F.broadcast(few), F.col("__doc") == F.col("__id")).select("label", "__text")
            .mapInArrow(tidied(_vectors(sc.broadcast(chosen.place))), "label long, columns binary, counts binary").collect())
    rows = sorted((bytes(r["columns"]), bytes(r.counts), r.label) for r in rows)
    found = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(c, np.int32)) for i, c, _ in rows]
    toxic = np.array([y for *_, y in rows], np.float64)
    terms = np.array([c[chosen.term[i]].sum() for i, c in found], np.float64)
    order = np.random.default_rng(5).permutation(len(rows))
    targets = [terms > 0, toxic > 0, (toxic > 0) & (terms >= SEVERE_TERMS)]
    return chosen, fit_chain(Rows.of([found[i] for i in order]), [t[order].astype(np.float64) for t in targets])


def _score(place, chain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(place.value)
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_ROWS):
                p = predict(chain.value, Rows.of([_counts(t, features) for t in _texts(batch)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(len(CATEGORIES)))],
                                                 names=["doc_id", *(f"p_{c}" for c in CATEGORIES)])
    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, a probability of each category, toxic (that of ``toxic`` is THRESHOLD or more)."""
    chosen, chain = fit(docs, labels)
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__text")).mapInArrow(
        _score(sc.broadcast(chosen.place), sc.broadcast(chain)), "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *(f"p_{c}" for c in CATEGORIES),
                      (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
