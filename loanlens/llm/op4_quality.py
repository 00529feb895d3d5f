"""Operator 4: quality classifier on random-indexing word vectors.

1. Word vectors, from all texts: every token (a run of letters and digits, or of
   other signs) falls in one of ``BUCKETS`` hashed buckets; each bucket has a
   fixed sparse index vector of signs, and the context vector of a bucket is the
   sum of the index vectors around its occurrences. Tasks sum in place and send
   one row for each bucket they have seen; integer sums do not depend on order.
   The table has a fixed size whatever the corpus.
2. A document is pooled to the mean and the spread of its word vectors, and the
   mean product of neighbouring ones (high where words repeat).
3. A network with one hidden layer, in numpy, learns ``labels.quality`` from at
   most ``MAX_TRAIN`` labelled documents (those with the smallest hashed ids);
   a part of them that training has not seen sets the temperature that divides
   the logits.
4. All documents are scored where they are read.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are
never read. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts pool to zeros and are scored; a row without
doc_id is held out; several labels of a document count by their mean (0.5 and
above is 1), null labels not at all; without two classes of labels every score
is the share of ones (1 without any label); an empty table gives an empty
result; repeated rows are scored each, and equal texts alike; a very long text is
pooled in chunks of CHUNK tokens; other columns are ignored, whatever their names
(``keep_good`` carries them). The table of buckets does not grow with the corpus:
words that share a bucket share a vector.
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
from pyspark.sql import types as T

from loanlens.llm.common import arrow_binary, mix, pieces, read_table, tidied

BUCKETS, DIM, SIGNS, REACH = 1 << 14, 32, 2, 2
FEATURES = 3 * DIM
CHUNK = 1 << 16                     # tokens whose vectors are held at a time
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
MAX_TRAIN = 20_000
CALIBRATION_SHARE = 5               # one in so many training documents sets the temperature
THRESHOLD = 0.7
PIECE_ROWS, PIECE_BYTES = 500, 1 << 20
SEED = 11

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x7f-\xff]+")


class Buckets(dict):
    LIMIT = 250_000

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        b = self[token] = xxhash.xxh3_64_intdigest(token.lower(), SEED) % BUCKETS
        return b


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the SIGNS entries of each bucket's index vector."""
    h = mix(np.arange(BUCKETS * SIGNS, dtype=np.uint64) + np.uint64(SEED << 32)).reshape(BUCKETS, SIGNS)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _tokens(batch: pa.RecordBatch, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token of the batch's texts, number of tokens of each text)."""
    raw, off = arrow_binary(batch.column(batch.schema.get_field_index("__text")))
    data, parts = raw.tobytes(), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        found = _TOKEN.findall(data[a:b])
        parts.append(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(p) for p in parts], np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of the partition: a row for each bucket that it holds."""
    buckets, total, count = Buckets(), np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
    at, sign = index_vectors()
    for whole in batches:
        for batch in pieces(whole, 0, PIECE_ROWS, PIECE_BYTES):
            ids, size = _tokens(batch, buckets)
            doc = np.repeat(np.arange(len(size)), size)
            count += np.bincount(ids, minlength=BUCKETS)
            for gap in range(1, REACH + 1):
                same = np.flatnonzero(doc[gap:] == doc[:-gap])
                left, right = ids[same], ids[same + gap]
                for own, near in ((left, right), (right, left)):
                    for j in range(SIGNS):
                        total += np.bincount(own * DIM + at[near, j], sign[near, j], BUCKETS * DIM)
    seen = np.flatnonzero(count)
    table = total.reshape(BUCKETS, DIM).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen, pa.int64()), pa.array(count[seen]), *(pa.array(table[seen, j]) for j in range(DIM))],
        names=["bucket", "n", *(f"v{j}" for j in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vector of each bucket, less the corpus mean; BUCKETS x DIM whatever the corpus."""
    dims = [f"v{j}" for j in range(DIM)]
    rows = (docs.select(F.col("text").cast("binary").alias("__text"))
            .mapInArrow(tidied(_gather), "bucket long, n long, " + ", ".join(f"{d} long" for d in dims))
            .groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(d).alias(d) for d in dims)).collect())
    table = np.zeros((BUCKETS, DIM))
    n = np.zeros(BUCKETS)
    for r in rows:
        n[r[0]], table[r[0]] = r[1], r[2:]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    table -= (n[:, None] * table).sum(0) / max(1.0, n.sum())
    return table.astype(np.float32)


def _chunks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Token ranges of whole texts, CHUNK tokens at most; a longer text is cut from its own start, so its sums
    do not depend on its neighbours."""
    lo = at = 0
    for n in size.tolist():
        if at + n - lo > CHUNK:
            if at > lo:
                yield lo, at
            lo = at
            while at + n - lo > CHUNK:
                yield lo, lo + CHUNK
                lo += CHUNK
        at += n
        if n > CHUNK and at > lo:
            yield lo, at
            lo = at
    if at > lo:
        yield lo, at


def pooled(ids: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each document, and the mean product of neighbours."""
    total = np.zeros((len(size), FEATURES))
    doc = np.repeat(np.arange(len(size)), size)
    for lo, hi in _chunks(size):
        v, own = table[ids[lo:hi + 1]], doc[lo:hi + 1]
        near = np.zeros((hi - lo, DIM), v.dtype)
        with_next = len(v) - 1                        # a text's last word has no neighbour behind it
        near[:with_next] = v[:-1][:hi - lo] * v[1:] * (own[1:] == own[:-1])[:, None]
        v, own = v[:hi - lo], own[:hi - lo]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total[own[at]] += np.concatenate([np.add.reduceat(x, at, axis=0) for x in (v, v * v, near)], axis=1)
    out = total / np.maximum(size, 1)[:, None]
    out[:, DIM:2 * DIM] = np.sqrt(np.maximum(out[:, DIM:2 * DIM] - out[:, :DIM] ** 2, 0))
    return out


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss; rows in a fixed order, so equal data give equal weights."""
    rng = np.random.default_rng(SEED)
    if len(y) < 2 * CALIBRATION_SHARE or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1.0
        bias = np.log(share / (1 - share)) if share < 1 else 500.0
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), bias)
    fold = rng.permutation(len(y)) % CALIBRATION_SHARE == 0
    a, t = x[~fold], y[~fold]
    net = Network(a.mean(0), a.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), float(np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))))
    a = (a - net.shift) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for lo in range(0, len(t), BATCH):
            own = order[lo:lo + BATCH]
            w1, b1, w2, b2 = params
            hidden = np.tanh(a[own] @ w1 + b1)
            miss = (1 / (1 + np.exp(-(hidden @ w2 + b2[0]))) - t[own]) / len(own)
            back = np.outer(miss, w2) * (1 - hidden ** 2)
            grads = [a[own].T @ back + DECAY * w1, back.sum(0), hidden.T @ miss + DECAY * w2, np.array([miss.sum()])]
            step += 1
            for p, g, mi, vi in zip(params, grads, m, v):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= RATE * (mi / (1 - 0.9 ** step)) / (np.sqrt(vi / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    z = net.logits(x[fold])

    def loss(temperature: float) -> float:
        return float(np.mean(np.logaddexp(0, -np.where(y[fold] > 0.5, z, -z) / temperature)))
    net.temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=loss))
    return net


def _pool(table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_ROWS, PIECE_BYTES):
                x = pooled(*_tokens(batch, buckets), table.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])
    return run


def _score(table, net) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_ROWS, PIECE_BYTES):
                score = net.value.score(pooled(*_tokens(batch, buckets), table.value))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])
    return run


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """(word vectors of all ``docs``, network trained on labelled ones that are not held out)."""
    table = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    known = (labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN))
    # at most MAX_TRAIN rows of 16 bytes, so they can be broadcast; other columns of documents could clash
    rows = (docs.select("doc_id", F.col("text").cast("binary").alias("__text")).join(F.broadcast(known), "doc_id").select("label", "__text")
            .mapInArrow(tidied(_pool(sent)), "label double, x array<double>").collect())
    rows = sorted((tuple(r.x), r.label) for r in rows)
    return table, train(np.array([x for x, _ in rows]).reshape(-1, FEATURES), np.array([y for _, y in rows]))


def scored(docs: DataFrame, labels: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``keep_row`` also the row as ``__row``."""
    table, net = fit(docs, labels)
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.struct(*(docs.columns if keep_row else ["doc_id"])).alias("row"), F.col("text").cast("binary").alias("__text"))
    out = src.mapInArrow(tidied(_score(sc.broadcast(table), sc.broadcast(net))),
                         T.StructType([src.schema["row"], T.StructField("score", T.DoubleType())]))
    cols = [F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted")]
    return out.select(*cols, *([F.col("row").alias("__row")] if keep_row else []))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that are predicted to be good."""
    return scored(docs, labels, keep_row=True).where("predicted = 1").select("__row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
