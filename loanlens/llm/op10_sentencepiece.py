"""Operator 10: SentencePiece encoding and decoding as a weighted finite-state transducer.

The model's parts are compiled once per task: the normaliser (a dummy space in
front, space to U+2581), the pieces as a prefix tree of arcs, and byte
fallback (a path of byte pieces for every character). An input is composed with
them lazily: its states are the positions in the text, its arcs the pieces that
match there. The encoding is the lattice's shortest path in the tropical
semiring, and states come in text order, so one pass finds it.

No piece of the model continues behind a space, so every path passes through
the state before each run of spaces; the shortest path is the sum of the paths
between these states, and equal stretches share one computed path.

Weights: a unigram model's own (minus the log probability), for which this is
SentencePiece's own encoding. A BPE model has merge ranks and no
probabilities; its arcs cost ``PIECE_COST + log(rank)``. That gives an encoding
with the model's pieces that decodes to the same text, but other pieces than
the merge order's for some words (about a fifth of invented ones).

Decoding is exact for every valid text: a literal U+2581, which SentencePiece
would turn into a space, goes through byte fallback here.

Defined cases: null text gives null ids and null text back; an empty text has
no ids; a very long text is encoded whole, in a slice of its own; repeated rows are
encoded each; of equally cheap paths the one with the longest last piece counts; bytes of ids that are not valid UTF-8 decode to U+FFFD; ids outside the
model are an error; an empty table gives an empty result; other columns are
carried or, in the query, ignored; a clashing ``ids`` column is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from loanlens.llm.common import pieces, read_table, tidied

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
PIECE_COST = 8.0
FALLBACK_COST = 1000.0          # per byte: only where no piece covers a character
CACHED = 150_000                # paths in a generation; a task keeps two
CACHED_LENGTH = 48
PIECE_ROWS = 1000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass(frozen=True)
class Model:
    """What the transducer is compiled from; small and fixed, so it is sent to the tasks."""
    pieces: tuple[tuple[int, str, float], ...]      # id, text with U+2581, weight
    byte_ids: tuple[int, ...]                       # by byte
    size: int
    dummy_prefix: bool


def load_model(path: str | None = None) -> Model:
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models whose normaliser keeps all characters decode exactly")
    bpe = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
    byte_ids, pieces = {}, []
    for i, p in enumerate(proto.pieces):
        if p.type == _BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
        elif p.type in (_NORMAL, _USER):
            if re.search(f"[^{SPACE}]{SPACE}", p.piece):
                raise ValueError("a piece goes on behind a space")
            pieces.append((i, p.piece, PIECE_COST + math.log(len(pieces) + 1) if bpe else -p.score))
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    return Model(tuple(pieces), tuple(byte_ids[b] for b in range(256)), len(proto.pieces), proto.normalizer_spec.add_dummy_prefix)


class Transducer:
    """Normaliser, pieces and byte fallback, composed with one input at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.tree: dict = {}                        # arcs by character; key None: (id, weight) of the piece that ends here
        for i, text, weight in model.pieces:
            node = self.tree
            for c in text:
                node = node.setdefault(c, {})
            node[None] = (i, weight)
        self.text_of = [b""] * model.size
        for i, text, _ in model.pieces:
            self.text_of[i] = text.replace(SPACE, " ").encode()
        for byte, i in enumerate(model.byte_ids):
            self.text_of[i] = bytes([byte])
        self.paths: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}     # the generation before, for paths still in use

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Ids on the cheapest path over ``text``; of equal ones the one whose last piece is longest."""
        n = len(text)
        best, back = [math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        # the normaliser's arcs: a space reads as the piece symbol, the symbol itself as nothing that a piece has
        read = text.replace(" ", SPACE) if SPACE not in text else ["" if c == SPACE else SPACE if c == " " else c for c in text]
        for a in range(n):
            node, cost = self.tree, best[a]
            for b in range(a, n):
                node = node.get(read[b])
                if node is None:
                    break
                if None in node:
                    i, weight = node[None]
                    if cost + weight < best[b + 1]:
                        best[b + 1], back[b + 1] = cost + weight, (a, (i,))
            if back[a + 1] is None:
                raw = text[a].encode("utf-8", "replace")
                best[a + 1] = cost + FALLBACK_COST * len(raw)
                back[a + 1] = (a, tuple(self.model.byte_ids[x] for x in raw))
        out, b = [], n
        while b:
            a, ids = back[b]
            out.append(ids)
            b = a
        return tuple(i for ids in reversed(out) for i in ids)

    _BETWEEN = re.compile(" *[^ ]+| +")

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        paths, out = self.paths, []
        for part in self._BETWEEN.findall(" " + text if self.model.dummy_prefix else text):
            ids = paths.get(part)
            if ids is None:
                ids = self.older.get(part) or self.shortest_path(part)
                if len(part) <= CACHED_LENGTH:
                    if len(paths) >= CACHED:
                        self.older, self.paths = paths, {}
                        paths = self.paths
                    paths[part] = ids
            out.extend(ids)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.text_of.__getitem__, ids))
        return raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _lists(rows: list[list[int] | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(r or ()) for r in rows)]).astype(np.int32)
    flat = np.fromiter((i for r in rows for i in r or ()), np.int32, int(ends[-1]))
    null = np.array([r is None for r in rows], bool)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(null) if null.any() else None)


def _encode(model, check: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer(model.value)
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_ROWS):
                texts = batch.column(1).to_pylist()
                rows = [None if t is None else fst.encode(t) for t in texts]
                cols, names = [batch.column(0), _lists(rows)], ["row", "ids"]
                if check:
                    back = [None if r is None else fst.decode_bytes(r) for r in rows]
                    cols += [pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                             pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in back]),
                             pa.array([None if x is None else x == t.encode() for x, t in zip(back, texts)], pa.bool_())]
                    names += ["n_chars", "decoded_sha256", "exact"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _decode(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer(model.value)
        for batch in batches:
            texts = [None if ids is None else fst.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])
    return run


def _rows(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias("row"), column)


def encode(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model or load_model())
    src = _rows(docs, "text")
    schema = T.StructType([src.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    done = src.mapInArrow(tidied(_encode(sent, False)), schema)
    return done.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "ids"), "ids")


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """``encoded`` with ``text`` set to what ``ids`` decode to."""
    sent = encoded.sparkSession.sparkContext.broadcast(model or load_model())
    src = _rows(encoded, "ids")
    schema = T.StructType([src.schema["row"], T.StructField("text", T.StringType())])
    done = src.mapInArrow(tidied(_decode(sent)), schema)
    return done.select(*(F.col("row")[c].alias(c) for c in encoded.columns if c != "text"), "text")


def encoding_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, decoded_sha256, exact (decoding gives the text back)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or load_model())
    return (docs.select("doc_id", "text")
            .mapInArrow(tidied(_encode(sent, True)), T.StructType([
                T.StructField("row", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
                T.StructField("n_chars", T.LongType()), T.StructField("decoded_sha256", T.StringType()),
                T.StructField("exact", T.BooleanType())]))
            .select(F.col("row").alias("doc_id"), "n_chars", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"),
                    "ids", "decoded_sha256", "exact"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(read_table(spark, sf_dir, "documents"))
