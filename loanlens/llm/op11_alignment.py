"""Operator 11: alignment of two tokenizers by an associative fragment monoid.

A text's tokens by A (byte-level BPE) and by B (SentencePiece) cover the same
bytes. Offsets where tokens of both end cut them into groups.

1. A text of ``CHUNK_BYTES`` or more is cut into byte ranges, which are dealt over
   tasks. A task encodes the range with as much around it as makes its tokens those
   of the whole text (out to a space that no token of A or B crosses, see ``_cuts``),
   and keeps the tokens that end in the range. Shorter texts are one range, encoded
   where they are read.
2. A range gives a fragment: tokens up to its first common end (open prefix), closed
   groups, tokens behind its last common end (open suffix); or, without any common
   end, open tokens only. ``compose`` joins neighbours: the left one's suffix and the
   right one's prefix close a group. It is associative, so ``FAN`` neighbours at a
   time are joined by grouped tasks, level by level, until a text has one fragment.
3. A link is a pair of tokens that end together; both lie in the range that holds
   the end. Pairs are counted over all texts by a grouped sum.
4. Each text's links meet the counts: the most frequent pairs, ``SENT_PAIRS`` at most
   (a measured threshold on the count), by a broadcast; all others by a shuffled
   join. The hot pairs, which a shuffle would bring to one task, are among the former.

What grows with one text (the string of its groups) ends up in one task, as the text
itself does when it is read.

Defined cases: a null or empty text, and one whose bytes A or B do not give back
(U+2581 in it), has no tokens: counts 0 and '' for the digest; strings of special
tokens are plain text; a stretch without spaces is in two ranges at most, however
long, so a text without any is encoded whole; repeated rows, null and repeated
doc_ids are texts of their own; of pairs with equal counts all are best; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import materialized, pieces, read_table
from loanlens.session import checkpoint_dir

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 16
FAN = 16
SENT_PAIRS = 1 << 20
PIECE_ROWS, PIECE_BYTES = 2000, 1 << 20
SPACE = "▁"


# ---------------------------------------------------------------- the two tokenizers

@dataclass(frozen=True)
class Files:
    """Both vocabulary files as read on the driver, so that tasks need no path."""
    a: bytes
    b: bytes


def load_files(path_a: str | None = None, path_b: str | None = None) -> Files:
    with open(path_a or public_tokenizers.path(FILE_A), "rb") as a, open(path_b or public_tokenizers.path(FILE_B), "rb") as b:
        return Files(a.read(), b.read())


def _byte_symbols() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokensA:
    """Byte-level BPE. Where merges stand in the order of their ids the file is also a table of ranks, which encodes
    faster; long white space and files of another kind go to the tokenizer itself."""

    _LONG_BLANK = re.compile(r"\s{256}")

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.slow = tokenizers.Tokenizer.from_str(raw.decode())
        self.slow.encode_special_tokens = True
        self.slow.no_padding()
        self.slow.no_truncation()
        symbols = _byte_symbols()
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in self.slow.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(symbols[c] for c in token)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not spec["normalizer"]
        #: tokens never hold the end of a word and the space behind it
        self.ends_at_spaces = bool(plain and pre.get("use_regex", True))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        ranked = self.ends_at_spaces and all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) \
            and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges)) and len(model["vocab"]) - len(added) <= 256 + len(merges)
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
            self.bytes_of[i]: i for i in model["vocab"].values() if i not in added}) if ranked else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self._LONG_BLANK.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class TokensB:
    """SentencePiece; ``encode`` gives the pieces of space + text."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.ends_at_spaces = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def opened(files: Files) -> tuple[TokensA, TokensB]:
    return TokensA(files.a), TokensB(files.b)


# ---------------------------------------------------------------- byte ranges

#: A word's end, one space, a word's start, in ASCII: neither A nor B has a token across the place before the space.
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def _cuts(data: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
    """(from, to, first byte, byte behind) for each range of space + text: encode from..to, keep tokens that end behind ``first byte``
    and not behind the last. A multiple of ``chunk`` is an edge if there is a cut in the chunk before it, so that a stretch without
    cuts is in two ranges at most."""
    n, edges, before = len(data), [0], [0]
    for at in range(chunk, n, chunk):
        last = None
        for width in (256, chunk):                                      # mostly the last cut is near
            lo = max(at - width, at - chunk)
            for m in _CUT.finditer(data, max(lo, 0), min(at + 2, n)):
                if m.start() <= at:
                    last = m.start()
            if last is not None:
                break
        if last is not None and last > before[-1]:
            edges.append(at)
            before.append(last)
    out = []
    for i, lo in enumerate(edges):
        hi = edges[i + 1] if i + 1 < len(edges) else n
        behind = _CUT.search(data, max(hi - 1, 0)) if hi < n else None
        while behind and behind.start() < hi:
            behind = _CUT.search(data, behind.end())
        out.append((before[i], behind.start() if behind else n, lo, hi))
    return out


# ---------------------------------------------------------------- fragments

@dataclass
class Fragment:
    """Of a byte range. Without a common end (``cut``) all its tokens are in the prefix."""
    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0                   # closed ones
    cut: bool = False
    prefix_a: list[int] = field(default_factory=list)
    prefix_b: list[int] = field(default_factory=list)
    closed: bytes = b""                 # a1,a2|b1;a3|b2,b3
    suffix_a: list[int] = field(default_factory=list)
    suffix_b: list[int] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))      # of linked pairs, sorted
    ns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))         # links of each


NAMES = tuple(Fragment.__dataclass_fields__)


def _group(a: list[int], b: list[int]) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def _summed(codes: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(codes, return_inverse=True)
    return own, np.bincount(place, ns, len(own)).astype(np.int64)


def composed(parts: list[Fragment]) -> Fragment:
    """Neighbours from left to right as one; associative, and an empty fragment changes nothing."""
    out, closed = Fragment(), []
    for x in parts:
        out.ok &= x.ok
        out.n_a += x.n_a
        out.n_b += x.n_b
        out.n_groups += x.n_groups
        if not x.cut:
            side = (out.suffix_a, out.suffix_b) if out.cut else (out.prefix_a, out.prefix_b)
            side[0].extend(x.prefix_a)
            side[1].extend(x.prefix_b)
            continue
        if out.cut:
            closed.append(_group(out.suffix_a + list(x.prefix_a), out.suffix_b + list(x.prefix_b)))
            out.n_groups += 1
        else:
            out.prefix_a.extend(x.prefix_a)
            out.prefix_b.extend(x.prefix_b)
            out.cut = True
        if len(x.closed):
            closed.append(bytes(x.closed))
        out.suffix_a, out.suffix_b = list(x.suffix_a), list(x.suffix_b)
    out.closed = b";".join(closed)
    if parts:
        out.codes, out.ns = _summed(np.concatenate([x.codes for x in parts]), np.concatenate([x.ns for x in parts]))
    return out


def finished(x: Fragment) -> tuple:
    """n_a, n_b, n_groups, n_links, codes, ns, groups_sha256 of a whole text; its start and its end are common."""
    if not x.ok or not x.cut:
        return 0, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), ""
    groups = _group(x.prefix_a, x.prefix_b) + (b";" + x.closed if x.closed else b"")
    return x.n_a, x.n_b, x.n_groups + 1, int(x.ns.sum()), x.codes, x.ns, hashlib.sha256(groups).hexdigest()


class Aligner:
    def __init__(self, files: Files):
        self.a, self.b = opened(files)
        self.cuts_allowed = self.a.ends_at_spaces and self.b.ends_at_spaces
        self.long_a, self.long_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.base = len(self.long_b)
        #: text of an id inside and at the end of its run, first A's, then B's
        self.shown = [f"{i}{end}".encode() for n, last in ((len(self.long_a), "|"), (len(self.long_b), ";")) for i in range(n) for end in (",", last)]

    def ranges(self, data: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
        return _cuts(data, chunk) if self.cuts_allowed and len(data) > chunk else [(0, len(data), 0, len(data))]

    def fragments(self, units: list[tuple[str, int, int]]) -> list[Fragment]:
        """For each (text that starts with a space, lo, hi): the fragment of the tokens that end behind byte lo, up to byte hi."""
        out = [Fragment() for _ in units]
        ids_a = [self.a.encode(u[0]) for u in units]
        ids_b = [np.array(x, np.int32) for x in self.b.encode([u[0][1:] for u in units])]
        live = []
        for i, u in enumerate(units):
            raw = u[0].encode()
            if all(b"".join(map(t.bytes_of.__getitem__, ids.tolist())) == raw for t, ids in ((self.a, ids_a[i]), (self.b, ids_b[i]))):
                live.append((i, len(raw)))
            else:
                out[i].ok = False
        if not live:
            return out
        size = np.array([n for _, n in live], np.int64)
        base = np.cumsum(size) - size
        lo, hi = (np.array([units[i][k] for i, _ in live], np.int64) + base for k in (1, 2))
        sides, marks = [], []
        for ids, long in ((ids_a, self.long_a), (ids_b, self.long_b)):
            own = np.concatenate([ids[i] for i, _ in live])
            end = np.cumsum(long[own])
            at = np.repeat(np.arange(len(live)), [len(ids[i]) for i, _ in live])
            is_end = np.zeros(int(size.sum()) + 1, bool)
            is_end[end] = True
            marks.append(is_end)
            sides.append((own, end, at))
        common = marks[0] & marks[1]
        kept = []
        for own, end, at in sides:
            inside = (end > lo[at]) & (end <= hi[at])
            own, end, at = own[inside], end[inside], at[inside]
            both = common[end]
            n_own = np.bincount(at, minlength=len(live))
            seen = np.cumsum(both) - both
            first = np.searchsorted(at, np.arange(len(live)))
            if len(own):
                seen -= np.where(n_own > 0, np.append(seen, 0)[np.minimum(first, len(seen))], 0)[at]
            kept.append((own, at, both, seen, n_own, first))
        (a, at_a, both_a, seen_a, n_a, first_a), (b, at_b, both_b, seen_b, n_b, first_b) = kept
        ends = np.bincount(at_a, both_a, len(live)).astype(np.int64)       # common ends of each range
        # the tokens of closed groups, those of A before those of B in each group
        mid_a, mid_b = ((seen > 0) & (seen < ends[at]) for seen, at in ((seen_a, at_a), (seen_b, at_b)))
        start = np.cumsum(ends + 1) - (ends + 1)
        group_a, group_b = start[at_a[mid_a]] + seen_a[mid_a], start[at_b[mid_b]] + seen_b[mid_b]
        text = np.empty(len(group_a) + len(group_b), np.int64)
        text[np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a[mid_a] + both_a[mid_a]
        text[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.long_a) + b[mid_b].astype(np.int64)) + both_b[mid_b]
        text_end = np.cumsum(np.bincount(at_a[mid_a], minlength=len(live)) + np.bincount(at_b[mid_b], minlength=len(live)))
        # links: the n-th common end of A's tokens is the n-th of B's
        code = a[both_a].astype(np.int64) * self.base + b[both_b]
        width = len(self.long_a) * self.base
        pairs, ns = np.unique(at_a[both_a] * width + code, return_counts=True)
        pair_end = np.searchsorted(pairs, np.arange(1, len(live) + 1) * width)
        text, shown = text.tolist(), self.shown
        for j, (i, _) in enumerate(live):
            x = out[i]
            x.n_a, x.n_b, x.cut, x.n_groups = int(n_a[j]), int(n_b[j]), bool(ends[j]), max(int(ends[j]) - 1, 0)
            x.closed = b"".join(map(shown.__getitem__, text[text_end[j - 1] if j else 0:text_end[j]]))[:-1]
            for own, seen, first, n, p, s in ((a, seen_a, first_a, n_a, x.prefix_a, x.suffix_a), (b, seen_b, first_b, n_b, x.prefix_b, x.suffix_b)):
                f, behind = first[j], first[j] + n[j]
                until = int(np.searchsorted(seen[f:behind], 0, "right")) + f
                p.extend(own[f:until].tolist())
                if x.cut:
                    s.extend(own[max(until, int(np.searchsorted(seen[f:behind], ends[j], "left")) + f):behind].tolist())
            mine = slice(pair_end[j - 1] if j else 0, pair_end[j])
            x.codes, x.ns = pairs[mine] - j * width, ns[mine].astype(np.int64)
        return out


# ---------------------------------------------------------------- as Spark jobs

_TEXT = "n_a long, n_b long, n_groups long, n_links long, codes array<long>, ns array<long>, groups_sha256 string"
_FRAGMENT = ("row long, doc_id long, k long, ok boolean, n_a long, n_b long, n_groups long, cut boolean, prefix_a array<int>, prefix_b array<int>, "
             "closed binary, suffix_a array<int>, suffix_b array<int>, codes array<long>, ns array<long>")
_TYPES = {"ok": pa.bool_(), "cut": pa.bool_(), "closed": pa.binary(), "codes": pa.list_(pa.int64()), "ns": pa.list_(pa.int64())} | {
    c: pa.list_(pa.int32()) for c in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def _texts(rows: pa.Array, ids: pa.Array, done: list[Fragment]) -> pa.RecordBatch:
    out = [finished(x) for x in done]
    return pa.RecordBatch.from_arrays(
        [rows, ids, *(pa.array([x[j] for x in out], pa.int64()) for j in range(4)), _lists([x[4] for x in out]), _lists([x[5] for x in out]),
         pa.array([x[6] for x in out], pa.string())],
        names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "codes", "ns", "groups_sha256"])


def _as_batch(keys: list[pa.Array], parts: list[Fragment]) -> pa.RecordBatch:
    columns = [_lists([getattr(x, c) for x in parts]) if c in ("codes", "ns") else pa.array([getattr(x, c) for x in parts], _TYPES.get(c, pa.int64()))
               for c in NAMES]
    return pa.RecordBatch.from_arrays([*keys, *columns], names=["row", "doc_id", "k", *NAMES])


def _from_batch(table: pa.RecordBatch | pa.Table) -> list[Fragment]:
    columns = {c: table.column(c).to_pylist() for c in NAMES}
    parts = [Fragment(**{c: columns[c][i] for c in NAMES}) for i in range(table.num_rows)]
    for x in parts:
        x.codes, x.ns = np.array(x.codes, np.int64), np.array(x.ns, np.int64)
    return parts


def _short(files) -> Callable:
    """row, doc_id, text -> the whole alignment of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files.value)
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_ROWS, PIECE_BYTES):
                texts = batch.column(2).to_pylist()
                has = [i for i, t in enumerate(texts) if t]
                parts = [Fragment() for _ in texts]
                units = [" " + texts[i] for i in has]
                for i, x in zip(has, aligner.fragments([(u, 0, len(u.encode())) for u in units])):
                    parts[i] = x
                yield _texts(batch.column(0), batch.column(1), parts)
    return run


def _ranges(files, chunk: int) -> Callable:
    """row, doc_id, text -> a row for each byte range, with the bytes to encode."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files.value)
        for whole in batches:
            for batch in pieces(whole, 2, 1):
                data = b" " + batch.column(2)[0].as_py().encode()
                found = aligner.ranges(data, chunk)
                for at in range(0, len(found), 64):
                    own = found[at:at + 64]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[0].as_py()] * n, pa.int64()), pa.array([batch.column(1)[0].as_py()] * n, pa.int64()),
                         pa.array(range(at, at + n), pa.int64()), pa.array([lo - a for a, _, lo, _ in own], pa.int64()),
                         pa.array([hi - a for a, _, _, hi in own], pa.int64()), pa.array([data[a:b] for a, b, _, _ in own], pa.binary())],
                        names=["row", "doc_id", "k", "lo", "hi", "data"])
    return run


def _of_ranges(files) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files.value)
        for whole in batches:
            for batch in pieces(whole, 5, PIECE_ROWS, PIECE_BYTES):
                lo, hi, data = (batch.column(c).to_pylist() for c in ("lo", "hi", "data"))
                parts = aligner.fragments([(d.decode(), a, b) for a, b, d in zip(lo, hi, data)])
                yield _as_batch([batch.column(c) for c in ("row", "doc_id", "k")], parts)
    return run


def _joined(table: pa.Table) -> pa.Table:
    """Neighbouring fragments of a text as one, which has the place of the group among its level's."""
    table = table.sort_by("k")
    keys = [pa.array([table.column("row")[0].as_py()], pa.int64()), pa.array([table.column("doc_id")[0].as_py()], pa.int64()),
            pa.array([table.column("k")[0].as_py() // FAN], pa.int64())]
    return pa.Table.from_batches([_as_batch(keys, [composed(_from_batch(table))])])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            yield _texts(one.column(0).cast(pa.int64()), one.column(1), _from_batch(one))


def aligned(docs: DataFrame, files: Files | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """A row for each text: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, codes and ns (linked pairs as
    a * size of B + b, with their links), groups_sha256."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(files or load_files())
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    short = src.where(~long).mapInArrow(_short(sent), "row long, doc_id long, " + _TEXT)
    ranges = src.where(long).mapInArrow(_ranges(sent, chunk), "row long, doc_id long, k long, lo long, hi long, data binary")
    # ranges of all long texts over all tasks
    level = materialized(ranges.repartition("row", "k").mapInArrow(_of_ranges(sent), _FRAGMENT))
    n = (level.agg(F.max("k")).first()[0] or 0) + 1
    while n > 1:
        level = level.groupBy("row", F.floor(F.col("k") / FAN).alias("__parent")).applyInArrow(_joined, _FRAGMENT)
        n = -(-n // FAN)
    return short.unionByName(level.mapInArrow(_whole, "row long, doc_id long, " + _TEXT))


def _stored(df: DataFrame) -> DataFrame:
    """Written as compressed Parquet in the shared folder: sorted codes shrink to a fraction there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/alignment-{spark._jvm.java.util.UUID.randomUUID()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """code, links (over all texts), best (no pair with its id of B has more)."""
    counts = materialized(texts.select(F.inline(F.arrays_zip("codes", "ns"))).groupBy(F.col("codes").alias("code"))
                          .agg(F.sum("ns").alias("links")), narrow=True)
    own = F.col("code") % size_b
    most = counts.groupBy(own.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(most, own == F.col("b")).select("code", "links", (F.col("links") == F.col("most")).alias("best"))


def threshold(counts: DataFrame, most: int) -> tuple[int, bool]:
    """(links from which pairs are ``most`` at most, whether there are pairs with fewer), by powers of two."""
    by_power = {r[0]: r[1] for r in counts.groupBy(F.length(F.bin("links")).alias("p")).count().collect()}       # 63 rows at most
    total, least = 0, 64
    for p in sorted(by_power, reverse=True):
        if total + by_power[p] > most:
            break
        total, least = total + by_power[p], p
    return min(1 << (least - 1), 2 ** 63 - 1), any(p < least for p in by_power)


def link_sums(texts: DataFrame, counts: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """row, n_best, count_sum of the texts that have links."""
    links = texts.select("row", F.inline(F.arrays_zip("codes", "ns"))).withColumnsRenamed({"codes": "code", "ns": "n"})
    least, rest = threshold(counts, sent_pairs)

    def sums(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    frequent = F.broadcast(counts.where(F.col("links") >= least))                                                # sent_pairs rows at most, as measured
    out = sums(links.join(frequent, "code"))
    if rest:
        out = out.unionByName(sums(links.join(frequent.select("code"), "code", "left_anti").join(counts.where(F.col("links") < least), "code")))
        out = out.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def alignment(docs: DataFrame, files: Files | None = None, chunk: int = CHUNK_BYTES, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    files = files or load_files()
    texts = _stored(aligned(docs, files, chunk))
    counts = materialized(pair_counts(texts, sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()), narrow=True)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.join(link_sums(texts, counts, sent_pairs), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"))
