"""Recurring passages of a corpus, routed to shards by content anchors.

A *window* is ``length`` consecutive symbols (bytes or words) of one document.
Its anchor is the gram of ``gram`` symbols with the smallest hash in it, so
equal windows have equal anchors wherever they stand, and about two in
``length - gram`` positions are anchors. The work is done in four steps, and
each deals out bounded pieces:

1. documents are dealt into blocks by ``doc_id``; each block sends the hashes
   of its anchors, one entry per hash and block, to buckets of the hash space;
2. a bucket answers each block with the anchors that recur in the corpus;
3. the block sends the text around its recurring anchors (*contexts*: all
   windows that share the anchor) to shards by anchor, equal contexts once,
   with their first occurrence; a shard finds the repeats among its contexts
   (a suffix array, an automaton) and answers with the spans and the first
   occurrence of each;
4. the block applies the answers to all its documents.

A hot passage costs one entry per block and step, whatever its number of
occurrences. The text is shuffled once: the three uses of the blocks read the
same exchange. Nothing is collected to the driver but one byte count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import NULL_ID, WordHashes, arrow_binary, gram_hashes, ids_of, mix, text_bytes, tidied_group, tidied_pair

POS_BITS = 24
SEGMENT = 1 << 18                 # window starts handled at a time
BLOCKS_PER_BUCKET, BLOCKS_PER_SHARD = 16, 4


@dataclass(frozen=True)
class Spec:
    """What a window is: ``unit`` "byte" or "word"; ``by_start``: a window is
    also a repeat of an earlier one in its own document."""
    unit: str
    length: int
    gram: int
    by_start: bool

    @property
    def width(self) -> int:
        return 1 if self.unit == "byte" else 8


# ---------------------------------------------------------------- symbols

def split_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what bytes.split() splits on is exactly that set."""
    return data.split()


def symbols_of(spec: Spec, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all documents in a row, document offsets)."""
    if spec.unit == "byte":
        return raw, offsets
    data, hashes, parts = raw.tobytes(), WordHashes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        parts.append(hashes.array(split_words(data[a:b])))
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), off


def _grams(spec: Spec, sym: np.ndarray) -> np.ndarray:
    if spec.unit == "word":
        return gram_hashes(sym, spec.gram)
    n = len(sym) - spec.gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    buf = sym.tobytes()
    at = lambda shift, kind: np.ndarray((n,), kind, buf, shift, (1,)).astype(np.uint64)
    words = [at(8 * i, "<u8") for i in range(spec.gram // 8)]
    if spec.gram % 8:
        words.append(at(spec.gram - 4, "<u4"))
    h = words[0] * np.uint64(0x9E3779B97F4A7C15)
    for w in words[1:]:
        h ^= h >> np.uint64(31)
        h += w
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    cur, size = key, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:len(cur) - size], cur[size:])
        size *= 2
    if size < w:
        cur = np.minimum(cur[:len(cur) - (w - size)], cur[w - size:])
    return cur


@dataclass
class Runs:
    """Runs of window starts that share an anchor."""
    start: np.ndarray      # first window start, position in the block
    count: np.ndarray      # windows in the run
    anchor: np.ndarray     # 64-bit hash of the anchor gram
    doc: np.ndarray        # row of the document


def runs_of(spec: Spec, sym: np.ndarray, off: np.ndarray) -> Runs:
    length, w = spec.length, spec.length - spec.gram + 1
    n = len(sym)
    edge = np.zeros(n + 1, np.int32)
    has = off[1:] - off[:-1] >= length
    np.add.at(edge, off[:-1][has], 1)
    np.add.at(edge, off[1:][has] - length + 1, -1)
    ok = np.cumsum(edge, dtype=np.int32)[:n] > 0
    out: list[tuple] = []
    mask = np.uint64((1 << POS_BITS) - 1)
    for a in range(0, max(0, n - length + 1), SEGMENT):
        b = min(a + SEGMENT, n - length + 1)
        if not ok[a:b].any():
            continue
        h = _grams(spec, sym[a:b + length - 1])
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        owner = (sliding_min(key, w) & mask).astype(np.int64)
        good = ok[a:b]
        first = good.copy()
        first[1:] &= ~good[:-1] | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        stop = good.copy()
        stop[:-1] &= ~good[1:] | (owner[1:] != owner[:-1])
        end = np.flatnonzero(stop)
        out.append((at + a, end - at + 1, h[owner[at]]))
    if not out:
        z = np.zeros(0, np.int64)
        return Runs(z, z, np.zeros(0, np.uint64), z)
    start, count, anchor = (np.concatenate(x) for x in zip(*out))
    return Runs(start, count, anchor, np.searchsorted(off, start, side="right") - 1)


def _route(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _low(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by_part(part: np.ndarray, n_rows: int):
    """(order, [(part, from, to)]) of rows grouped by part."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if n_rows else np.zeros(0, np.int64)
    return order, list(zip(part[order][cut].tolist(), cut.tolist(), [*cut[1:].tolist(), n_rows]))


class Block:
    """The documents of a block, in an order that does not depend on the shuffle."""

    def __init__(self, spec: Spec, table: pa.Table):
        table = table.set_column(table.schema.get_field_index("__text"), "__text", table["__text"].fill_null(b""))
        self.table = table.sort_by([("__id", "ascending"), ("__text", "ascending")])
        self.ids = ids_of(self.table["__id"])
        self.raw, self.byte_off = arrow_binary(self.table["__text"])
        self.sym, self.off = symbols_of(spec, self.raw, self.byte_off)
        self.runs = runs_of(spec, self.sym, self.off)


def _anchor_rows(spec: Spec, n_buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        block = Block(spec, table)
        r = block.runs
        key = (_route(r.anchor, n_buckets).astype(np.uint64) << np.uint64(32)) | _low(r.anchor)
        order = np.lexsort((block.ids[r.doc] if len(r.doc) else r.doc, key))
        key, doc = key[order], block.ids[r.doc][order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        again = ~new if spec.by_start else ~new & np.r_[False, doc[1:] != doc[:-1]][:len(new)]
        at = np.flatnonzero(new)
        twice = np.add.reduceat(again, at) > 0 if len(at) else np.zeros(0, bool)
        key = key[at]
        part = (key >> np.uint64(32)).astype(np.int64)
        _, pieces = _by_part(part, len(part))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        number = table["__block"][0].as_py()
        return pa.table({
            "bucket": pa.array([p for p, _, _ in pieces], pa.int64()),
            "__block": pa.array([number] * len(pieces), pa.int64()),
            "hashes": pa.array([low[a:b].tobytes() for _, a, b in pieces], pa.binary()),
            "twice": pa.array([twice[a:b].tobytes() for _, a, b in pieces], pa.binary())})
    return run


def _recurring(table: pa.Table) -> pa.Table:
    """Which anchors of a bucket recur: in two blocks, or twice in one."""
    raw, off = arrow_binary(table["hashes"])
    flags, _ = arrow_binary(table["twice"])
    h, off = raw.view(np.uint32), off // 4
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1] if len(s) else np.zeros(0, bool)
    hit = np.r_[False, same] | np.r_[same, False] | (flags[order] > 0) if len(s) else np.zeros(0, bool)
    keep = np.zeros(len(h), bool)
    keep[order] = hit
    out = [h[a:b][keep[a:b]].tobytes() for a, b in zip(off[:-1], off[1:])]
    return pa.table({"bucket": table["bucket"].combine_chunks(), "__block": table["__block"].combine_chunks(),
                     "hashes": pa.array(out, pa.binary())})


class Contexts:
    """Distinct contexts of a block around its recurring anchors, in a fixed order."""

    def __init__(self, spec: Spec, block: Block, answers: pa.Table, n_buckets: int, n_shards: int):
        raw, off = arrow_binary(answers["hashes"])
        part = answers["bucket"].to_numpy().astype(np.uint64)
        known = np.sort(raw.view(np.uint32).astype(np.uint64) | (np.repeat(part, np.diff(off) // 4) << np.uint64(32)))
        r = block.runs
        key = (_route(r.anchor, n_buckets).astype(np.uint64) << np.uint64(32)) | _low(r.anchor)
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == key) if len(known) else np.zeros(0, np.int64)
        self.start, self.count, self.doc = r.start[hit], r.count[hit], r.doc[hit]
        anchor = r.anchor[hit]
        size, data = spec.width, block.sym.tobytes()
        begins = block.off[self.doc] if len(hit) else self.start
        seen: dict[bytes, int] = {}
        uid, first = np.zeros(len(hit), np.int64), []
        low = (self.start * size).tolist()
        high = ((self.start + self.count + spec.length - 1) * size).tolist()
        for i, (a, b) in enumerate(zip(low, high)):
            u = seen.setdefault(data[a:b], len(seen))
            if u == len(first):
                first.append(i)
            uid[i] = u
        self.uid, n = uid, len(first)
        first = np.array(first, np.int64)
        self.texts, self.anchor, self.windows = list(seen), anchor[first], self.count[first]
        # the first occurrence of each distinct context, and whether it recurs here
        doc_id = block.ids[self.doc] if len(hit) else self.start
        order = np.lexsort((self.start - begins, doc_id, uid))
        head = order[np.flatnonzero(np.r_[True, np.diff(uid[order]) != 0])] if n else order
        self.first_doc, self.first_start = doc_id[head], (self.start - begins)[head]
        tail = order[np.r_[np.flatnonzero(np.diff(uid[order]) != 0), len(uid) - 1]] if n else order
        self.twice = (np.bincount(uid, minlength=n) > 1) & (spec.by_start | (doc_id[tail] != self.first_doc)) if n else np.zeros(0, bool)
        self.shard = _route(mix(self.anchor.copy()), n_shards)
        self.order, self.pieces = _by_part(self.shard, n)


#: ``doc_ids``: distinct ids of the row's first documents, ``first_doc`` numbers in them.
_CONTEXT_SCHEMA = ("shard long, __block long, texts binary, windows binary, anchors binary, doc_ids binary, "
                   "first_doc binary, first_start binary, twice binary")
_ANSWER_SCHEMA = ("shard long, __block long, item binary, at binary, size binary, first_doc binary, first_start binary, "
                  "repeat_id binary")


def _context_rows(spec: Spec, n_buckets: int, n_shards: int) -> Callable:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _empty(_CONTEXT_SCHEMA)
        block = Block(spec, docs)
        c = Contexts(spec, block, answers, n_buckets, n_shards)
        number = docs["__block"][0].as_py()
        rows = []
        for shard, a, b in c.pieces:
            own = c.order[a:b]
            ids, doc = np.unique(c.first_doc[own], return_inverse=True)
            rows.append((shard, number, b"".join([c.texts[u] for u in own.tolist()]), c.windows[own].astype(np.uint8).tobytes(),
                         _low(c.anchor[own]).tobytes(), ids.tobytes(), doc.astype(np.uint32).tobytes(),
                         c.first_start[own].astype(np.uint32).tobytes(), c.twice[own].tobytes()))
        return _table(rows, _CONTEXT_SCHEMA)
    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(",")))
    types = [{"long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, cols, types)})


def _empty(schema: str) -> pa.Table:
    return _table([], schema)


@dataclass
class Shard:
    """The distinct contexts of some anchors, for a repeat finder."""
    texts: list[bytes]          # the windows' text: windows + length - 1 symbols
    windows: np.ndarray
    first_doc: np.ndarray
    first_start: np.ndarray
    recurs: np.ndarray          # the same context stands in several places


#: A finder returns spans: (context, first symbol, symbols, first doc, first start, repeat id).
Finder = Callable[[Shard], tuple[np.ndarray, ...]]


def _shard_answers(spec: Spec, finder: Finder, most: int, whole: bool) -> Callable:
    """``whole``: answer with every occurrence, not only with those that may be removed."""
    def column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
        raw, off = arrow_binary(table[name])
        return raw.view(kind), off // np.dtype(kind).itemsize

    def run(table: pa.Table) -> pa.Table:
        data = arrow_binary(table["texts"])[0].tobytes()
        windows, per = column(table, "windows", np.uint8)
        n = len(windows)
        row = np.repeat(np.arange(table.num_rows), np.diff(per))
        size = (windows.astype(np.int64) + spec.length - 1) * spec.width
        stop = np.cumsum(size)
        start = stop - size
        ids, id_off = column(table, "doc_ids", np.int64)
        docs = ids[id_off[:-1][row] + column(table, "first_doc", np.uint32)[0]] if n else ids
        starts = column(table, "first_start", np.uint32)[0].astype(np.int64)
        anchors, twice = column(table, "anchors", np.uint32)[0], column(table, "twice", bool)[0]
        seen: dict = {}
        uid = np.zeros(n, np.int64)
        for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
            uid[i] = seen.setdefault(data[a:b], len(seen))
        m = len(seen)
        order = np.lexsort((starts, docs, uid))
        head = order[np.flatnonzero(np.r_[True, np.diff(uid[order]) != 0])] if n else order
        last = order[np.r_[np.flatnonzero(np.diff(uid[order]) != 0), n - 1]] if n else order
        recurs = np.zeros(m, bool)
        np.logical_or.at(recurs, uid, twice)
        recurs |= (np.bincount(uid, minlength=m) > 1) & (spec.by_start | (docs[last] != docs[head])) if m else False
        texts = list(seen)
        by_anchor = np.argsort(anchors[head], kind="stable") if m else head
        # slices of whole anchors, so the memory does not grow with the shard
        a_sorted = anchors[head][by_anchor] if m else anchors
        load = np.cumsum(windows[head][by_anchor].astype(np.int64)) if m else np.zeros(0, np.int64)
        found, lo = [], 0
        while lo < m:
            hi = int(np.searchsorted(load, (load[lo - 1] if lo else 0) + most, side="right"))
            hi = max(hi, lo + 1)
            hi = int(np.searchsorted(a_sorted, a_sorted[hi - 1], side="right"))
            own = by_anchor[lo:hi]
            s = Shard([texts[u] for u in own.tolist()], windows[head][own], docs[head][own], starts[head][own], recurs[own])
            item, *rest = finder(s)
            found.append((own[item], *rest))
            lo = hi
        if found:
            item, at, size, doc, first, rid = (np.concatenate(x) for x in zip(*found))
        else:
            item, at, size, doc, first = (np.zeros(0, np.int64) for _ in range(5))
            rid = np.zeros(0, np.uint64)
        by = np.argsort(item, kind="stable")
        ptr = np.searchsorted(item[by], np.arange(m + 1))
        counts = np.diff(ptr)[uid] if n else np.zeros(0, np.int64)
        take = by[np.repeat(ptr[:-1][uid] if n else ptr[:0], counts) + _ramp(counts)]
        asked = np.repeat(np.arange(n), counts)
        if not whole and n:
            later = docs[asked] > doc[take]
            if spec.by_start:
                later |= (docs[asked] == doc[take]) & (starts[asked] + at[take] > first[take])
            use = later | twice[asked]
            asked, take, counts = asked[use], take[use], np.bincount(asked[use], minlength=n)
        number = asked - per[row][asked] if n else asked
        edge = np.r_[0, np.cumsum(counts)][per] if n else np.zeros(table.num_rows + 1, np.int64)
        cols = [number.astype(np.int32), at[take].astype(np.int16), size[take].astype(np.int16), doc[take].astype(np.int64),
                first[take].astype(np.int64) if spec.by_start else np.zeros(0, np.int64),
                rid[take].astype(np.uint64) if whole else np.zeros(0, np.uint64)]
        edges = [edge if len(c) or not len(number) else np.zeros_like(edge) for c in cols]
        shard, blocks = table["shard"].to_pylist(), table["__block"].to_pylist()
        rows = [(shard[i], blocks[i], *(c[e[i]:e[i + 1]].tobytes() for c, e in zip(cols, edges)))
                for i in range(table.num_rows) if edge[i + 1] > edge[i]]
        return _table(rows, _ANSWER_SCHEMA)
    return run


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _occurrences(spec: Spec, block: Block, anchors: pa.Table, answers: pa.Table, n_buckets: int, n_shards: int):
    """All occurrences of all repeats in the block: (doc row, position, symbols, first doc, first start, repeat id)."""
    c = Contexts(spec, block, anchors, n_buckets, n_shards)
    first_of = {shard: a for shard, a, _ in c.pieces}
    per = {name: arrow_binary(answers[name]) for name in ("item", "at", "size", "first_doc", "first_start", "repeat_id")}
    base = np.array([first_of[s] for s in answers["shard"].to_pylist()], np.int64)
    item_raw, item_off = per["item"]
    item = item_raw.view(np.int32).astype(np.int64)
    item = c.order[np.repeat(base, np.diff(item_off) // 4) + item] if len(item) else item
    at, size, doc, first, rid = (per[n][0].view(k) for n, k in (
        ("at", np.int16), ("size", np.int16), ("first_doc", np.int64), ("first_start", np.int64), ("repeat_id", np.uint64)))
    first, rid = (x if len(x) else np.zeros(len(item), x.dtype) for x in (first, rid))
    by = np.argsort(item, kind="stable")
    ptr = np.searchsorted(item[by], np.arange(len(c.texts) + 1))
    counts = np.diff(ptr)[c.uid] if len(c.uid) else np.zeros(0, np.int64)
    take = by[np.repeat(ptr[:-1][c.uid] if len(c.uid) else ptr[:0], counts) + _ramp(counts)]
    occ = np.repeat(np.arange(len(c.uid)), counts)
    pos = c.start[occ] + at[take]
    return c.doc[occ], pos, size[take].astype(np.int64), doc[take], first[take], rid[take]


def removed_mask(spec: Spec, block: Block, occ) -> np.ndarray:
    """Symbols covered by a repeat that first occurs earlier."""
    doc, pos, size, first_doc, first_start, _ = occ
    own, start = block.ids[doc] if len(doc) else doc, pos - block.off[doc] if len(doc) else pos
    late = own > first_doc
    if spec.by_start:
        late |= (own == first_doc) & (start > first_start)
    edge = np.zeros(len(block.sym) + 1, np.int32)
    np.add.at(edge, pos[late], 1)
    np.add.at(edge, (pos + size)[late], -1)
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def _kept(spec: Spec, block: Block, gone: np.ndarray, i: int) -> bytes:
    a, b = int(block.off[i]), int(block.off[i + 1])
    x, y = int(block.byte_off[i]), int(block.byte_off[i + 1])
    if spec.unit == "byte":
        return block.raw[x:y][~gone[a:b]].tobytes() if gone[a:b].any() else block.raw[x:y].tobytes()
    words = split_words(block.raw[x:y].tobytes())
    return b" ".join(w for w, g in zip(words, gone[a:b].tolist()) if not g)


def _report(spec: Spec, n_buckets: int, n_shards: int, text: bool) -> Callable:
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        n = docs.num_rows
        block = Block(spec, docs)
        is_anchor = back["kind"].to_numpy() == 0
        occ = _occurrences(spec, block, back.filter(pa.array(is_anchor)), back.filter(pa.array(~is_anchor)), n_buckets, n_shards)
        gone = removed_mask(spec, block, occ)
        total = np.r_[np.int32(0), np.cumsum(gone, dtype=np.int32)]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        starts = block.off[:-1][np.diff(block.off) > 0]
        first[starts] = gone[starts]
        spans = np.r_[np.int32(0), np.cumsum(first, dtype=np.int32)]
        kept = [_kept(spec, block, gone, i) for i in range(n)]
        out = {"doc_id": block.table["__id"].combine_chunks(), "n_symbols": pa.array(np.diff(block.off), pa.int64()),
               "n_removed": pa.array(total[block.off[1:]] - total[block.off[:-1]], pa.int64()),
               "n_spans": pa.array(spans[block.off[1:]] - spans[block.off[:-1]], pa.int64()),
               "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if text:
            out["kept"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            out["__row"] = block.table["__row"].combine_chunks()
        return pa.table(out)
    return run


def _repeats(spec: Spec, n_buckets: int, n_shards: int) -> Callable:
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(spec, docs)
        is_anchor = back["kind"].to_numpy() == 0
        doc, pos, size, _, _, rid = _occurrences(
            spec, block, back.filter(pa.array(is_anchor)), back.filter(pa.array(~is_anchor)), n_buckets, n_shards)
        ids = block.table["__id"].combine_chunks()
        ends = zip(block.byte_off[:-1].tolist(), block.byte_off[1:].tolist())
        rows = np.array([xxhash.xxh3_64_intdigest(block.raw[a:b].tobytes()) for a, b in ends], np.uint64).view(np.int64)
        return pa.table({"repeat_id": pa.array(rid.view(np.int64), pa.int64()), "doc_id": ids.take(pa.array(doc)),
                         "row": pa.array(rows[doc], pa.int64()),
                         "start": pa.array(pos - block.off[doc] if len(doc) else pos, pa.int64()), "length": pa.array(size, pa.int64())})
    return run


def find(docs: DataFrame, spec: Spec, finder: Finder, *, output: str, block_bytes: int, shard_windows: int,
         keep_row: bool = False) -> DataFrame:
    """``output`` "report": a row per document; "repeats": a row per occurrence of a repeat, ``row`` hashes its text."""
    n = max(1, -(-text_bytes(docs) // block_bytes))
    # a bucket holds 4 bytes for each anchor of so many blocks' worth of text, a shard the contexts of theirs that recur:
    # megabytes each, and far fewer rows than blocks times blocks
    n_buckets, n_shards = -(-n // BLOCKS_PER_BUCKET), -(-n // BLOCKS_PER_SHARD)
    cols = [F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)),
                              F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n)).alias("__block"),
            F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("binary").alias("__text")]
    if keep_row:
        # the text itself is in __text
        cols.append(F.struct(F.col("text").isNull().alias("no_text"), F.struct(*(c for c in docs.columns if c != "text")).alias("rest")).alias("__row"))
    blocks = docs.select(*cols)

    anchors = blocks.groupBy("__block").applyInArrow(
        tidied_group(_anchor_rows(spec, n_buckets)), "bucket long, __block long, hashes binary, twice binary")
    recurring = anchors.groupBy("bucket").applyInArrow(tidied_group(_recurring), "bucket long, __block long, hashes binary")
    contexts = blocks.groupBy("__block").cogroup(recurring.groupBy("__block")).applyInArrow(
        tidied_pair(_context_rows(spec, n_buckets, n_shards)), _CONTEXT_SCHEMA)
    answers = contexts.groupBy("shard").applyInArrow(tidied_group(_shard_answers(spec, finder, shard_windows, output == "repeats")), _ANSWER_SCHEMA)

    none = F.lit(None).cast("binary")
    back = recurring.select(F.lit(0).alias("kind"), "__block", "bucket", "hashes", F.lit(0).cast("long").alias("shard"),
                            *(none.alias(c) for c in ("item", "at", "size", "first_doc", "first_start", "repeat_id"))
                            ).unionByName(answers.select(F.lit(1).alias("kind"), "__block", F.lit(0).cast("long").alias("bucket"),
                                                         none.alias("hashes"), "shard", "item", "at", "size", "first_doc",
                                                         "first_start", "repeat_id"))
    pair = blocks.groupBy("__block").cogroup(back.groupBy("__block"))
    if output == "repeats":
        return pair.applyInArrow(tidied_pair(_repeats(spec, n_buckets, n_shards)), "repeat_id long, doc_id long, row long, start long, length long")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_symbols", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])
    if keep_row:
        schema = schema.add("kept", T.StringType()).add("__row", blocks.schema["__row"].dataType)
    return pair.applyInArrow(tidied_pair(_report(spec, n_buckets, n_shards, keep_row)), schema)
