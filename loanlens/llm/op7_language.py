"""Operator 7: language of web pages by Bayesian fusion of evidence.

log P(l | page) = log P(text | l) / T + log P(declared | l) + log P(l | host) + constant, over the languages of ``documents.lang``:

* text: byte trigrams of the page's text (without navigation, scripts and the
  like), with the trigram counts of all documents of a language; divided by
  T, as neighbouring trigrams overlap and are not independent;
* declared: the language in the page's markup; how far to trust it is counted
  over all pages, by the language of their text;
* host: pages' text languages counted by host, smoothed towards those of
  the address suffix (a language code that starts the path, else the last label
  of the host), which are smoothed towards those of all pages. A page's own text
  is left out of its prior, so no evidence counts twice.

Counts are grouped aggregates; hosts and suffixes are joined, not broadcast.
Only tables whose size the languages bound go to the driver: 64 KB of trigram
weights a language, and counts of language pairs that occur. Any number of
languages is taken; a task counts ``LANGUAGES_AT_ONCE`` before it sends them on.

Defined cases: null or blank html has no text and no declaration, a null or
malformed url no host and no suffix; evidence that a page lacks is left out, so a
page with none gets the most frequent language; a declared language that no
document has counts as one value, "other"; repeated pages count each and get one
result each; a very long page is read whole, in a slice of its own; ties go to the first language in
order; documents without lang or text teach nothing; without any language, an
empty ``documents`` table for one, language and probability are null; an empty
``pages`` table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import materialized, pieces, read_table, tidied

LANGUAGES_AT_ONCE = 64
GRAMS = 1 << 14
TEMPER = 3.0
SMOOTH = 5.0                    # pages that a parent's share counts as
PIECE_ROWS = 500

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_HIDDEN = re.compile(r"<(script|style|nav|aside|footer|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
_PATH_CODE = re.compile(r"/([a-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram buckets, text of each) of all texts; no trigram goes over two texts or holds two spaces."""
    flat = np.frombuffer(b"  ".join(t.translate(_FOLD) for t in texts) + b"  ", np.uint8).astype(np.uint32)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    spaces = flat == 32
    ok = np.flatnonzero(spaces[:-2].astype(np.int8) + spaces[1:-1] + spaces[2:] < 2)
    code = flat[ok] | flat[ok + 1] << np.uint32(8) | flat[ok + 2] << np.uint32(16)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(18)
    return bucket.astype(np.int64), np.searchsorted(np.cumsum(size), ok, side="right")


def visible_text(page: str) -> bytes:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page))).encode("utf-8", "replace")


def address(url: str | None) -> tuple[str | None, str | None]:
    """(host, suffix): the suffix is a language code that starts the path, else the host's last label."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or None
    except ValueError:
        return None, None
    code = _PATH_CODE.match(parts.path) if host else None
    return host, ("/" + code[1] if code else host.rsplit(".", 1)[-1]) if host else None


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the partition by language."""
    total: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])],
                                             names=["lang", "gram", "n"])
        total.clear()
    for whole in batches:
        for batch in pieces(whole, 1, PIECE_ROWS):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                total[lang] = total.get(lang, 0) + np.bincount(grams(texts)[0], minlength=GRAMS)
                if len(total) >= LANGUAGES_AT_ONCE:
                    yield from sent()
    yield from sent()


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)), from all documents."""
    src = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    languages = sorted(r.lang for r in src.select("lang").distinct().collect())
    rows = src.mapInArrow(tidied(_learn), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((len(languages), GRAMS))
    if rows.num_rows:
        at = np.searchsorted(np.array(languages), np.array(rows["lang"].to_pylist()))
        count[at, rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return languages, np.log((count + 1) / (count.sum(1, keepdims=True) + GRAMS))


def _read(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logp = model.value
        known = set(languages)
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_ROWS):
                pages = batch.column(2).to_pylist()
                bucket, row = grams([visible_text(p or "") for p in pages])
                like = np.zeros((len(pages), len(languages)))
                for j in range(len(languages)):
                    like[:, j] = np.bincount(row, logp[j][bucket], len(pages))
                some = np.bincount(row, minlength=len(pages)) > 0
                best = like.argmax(1) if languages else np.zeros(len(pages), int)
                found = [_DECLARED.search(p or "") for p in pages]
                declared = [None if m is None else m[1].lower() if m[1].lower() in known else "other" for m in found]
                where = [address(u) for u in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([h for h, _ in where], pa.string()), pa.array([s for _, s in where], pa.string()),
                     pa.array(declared, pa.string()),
                     pa.array([languages[b] if ok and languages else None for b, ok in zip(best.tolist(), some.tolist())], pa.string()),
                     pa.array(list(like), pa.list_(pa.float64()))],
                    names=["page_id", "host", "suffix", "declared", "text_language", "likelihood"])
    return run


def _by(pages: DataFrame, key: str) -> DataFrame:
    """Per value of ``key``: the number of pages in each language that occurs there, by their text."""
    counts = pages.where(F.col(key).isNotNull() & F.col("text_language").isNotNull()).groupBy(key, "text_language").count()
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_language", "count"))).alias(f"by_{key}"))


def _fuse(languages: list[str], overall: np.ndarray, trust: dict[str, np.ndarray]) -> Callable:
    number = {x: j for j, x in enumerate(languages)}
    root = (overall + 1) / (overall.sum() + len(languages))

    def prior(own: int | None, *levels: list[tuple[str, int]] | None) -> np.ndarray:
        """From the most general level to the host; each without the page itself."""
        p = root
        for counts in levels:
            if counts is not None:
                n = np.zeros(len(languages))
                for language, pages in counts:
                    n[number[language]] = pages
                if own is not None:
                    n[own] -= 1
                p = (n + SMOOTH * p) / (n.sum() + SMOOTH)
        return p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(j).to_pylist() for j, n in enumerate(batch.schema.names)}
            language, probability = [], []
            for text, declared, like, suffix, host in zip(*(col[c] for c in ("text_language", "declared", "likelihood", "by_suffix", "by_host"))):
                z = np.log(prior(number.get(text), suffix, host))
                if text is not None:
                    z = z + np.array(like) / TEMPER
                if declared is not None:
                    z = z + np.log(trust[declared])
                best = int(z.argmax())
                language.append(languages[best])
                probability.append(float(1 / np.exp(z - z[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(language, pa.string()), pa.array(probability, pa.float64()),
                 *(pa.array(col[c], pa.string()) for c in ("text_language", "declared", "host", "suffix"))],
                names=["page_id", "language", "probability", "text_language", "declared", "host", "suffix"])
    return run


_RESULT = "page_id long, language string, probability double, text_language string, declared string, host string, suffix string"


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, its probability, and the evidence: text_language, declared, host, suffix."""
    sc = pages.sparkSession.sparkContext
    languages, logp = text_model(docs)
    read = materialized(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _read(sc.broadcast((languages, logp))),
        "page_id long, host string, suffix string, declared string, text_language string, likelihood array<double>"))
    if not languages:
        return read.select("page_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"),
                           "text_language", "declared", "host", "suffix")
    # of the pairs of languages, those that occur
    pairs = read.groupBy("declared", "text_language").count().collect()
    number = {x: j for j, x in enumerate(languages)}
    overall = np.zeros(len(languages))
    table = {d: np.zeros(len(languages)) for d in [*languages, "other"]}
    for r in pairs:
        if r.text_language is not None:
            overall[number[r.text_language]] += r["count"]
            if r.declared is not None:
                table[r.declared][number[r.text_language]] += r["count"]
    declared_pages = sum(table.values())
    share = {d: (n.sum() + 1) / (declared_pages.sum() + len(table)) for d, n in table.items()}
    trust = {d: (n + SMOOTH * share[d]) / (declared_pages + SMOOTH) for d, n in table.items()}
    by_suffix, by_host = (materialized(_by(read, key)) for key in ("suffix", "host"))
    joined = read.join(by_suffix, "suffix", "left").join(by_host, "host", "left")
    return joined.select("page_id", "host", "suffix", "declared", "text_language", "likelihood", "by_suffix", "by_host").mapInArrow(
        _fuse(languages, overall, trust), _RESULT)


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
