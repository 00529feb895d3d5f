"""Operator 11 against the vocabularies' own libraries, and its parts."""
import random

import brute
import public_tokenizers
import pytest
import sentencepiece
from odd_tables import nothing, odd, odd_rows, prose  # noqa: F401  (fixtures)
from tokenizers import Tokenizer

from loanlens.llm import op11_alignment
from loanlens.llm.op11_alignment import Aligner, Fragment, composed, finished

SF_SMALL, SF_LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def aligner():
    return Aligner(op11_alignment.load_files())


@pytest.fixture(scope="module")
def expected(aligner):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda texts: brute.aligned(texts, lambda t: a.encode(t, add_special_tokens=False).ids, aligner.a.bytes_of, b.encode, aligner.b.bytes_of)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


TEXTS = ["x" * 5000, "a ▁ b", " ", "  x  y ", "\x00 a\x00b", "<|endoftext|> hi <s> </s> <unk> <0x0A>", "é" * 300 + " é a b" * 100, "ab " * 900,
         " \n\t " * 700 + "z", "中文字" * 400, "𓀀 " * 50, "it's we'll 'tis 12 345", " " * 1000 + "end", prose(random.Random(1), 600)]


def test_token_bytes_give_the_vocabulary(aligner):
    assert aligner.a.fast is not None and aligner.cuts_allowed
    assert len(set(aligner.a.bytes_of)) == len(aligner.a.bytes_of) == 50257
    assert aligner.b.bytes_of[3:259] == [bytes([x]) for x in range(256)]


@pytest.mark.parametrize("chunk", [1 << 30, 700, 64, 7])
def test_any_bracketing_of_any_ranges_is_the_whole_text(aligner, expected, chunk):
    rng = random.Random(chunk)
    for text, want in zip(TEXTS, [expected([t])[0] for t in TEXTS]):
        data = (" " + text).encode()
        ranges = aligner.ranges(data, chunk)
        assert ranges[0][2] == 0 and ranges[-1][3] == len(data) and all(x[3] == y[2] for x, y in zip(ranges, ranges[1:]))
        assert sum(b - a for a, b, _, _ in ranges) <= 2 * len(data) + 2 * chunk + 600
        parts = aligner.fragments([(data[a:b].decode(), lo - a, hi - a) for a, b, lo, hi in ranges])
        while len(parts) > 1:
            at = rng.randrange(len(parts))
            parts[at:at + 3] = [composed(parts[at:at + 3])]
        done = finished(parts[0])
        assert (*done[:4], done[6]) == (*want[:4], want[6])


def test_fragments_without_a_common_end_stay_open(aligner):
    """Ranges of one byte inside a token: nothing ends there."""
    word = " " + "abcdefgh" * 3
    parts = aligner.fragments([(word, i, i + 1) for i in range(len(word))])
    assert any(not x.cut for x in parts)
    whole = aligner.fragments([(word, 0, len(word))])[0]
    assert finished(composed(parts))[6] == finished(whole)[6]
    assert finished(composed([Fragment(), whole, Fragment()]))[6] == finished(whole)[6]


@pytest.mark.parametrize("chunk, sent", [(1 << 16, 1 << 20), (200, 1 << 20), (200, 40), (1 << 16, 0)])
def test_whole_table_equals_brute_force(spark, expected, chunk, sent):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = rows_of(docs)
    found = op11_alignment.alignment(docs, chunk=chunk, sent_pairs=sent)
    brute.same(rows_of(found), [(d, *x) for (d, _), x in zip(rows, expected([t for _, t in rows]))])


def test_odd_rows(spark, odd, nothing, expected):  # noqa: F811
    rows = [(r[0], r[1]) for r in odd_rows()] + [(30 + i, t) for i, t in enumerate(TEXTS)]
    extra = spark.createDataFrame(rows[len(odd_rows()):], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True).withColumns({c: odd["row"] for c in ("k", "codes", "code", "links", "lo", "closed")})
    want = [(d, *x) for (d, _), x in zip(rows, expected([t for _, t in rows]))]
    for chunk in (1 << 16, 500):
        brute.same(rows_of(op11_alignment.alignment(docs, chunk=chunk)), want)
    assert op11_alignment.alignment(nothing).count() == 0


def test_a_very_long_text(spark, aligner):
    """8 MB in 128 ranges, two levels of the tree; the same text in one range."""
    text = " ".join([prose(random.Random(2), 4000)] * 320)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = op11_alignment.alignment(docs).first()
    whole = finished(aligner.fragments([(" " + text, 0, len(text.encode()) + 1)])[0])
    assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*whole[:4], whole[6])


def test_both_encoders_of_the_byte_level_vocabulary_agree(aligner):
    import pyarrow.parquet as pq
    for text in pq.read_table(f"{SF_LARGE}/documents.parquet", columns=["text"])["text"].to_pylist()[::7]:
        assert aligner.a.encode(" " + text).tolist() == aligner.a.slow.encode(" " + text, add_special_tokens=False).ids
