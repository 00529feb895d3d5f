"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator has a defined result."""
import brute
import pytest
from pyspark.sql import functions as F
from odd_tables import benchmark, labels, nothing, odd  # noqa: F401  (fixtures)

import corpus_pipeline
from loanlens.llm import (
    op1_decontaminate, op2_order_minhash, op3_toxicity, op4_quality, op5_licenses, op6_repeats, op7_language, op8_automata,
    op9_minhash, op10_sentencepiece)

SF_SMALL = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_op1(odd, nothing, benchmark):
    rows, items = pairs(odd), [(r.item_id, r.text) for r in benchmark.collect()]
    found = op1_decontaminate.contamination(odd, benchmark).drop("spans").collect()
    brute.same(found, brute.contaminated(rows, items))
    in_blocks = op1_decontaminate.contamination(odd, benchmark, block_bytes=100).drop("spans").collect()
    brute.same(in_blocks, [tuple(r) for r in found])
    assert op1_decontaminate.contamination(nothing, benchmark).count() == 0
    assert not any(r.contaminated for r in op1_decontaminate.contamination(odd, benchmark.limit(0)).collect())
    kept = op1_decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == sum(not r.contaminated for r in found)


def test_op1_spans_are_merged_word_ranges(spark):
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(20)) + " c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(15))), (2, "b")], "item_id long, text string")
    r = op1_decontaminate.contamination(docs, items).first()
    assert (r.n_hit, r.n_items, [tuple(s) for s in r.spans]) == (16, 2, [(1, 17)])


def test_op2(odd, nothing):
    rows = op2_order_minhash.order_minhash(odd).collect()
    assert len(rows) == odd.count()
    named = sorted(((d, t or "") for d, t in pairs(odd) if d is not None), key=lambda x: (-x[0], x[1].encode()))
    first = named[0][1]
    for (d, t), (_, follows) in zip(named, named[1:]):
        n = len(t)
        assert any(r.doc_id == d and r.n_chars == n and r.edited_sha256 == brute.sha(t[:n - n // 3] + follows[:n // 3]) for r in rows)
    last = [r for r in rows if r.doc_id is None]
    ends = {brute.sha(t[:len(t) - len(t) // 3] + first[:len(t) // 3]) for t in ("", pairs(odd.where("doc_id = -5"))[0][1])}
    assert len(last) == 2 and any(r.edited_sha256 in ends for r in last)
    prints = {}
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (None, 4, 20)}
    for d, t in pairs(odd):
        if d in by_id:
            assert prints.setdefault(t or "", by_id[d].fingerprint) == by_id[d].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert by_id[2].near_next == 1.0 and by_id[1].fingerprint == by_id[2].fingerprint
    assert op2_order_minhash.order_minhash(nothing).count() == 0
    one = op2_order_minhash.order_minhash(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_op3(odd, nothing, labels):
    rows = op3_toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in op3_toxicity.CATEGORIES)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert op3_toxicity.toxicity(nothing, labels).count() == 0
    assert op3_toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()


def test_op4(odd, nothing, labels):
    rows = op4_quality.scored(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert op4_quality.scored(nothing, labels).count() == 0
    assert {r.score for r in op4_quality.scored(odd, labels.limit(0)).collect()} == {1.0}
    kept = op4_quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)


CLASHING = ("label", "__id", "__doc", "__text", "bucket", "node", "doc", "name", "good", "quality", "toxic", "n", "x", "at")


@pytest.mark.parametrize("run", [
    lambda d, b, m: op1_decontaminate.decontaminate(d, b), lambda d, b, m: op2_order_minhash.order_minhash(d), lambda d, b, m: op3_toxicity.toxicity(d, m),
    lambda d, b, m: op4_quality.scored(d, m), lambda d, b, m: op4_quality.keep_good(d, m), lambda d, b, m: op5_licenses.scanned(d),
    lambda d, b, m: op6_repeats.removal_report(d), lambda d, b, m: op6_repeats.dedup(d), lambda d, b, m: op8_automata.removal_report(d),
    lambda d, b, m: op9_minhash.near_duplicates(d), lambda d, b, m: op9_minhash.dedup(d), lambda d, b, m: op10_sentencepiece.encode(d)], ids=range(12))
def test_clashing_names_on_every_table(odd, benchmark, labels, run):
    """Extra columns with the names that operators use inside, on documents, benchmark and labels: same result as without them."""
    more = lambda df: df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})
    got, want = run(more(odd), more(benchmark), more(labels)), run(odd, benchmark, labels)
    assert [c for c in got.columns if c not in CLASHING or c in want.columns] == want.columns
    brute.same(map(str, got.select(want.columns).collect()), [tuple(str(r)) for r in want.collect()])


def test_op7_takes_any_number_of_languages(spark):
    word = lambda i: "".join(chr(97 + i // 7 ** k % 7 + 7 * k) for k in range(3)) * 3
    docs = spark.createDataFrame([(i, f"{word(i)} " * 20, f"l{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"https://h{i}.x/", f"<p>{f'{word(i)} ' * 30}</p>") for i in range(0, 300, 50)], "page_id long, url string, html string")
    rows = op7_language.page_languages(pages, docs).collect()
    assert {r.page_id: r.text_language for r in rows} == {i: f"l{i:03}" for i in range(0, 300, 50)}


def test_op5(odd, nothing):
    rows = op5_licenses.scanned(odd).collect()
    assert len(rows) == odd.count() and all(r.licenses == [] and not r.restricted for r in rows)
    assert op5_licenses.scanned(nothing).count() == 0


def test_op6(odd, nothing):
    rows = pairs(odd)
    brute.same(op6_repeats.removal_report(odd).collect(), brute.removed_bytes(rows))
    assert op6_repeats.removal_report(nothing).count() == 0
    done = op6_repeats.dedup(odd)
    assert done.schema == odd.schema and done.count() == odd.count()
    assert {r.doc_id: r.text for r in done.where("doc_id IN (2, 7, -5)").collect()} == {
        2: "", 7: None, -5: odd.where("doc_id = -5").first().text}


def test_op7(spark, nothing):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "http://[bad", "<html lang='xx'>"), (3, "https://a.de/de/x", "<p>die</p>"),
         (3, "https://a.de/de/x", "<p>die</p>"), (None, "", ""), (4, "https://a.de", "<html lang=en><script>if (a<b) x()</script>" + "w " * 50_000)],
        "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "the of and it", "en"), (2, "der die das ist", "de"), (3, None, "fr"), (4, "x", None)],
                                 "doc_id long, text string, lang string")
    rows = op7_language.page_languages(pages, docs).collect()
    assert len(rows) == 6 and all(r.language in ("de", "en") and 0 < r.probability <= 1 for r in rows)
    assert [r.language for r in rows if r.page_id == 3] == ["de", "de"]
    assert {r.declared for r in rows if r.page_id == 2} == {"other"}
    assert op7_language.page_languages(pages.limit(0), docs).count() == 0
    assert {r.language for r in op7_language.page_languages(pages, nothing).collect()} == {None}


def test_op8(odd, nothing):
    rows = pairs(odd)
    brute.same(op8_automata.removal_report(odd).collect(), brute.removed_words(rows))
    assert op8_automata.removal_report(nothing).count() == 0
    assert op8_automata.dedup(odd).schema == odd.schema


def test_op9(odd, nothing):
    rows = pairs(odd)
    found = op9_minhash.near_duplicates(odd)
    brute.same([r[:3] for r in found.collect()], brute.near(rows))
    assert op9_minhash.near_duplicates(nothing).count() == 0
    kept = op9_minhash.dedup(odd)
    ids = {c for _, _, c in brute.near(rows) if c is not None}
    assert kept.schema == odd.schema
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(ids)
    assert kept.where("doc_id IS NULL").count() == 2


def test_op10(odd, nothing):
    rows = op10_sentencepiece.encoding_report(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.exact is None and r.ids is None for r in rows if r.n_chars is None)
    assert all(r.exact for r in rows if r.n_chars is not None)
    assert op10_sentencepiece.encoding_report(nothing).count() == 0
    back = op10_sentencepiece.decode(op10_sentencepiece.encode(odd).drop("text"))
    brute.same([(r.doc_id, r.text) for r in back.collect()], pairs(odd))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, odd, nothing, tmp_path, empty):
    """Each stage keeps the columns and judges what its predecessor kept."""
    docs = (nothing if empty else odd).drop("row", "ids", "score", "block", "kept", "__row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.schema == docs.schema, name
        out.write.parquet(str(tmp_path / name))
        assert (after := spark.read.parquet(str(tmp_path / name))).count() <= docs.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
