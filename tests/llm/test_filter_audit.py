"""Operator 12 against filters applied one after the other, and its intervals."""
from itertools import permutations

import brute
from odd_tables import labels, nothing, odd, odd_rows  # noqa: F401  (fixtures)

from loanlens.llm import op12_filter_audit as audit

SF_SMALL = "/root/testdata/sf0.001"


def test_intervals_are_the_orders_in_which_a_mask_leaves_at_a_step():
    orders = sorted(permutations(range(5)))
    owned = {}
    for mask, step, lo, hi in audit.intervals():
        assert lo < hi
        owned.setdefault((mask, step), []).extend(range(lo, hi))
    for mask in range(32):
        for step in range(5):
            want = [r for r, o in enumerate(orders) if mask >> o[step] & 1 and not any(mask >> f & 1 for f in o[:step])]
            assert owned.get((mask, step), []) == want


def test_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    marks = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    brute.same(audit.audit(docs, marks).collect(), brute.audit(rows, [(r.doc_id, r.quality, r.toxic) for r in marks.collect()]))


def test_odd_rows(spark, odd, nothing, labels):  # noqa: F811
    docs = odd.withColumns({c: odd["row"] for c in ("id", "part", "mask", "digest", "first", "good", "toxic", "words", "bits", "n")})
    marks = labels.withColumns({c: labels["quality"] for c in ("id", "good", "text", "source", "part")})
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    want = brute.audit(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    brute.same(audit.audit(docs, marks).collect(), want)
    assert audit.audit(nothing, labels).count() == 0
    assert all(r.good_lost == 0 and r.toxic_lost == 0 for r in audit.audit(odd, labels.limit(0)).collect())


def test_a_hot_text_and_many_parts(spark):
    """A third of the rows hold one text; its duplicates are counted in every part."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same words here', concat('text ', id)) AS text", "concat('s', id % 500) AS source")
    found = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    last = found.where("filter_order = 'EABCD' AND step = 1").groupBy().sum("removed", "kept").first()
    assert found.count() == 500 * 600 and tuple(last) == (9_999, 20_001)
    none_left = found.where("filter_order = 'ABCDE' AND step = 5").groupBy().sum("removed", "redundant").first()
    assert tuple(none_left) == (0, 9_999)           # all texts are short, so the first filter has taken them
