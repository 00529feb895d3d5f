"""Operator 13 against plain measures, its policies and ablations."""
import brute
import pytest
from odd_tables import nothing, odd, odd_rows  # noqa: F401  (fixtures)

from loanlens.llm import op13_quality_rules as rules

SF_MID = "/root/testdata/sf0.01"


def verdicts(m):
    n, chars, symbols, lines, dups, repeats = m
    broken = [n < 50, repeats > n / 2, symbols > n / 10, chars < 3 * n, chars > 10 * n, 10 * dups > 3 * lines]
    return sum(b << i for i, b in enumerate(broken)), broken[0] or broken[1], not any(broken)


def test_odd_rows(spark, odd, nothing):  # noqa: F811
    extra = ["a b c a b c", "a b c x a b c", "a a a a", "a a", "l\nl\n\n \nl\nm", "#*$%&|<> x", "a\x0bb\x0cc d e", "\n" * 50]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).withColumns({c: odd["row"] for c in ("words", "windows", "lines", "at", "failed", *rules.MEASURES[:3])})
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(extra)]
    found = rules.judged(rules.ledger(docs)).collect()
    brute.same(found, [(d, *(m := brute.measures(t)), *verdicts(m)) for d, t in rows])
    assert rules.ledger(nothing).count() == 0
    empty = rules.ablations(rules.ledger(nothing)).collect()
    assert len(empty) == 6 and not any(r.fails or r.kept or r.any_document for r in empty)


def test_a_long_text(spark):
    text = " ".join(f"w{i % 90_001}" for i in range(200_000))
    r = rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(r)[1:7] == brute.measures(text)


@pytest.mark.parametrize("version", sorted(rules.POLICIES))
def test_policies_and_ablations_read_the_ledger_only(spark, version):
    policy = rules.POLICIES[version]
    book = rules.ledger(spark.read.parquet(f"{SF_MID}/documents.parquet")).cache()
    rows = [(r.failed, r) for r in book.collect()]
    mask = {r.name: r.mask for r in rules.RULES}
    kept = lambda names: sum(not any(f & mask[n] for n in names) for f, _ in rows)
    assert rules.judged(book, policy).where("kept").count() == kept(policy)
    for r in rules.ablations(book, policy).collect():
        rest = [n for n in policy if n != r.rule]
        assert (r.kept, r.kept_without) == (kept(policy), kept(rest)) and r.fails_alone == r.kept_without - r.kept
        assert r.fails == sum(bool(f & mask[r.rule]) for f, _ in rows)
        assert (r.any_document, r.every_document) == (r.fails > 0, r.fails == len(rows))


def test_no_python_and_no_exchange_in_the_ledger(spark):
    plan = rules.op13_quality_rules(spark, SF_MID)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_need_bits_of_their_own(spark, odd):  # noqa: F811
    with pytest.raises(ValueError):
        rules.ledger(odd, (rules.Rule(1, "a", "n_words < 1"), rules.Rule(1, "b", "n_words < 2")))
