from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark.operators import scores
from evalspark.plans import scorecard as S

SCHEMA = (
    "agent_name string, case_pos int, case_id string, tier string, category string, error string, exec_match boolean, "
    "judged boolean, factual_accuracy int, completeness int, no_hallucination int, golden_bytes bigint, agent_bytes bigint"
)


def case(pos, tier="T1", category="business_logic", match=True, dims=(1, 1, 1), golden=100, agent=100, error=None, name="a"):
    judged = dims is not None
    return (name, pos, f"c{pos}", tier, category, error, match, judged, *(dims or (None,) * 3), golden, agent)


def card(spark, rows, **options):
    return S.scorecard(spark.createDataFrame(rows, SCHEMA), **options).first()


def full(headline=5, trust=5, calibration=5, n=5):
    """n cases per aggregate of which the given numbers pass."""
    rows = [case(i, "T1", "efficiency", i < headline) for i in range(n)]
    rows += [case(10 + i, "T2", "business_logic", i < trust) for i in range(n)]
    rows += [case(20 + i, "T3", "refusal_scope", False, (1, 1, 1) if i < calibration else (1, 0, 1)) for i in range(n)]
    return rows


@pytest.mark.parametrize("passed,verdict", [
    ((5, 5, 5), "promote"), ((4, 5, 5), "investigate"), ((5, 4, 5), "do_not_promote"), ((5, 5, 3), "do_not_promote"),
    ((5, 5, 4), "promote"), ((4, 4, 3), "do_not_promote"),
])
def test_verdicts(spark, passed, verdict):
    assert card(spark, full(*passed))["verdict"] == verdict


def test_thin_corpus_is_incomplete_whatever_the_rates(spark):
    got = card(spark, full(4, 4, 4, 4))
    assert got["verdict"] == "incomplete" and got["insufficient"] == "headline, trust-critical, calibration"
    assert card(spark, full(4, 4, 4, 4), minimum=4)["verdict"] == "promote"


def test_one_case_may_feed_several_aggregates(spark):
    got = card(spark, [case(1, "T1", "business_logic")])
    assert (got["headline_total"], got["trust_total"], got["calibration_total"]) == (1, 1, 0)
    assert got["calibration_rate"] is None and got["calibration_status"] == "na"


def test_errored_cases_stay_in_the_totals(spark):
    rows = [case(1), case(2, match=False, dims=None, error="peak_sql: empty SQL", golden=None, agent=None)]
    assert card(spark, rows)["headline_total"] == 2
    assert card(spark, rows, exclude_golden_errors=True)["headline_total"] == 1


def test_failures_ties_keep_first_seen_order_and_calibration_is_excused(spark):
    rows = [
        case(1, category="temporal_logic", match=False), case(2, category="schema_selection", match=False),
        case(3, category="efficiency", match=False), case(4, category="silent_wrongness", match=False),
        case(5, category="silent_wrongness", match=False), case(6, category="refusal_scope", match=False),
        case(7, category="refusal_scope", match=False, dims=(0, 1, 1)),
    ]
    assert card(spark, rows)["top_failures"] == "silent_wrongness (2), temporal_logic (1), schema_selection (1)"


def test_efficiency_and_faithfulness(spark):
    rows = [
        case(1, golden=100, agent=200), case(2, golden=100, agent=50), case(3, golden=0, agent=50),
        case(4, match=False, golden=1, agent=100), case(5, golden=100, agent=125, dims=(1, 0, 0)), case(6, dims=None),
    ]
    got = card(spark, rows)
    assert got["efficiency_median"] == pytest.approx((0.8 + 1.0) / 2)
    assert got["faithfulness"] == pytest.approx((3 * 4 + 1) / 5)
    nothing = card(spark, [case(1, match=False, dims=None)])
    assert nothing["efficiency_median"] is None and nothing["faithfulness"] is None


@pytest.mark.parametrize("golden,agent,match,label", [
    (100, 90, True, "better"), (100, 91, True, "comparable"), (100, 109, True, "comparable"), (100, 110, True, "worse"),
    (0, 5, True, "comparable"), (100, 10, False, "n/a"),
])
def test_optimization_label(spark, golden, agent, match, label):
    row = scores.score_efficiency(spark.createDataFrame([case(1, match=match, golden=golden, agent=agent)], SCHEMA)).first()
    assert row["optimization"] == label


def test_review_candidates(spark):
    rows = [
        case(1, golden=100, agent=62), case(2, match=False), case(3, dims=None), case(4, dims=(1, 0, 1)),
        case(5, golden=0), case(6),
    ]
    got = {r["case_pos"]: (r["review"], r["reason"]) for r in scores.review_candidates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: (True, "same result with -38% bytes"), 2: (False, "results differ"), 3: (False, "no verdict"),
        4: (False, "method not sound"), 5: (False, "golden size unknown"), 6: (False, "not clearly cheaper"),
    }


def test_case_status_takes_the_first_error(spark):
    table = spark.createDataFrame(
        [("g", "a", "j", True), (None, "a", "j", True), (None, None, "j", True), (None, None, None, True)],
        "golden_error string, agent_error string, judge_error string, matched boolean",
    )
    got = [(r["error"], r["exec_match"], r["judged"]) for r in scores.case_status(table).collect()]
    assert got == [
        ("peak_sql: g", False, False), ("agent_sql: a", False, False), ("judge: j", True, False), (None, True, True),
    ]


def test_wilson_interval_holds_back_a_hard_verdict(spark):
    cards = S.scorecard(spark.createDataFrame(full(), SCHEMA))
    row = S.wilson_verdict(cards).first()
    assert row["verdict"] == "promote" and row["honest_verdict"] == "investigate"
    assert row["headline_low"] == pytest.approx(0.5655, abs=1e-3) and row["headline_high"] == pytest.approx(1.0)


def test_category_flags(spark):
    rows = [case(1, category="business_logic"), case(2, category="refusal_scope"), case(3, category="unknown")]
    got = {r["case_pos"]: (r["trust_critical"], r["calibration"], r["title"]) for r in
           scores.with_category(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (True, False, "Business logic & domain knowledge")
    assert got[2][1] is True and got[3] == (None, None, None)
    assert scores.category_dim(spark).filter(F.col("trust_critical")).count() == 6
