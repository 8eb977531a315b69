import math

import pytest

from posttide.functions import tdist
from posttide.operators import hypothesis


def labelled(spark, groups):
    rows = [(c, s) for c, labels in groups.items() for s in labels]
    return spark.createDataFrame(rows, "country string, sentiment string")


P, N = "POSITIVE", "NEGATIVE"


def test_t_tail():
    assert abs(tdist.two_sided_p(2.776445, 4) - 0.05) < 1e-6
    assert abs(tdist.two_sided_p(0.0, 7) - 1) < 1e-12
    assert abs(tdist.two_sided_p(1.0, 1) - 0.5) < 1e-12
    assert abs(tdist.two_sided_p(-1.96, 1e7) - 0.05) < 1e-4
    assert tdist.two_sided_p(math.inf, 3) == 0.0 and math.isnan(tdist.two_sided_p(math.nan, 3))
    assert abs(tdist.upper_critical(0.05, 4) - 2.131847) < 1e-6
    assert abs(tdist.upper_critical(0.95, 4) + 2.131847) < 1e-6


@pytest.mark.parametrize("t,dof", [(0.3, 2), (2.5, 11), (12.0, 40), (1.0, 5000)])
def test_t_tail_against_integral(t, dof):
    start, steps = math.atan(t / math.sqrt(dof)), 200_000

    def area(low):
        h = (math.pi / 2 - low) / steps
        return h * sum(math.cos(low + (i + 0.5) * h) ** (dof - 1) for i in range(steps))

    assert abs(tdist.two_sided_p(t, dof) - area(start) / area(0.0)) < 1e-7


def test_bias_test_edges(spark):
    df = labelled(spark, {"hole": [P, P, N, None], "one": [P], "equal": [P, P, P], "even": [P, N, P, P, P, N, P, P]})
    rows = {r["Country"]: r for r in hypothesis.sentiment_bias_test(df).collect()}
    assert math.isnan(rows["hole"]["p"]) and rows["hole"]["Null Hypothesis"] == "Reject"
    assert rows["hole"]["Negative Sentiment Ratio"] == 0.25
    assert math.isnan(rows["one"]["p"]) and rows["one"]["Null Hypothesis"] == "Reject"
    assert math.isinf(rows["equal"]["t-statistic"]) and rows["equal"]["p"] == 0.0
    assert rows["even"]["t-statistic"] == 0.0 and rows["even"]["Null Hypothesis"] == "Accept"
    assert hypothesis.rejected_ratio(hypothesis.sentiment_bias_test(df)).first()[0] == 0.25


def test_omit_leaves_nulls_out(spark):
    df = labelled(spark, {"hole": [P, P, N, None]})
    row = hypothesis.sentiment_bias_test(df, nulls="omit").first()
    assert not math.isnan(row["p"])


def test_bias_test_is_ordered_and_cut(spark):
    df = labelled(spark, {f"c{i:02d}": [P, N] * (i // 2 + 1) for i in range(8)})
    found = [r["Country"] for r in hypothesis.sentiment_bias_test(df, k=3).collect()]
    assert found == ["c06", "c07", "c04"]


def test_accuracy_test(spark):
    folds = spark.createDataFrame([(a,) for a in (0.8, 0.82, 0.78, 0.81, 0.79)], "accuracy double")
    row = hypothesis.accuracy_test(folds).first()
    sd = math.sqrt(sum((a - 0.8) ** 2 for a in (0.8, 0.82, 0.78, 0.81, 0.79)) / 5)
    assert abs(row["sd"] - sd) < 1e-12 and abs(row["t"] - (0.8 - 0.333) / (sd / math.sqrt(5))) < 1e-6
    assert row["reject"] is True


def test_accuracy_test_without_spread(spark):
    same = spark.createDataFrame([(0.9,)] * 5, "accuracy double")
    assert math.isinf(hypothesis.accuracy_test(same).first()["t"])
    single = spark.createDataFrame([(0.9,)], "accuracy double")
    assert hypothesis.accuracy_test(single).first()["reject"] is False


@pytest.mark.parametrize("dof", [1e9, 1e10, 1e11, 1e12, 1e13])
def test_tail_of_large_groups_is_the_normal_tail(dof):
    for t in (0.1, 1.0, 1.96, 3.0):
        normal = math.erfc(t / math.sqrt(2))
        assert abs(tdist.two_sided_p(t, dof) - normal) < 1e-9


@pytest.mark.parametrize("dof", [1e4, 1e6, 9e7])
def test_tail_meets_its_expansion(dof):
    for t in (0.1, 1.0, 1.96, 3.0):
        assert tdist.two_sided_p(t, dof) == pytest.approx(tdist._near_normal(t, dof), rel=1e-7 if dof > 1e5 else 1e-5)
