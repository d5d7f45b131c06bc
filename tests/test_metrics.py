"""Hand-derived values for metrics, statuses and calibration."""

import pytest
from pyspark.sql import functions as F

from evenhand.operators import calibration as K
from evenhand.operators import metrics as M
from evenhand.operators.cells import calibration_cells, confusion_cells, merge_cells


def wide(df, gates=M.Gates(2), **kw):
    return M.disparity_wide(confusion_cells(df), gates, **kw).first()


def bits(s):
    return [int(c) for c in s]


def test_ten_row_performance(frame):
    r = M.global_performance(merge_cells(confusion_cells(frame(bits("1111000000"), bits("1100100000"), ["a"] * 10)))).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 2, 5)
    assert r.accuracy == pytest.approx(0.70)
    assert r.tpr == pytest.approx(0.5) and r.tnr == pytest.approx(5 / 6) and r.fpr == pytest.approx(1 / 6)
    assert r.ppv == pytest.approx(2 / 3) and r.balanced_accuracy == pytest.approx(2 / 3)
    assert r.f1_score == pytest.approx(4 / 7)


def test_eight_row_groups(frame):
    r = wide(frame(bits("11001100"), bits("10011100"), list("AAAABBBB")))
    assert r.dp_value == 0 and r.di_value == 1
    assert r.eo_value == pytest.approx(0.5) and r.eodds_value == pytest.approx(0.5) and r.pp_value == pytest.approx(0.5)
    assert {r[f"{s}_status"] for s in ("dp", "eo", "eodds", "pp", "di")} == {"VALID"}


def test_constant_and_perfect_predictors(frame):
    y, g = bits("11001000"), list("AAAABBBB")
    perfect = wide(frame(y, y, g))
    assert perfect.dp_value == pytest.approx(0.25) and perfect.di_value == pytest.approx(0.5) and perfect.eodds_value == 0
    inverted = wide(frame(y, [1 - v for v in y], g))
    assert inverted.eodds_value == 0 and inverted.eodds_status == "VALID"
    zero = wide(frame(y, [0] * 8, g))
    assert zero.di_value is None and zero.di_status == "UNDEFINED" and zero.pp_status == "UNDEFINED"
    one = wide(frame(y, [1] * 8, g))
    assert one.dp_value == 0 and one.di_value == 1


def test_sparse_and_empty_classes(frame):
    sparse = wide(frame(bits("110010"), bits("110010"), list("AAAAAB")))
    assert sparse.eodds_status == "INSUFFICIENT_GROUP_SUPPORT" and sparse.eodds_value is None
    no_pos = wide(frame(bits("110000"), bits("110010"), list("AAABBB")))
    assert no_pos.eo_status == "ZERO_POSITIVE_SUBGROUP" and no_pos.eodds_status == "ZERO_POSITIVE_SUBGROUP"
    no_neg = wide(frame(bits("110111"), bits("110011"), list("AAABBB")))
    assert no_neg.eodds_status == "ZERO_NEGATIVE_SUBGROUP" and no_neg.eo_status == "VALID"
    single = wide(frame(bits("10"), bits("10"), list("AA")), rates=True)
    assert single.dp_status == "MISSING_SENSITIVE" and single.selection_rates == {}


def test_disparities_of_many_groups_need_no_list_of_them(spark):
    """A million groups in one row of fixed size; who is lowest and highest is still known."""
    df = spark.range(4_000_000).selectExpr(
        "CAST(id % 1000000 AS STRING) AS grp", "CAST(id >= 2000000 AS INT) AS y_true", "CAST(id % 1000000 = 77 OR (id >= 2000000 AND id % 1000000 != 5) AS INT) AS y_pred")
    wide_ = M.disparity_wide(confusion_cells(df), M.Gates(1))
    assert "collect_list" not in wide_._jdf.queryExecution().optimizedPlan().toString()
    r = wide_.first()
    assert (r.groups, r.lowest_group, r.highest_group, r.dp_value) == (1_000_000, "5", "77", 1.0)


def test_first_failing_group_decides(frame):
    # B lacks negatives, C lacks positives: B comes first
    r = wide(frame(bits("10110100"), bits("10101010"), list("AABBBACC")), M.Gates(2))
    assert r.eodds_status in ("ZERO_NEGATIVE_SUBGROUP", "ZERO_POSITIVE_SUBGROUP")
    r = wide(frame(bits("10" + "11" + "00"), bits("101010"), list("AABBCC")), M.Gates(2))
    assert r.eodds_status == "ZERO_NEGATIVE_SUBGROUP"


def test_unstable_ratio_and_legacy_variants(frame):
    df = frame(bits("1100") * 2, bits("1100") + [0] * 4, ["A"] * 4 + ["B"] * 4)
    assert wide(df).di_status == "UNSTABLE_RATIO"
    legacy = M.legacy_disparities(confusion_cells(df)).first()
    assert legacy.di_raw == 0 and legacy.di_positive_only == 1 and legacy.pp_value == 1


def test_calibration_fixture(frame):
    df = frame(bits("1010"), bits("1010"), ["a"] * 4, y_prob=[0.8, 0.2, 0.6, 0.4])
    cal = calibration_cells(df)
    r = K.calibration_error(cal).first()
    assert r.brier_score == pytest.approx(0.10) and r.expected_calibration_error == pytest.approx(0.30)
    bins = K.reliability_bins(cal).orderBy("bin").collect()
    assert len(bins) == 10 and bins[5].bin_size == 1 and bins[6].bin_size == 0
    exact = frame(bits("00001111"), bits("00001111"), ["a"] * 8, y_prob=[0.0] * 4 + [1.0] * 4)
    cal5 = calibration_cells(exact, bins=5)
    assert K.reliability_bins(cal5, 5).count() == 5
    assert K.calibration_error(cal5).first().expected_calibration_error == 0


def test_scores_outside_unit_interval_stay_in_n(frame):
    df = frame(bits("10"), bits("10"), ["a", "a"], y_prob=[1.5, 0.25])
    r = K.calibration_error(calibration_cells(df)).first()
    assert r.n == 2 and r.expected_calibration_error == pytest.approx(0.125)


def test_roc_area(frame):
    df = frame(bits("0011"), bits("0011"), ["a"] * 4, y_prob=[0.1, 0.4, 0.35, 0.8])
    assert K.roc_auc(df, buckets=3).first().roc_auc == pytest.approx(0.75)
    ties = frame(bits("0101"), bits("0101"), ["a"] * 4, y_prob=[0.5] * 4)
    assert K.roc_auc(ties).first().roc_auc == pytest.approx(0.5)
    one = K.roc_auc(frame([1, 1], [1, 1], ["a"] * 2, y_prob=[0.1, 0.2])).first()
    assert one.roc_auc is None and one.status == "DEGENERATE_TARGET"


@pytest.mark.parametrize(
    "pred, status",
    [([1] * 100, "DEGENERATE"), ([1] * 99 + [0], "DEGENERATE"), ([0, 1] * 50, "NORMAL"), ([0] * 100, "DEGENERATE")],
)
def test_collapse(frame, pred, status):
    y = [0, 0, 1, 1] * 25
    total = merge_cells(confusion_cells(frame(y, pred, ["a"] * 100)))
    assert M.prediction_collapse(total).first().degeneracy_status == status


def test_insufficient_signal(frame):
    y = [0] * 90 + [1] * 10
    pred = [1] * 9 + [0] * 81 + [1] + [0] * 9
    total = merge_cells(confusion_cells(frame(y, pred, ["a"] * 100)))
    assert M.prediction_collapse(total).first().degeneracy_status == "INSUFFICIENT_SIGNAL"


def test_weights_keep_raw_support(frame):
    df = frame(bits("1010"), bits("1100"), list("AABB"), w=[2.0, 1.0, 1.0, 3.0])
    cells = {r.grp: r for r in confusion_cells(df, weight="w").collect()}
    assert cells["A"].n == 2 and cells["A"].tp == 2.0 and cells["A"].fp == 1.0
    assert M.with_rates(confusion_cells(df, weight="w")).filter("grp = 'A'").first().selection_rate == 1.0


def test_utility_and_gap(spark):
    df = spark.createDataFrame([(0.2, None, 0.4, None)], "dp_value double, eo_value double, eodds_value double, pp_value double")
    gap = df.select(M.fairness_gap().alias("g"), M.utility_score(F.lit(0.8), M.fairness_gap()).alias("u")).first()
    assert gap.g == pytest.approx(0.3) and gap.u == pytest.approx(0.725)
    empty = df.select(M.utility_score(F.lit(0.8), F.lit(None).cast("double")).alias("u")).first()
    assert empty.u == pytest.approx(0.675)
