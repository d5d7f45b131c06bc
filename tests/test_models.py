import random

import pytest
from pyspark.sql import functions as F

from evenhand.operators import metrics as M
from evenhand.operators import models as L
from evenhand.operators import thresholds as H
from evenhand.operators.calibration import roc_curve
from evenhand.operators.cells import confusion_cells
from evenhand.operators.splits import HoldoutContractError
from evenhand.plans import benchmark as B
from evenhand.plans.evaluate import AuditConfig


@pytest.fixture(scope="module")
def biased(spark):
    """Scores that favour group A: one threshold for all gives unequal odds."""
    rnd = random.Random(1)
    rows = []
    for i in range(1200):
        g = "A" if i % 2 else "B"
        x = rnd.gauss(0, 1)
        y = int(x + rnd.gauss(0, 0.7) > 0)
        score = min(max(0.5 + 0.2 * x + (0.12 if g == "A" else -0.12), 0.0), 1.0)
        rows.append((i, y, g, score, int(score >= 0.5), x, "ab"[i % 2], i % 40))
    return spark.createDataFrame(
        rows, "row_id int, y_true int, grp string, y_prob double, y_pred int, x double, kind string, holdout_key int"
    ).cache()


def test_mixing_rule_equalizes_odds(biased):
    before = M.disparity_wide(confusion_cells(biased)).first()
    rule = H.equalized_odds_rule(biased, grid=500)
    chances = H.apply_mixing(biased, rule)
    # expected rates follow from decision chances, without coin noise
    per = chances.groupBy("grp", "y_true").agg(F.avg("decision_chance").alias("r")).collect()
    rate = {(r.grp, r.y_true): r.r for r in per}
    assert rate[("A", 1)] == pytest.approx(rate[("B", 1)], abs=0.01)
    assert rate[("A", 0)] == pytest.approx(rate[("B", 0)], abs=0.01)
    after = M.disparity_wide(confusion_cells(chances)).first()
    assert after.eodds_value < before.eodds_value / 2
    assert rate[("A", 1)] > rate[("A", 0)] + 0.3


def test_roc_points_by_hand(biased):
    pts = {r.threshold: r for r in roc_curve(biased).filter("grp = 'A'").collect()}
    rows = [r for r in biased.collect() if r.grp == "A"]
    t = sorted(pts)[len(pts) // 2]
    assert pts[t].tp == sum(r.y_true for r in rows if r.y_prob >= t)
    assert pts[t].fp == sum(1 - r.y_true for r in rows if r.y_prob >= t)


def test_group_thresholds(biased):
    th = H.balanced_thresholds(roc_curve(biased))
    out = H.apply_thresholds(biased.withColumn("grp", F.when(F.col("row_id") < 5, "new").otherwise(F.col("grp"))), th)
    fresh = out.filter("grp = 'new'").collect()
    assert all(r.y_pred == int(r.y_prob >= 0.5) for r in fresh)
    assert {r.grp for r in th.collect()} == {"A", "B"}


def test_preprocessor_fits_on_train_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, None), (5.0, "b")], "v double, c string")
    p = L.fit_preprocessor(train, L.Features(("v",), ("c",)))
    rows = p.transform(spark.createDataFrame([(3.0, "zzz"), (None, None), (3.0, "a")], "v double, c string")).collect()
    unseen, blank, known = (r.features.toArray().tolist() for r in rows)
    assert unseen[0] == pytest.approx(0.0) and unseen[1:] == [0.0, 0.0]
    assert blank[1:] == known[1:] == [1.0, 0.0]  # most frequent category


def test_baselines_refuse_test_rows(biased):
    ready = biased.withColumn("split", F.lit("test"))
    with pytest.raises(HoldoutContractError):
        L.fit_baselines(ready)


def test_benchmark_run(biased):
    out = B.run_suite(
        biased.drop("y_prob", "y_pred"), ["x", "kind"], seeds=[42], regimes=["GROUP_HOLDOUT"], rounds=3, gates=M.Gates(2)
    )
    rows = {r.baseline_id: r for r in out.collect()}
    assert set(rows) == set(L.BASELINES)
    assert rows["B0_Majority_Class_Baseline"].decision == "POLICY_DEGENERATE"
    assert rows["B1_Clean_Unmitigated_Linear"].balanced_accuracy > 0.7
    assert len({r.sample_size for r in rows.values()}) == 1


def test_black_box(biased):
    out = B.black_box_audit(biased, config=AuditConfig(gates=M.Gates(2), with_auc=False), estimand_status="SPECIFIED").first()
    assert out.gate_passed and out.sample_size == pytest.approx(240, abs=2)
    fitted = B.black_box_audit(
        biased, ["x", "kind"], L.logistic(700), config=AuditConfig(gates=M.Gates(2)), estimand_status="SPECIFIED"
    ).first()
    assert fitted.accuracy > 0.7 and fitted.roc_auc > 0.75


def test_effects_recover_a_known_shift(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        x = rnd.gauss(0, 1)
        t = int(rnd.random() < 1 / (1 + 2.7 ** (-x)))
        y = int(rnd.random() < min(max(0.3 + 0.25 * t + 0.1 * x, 0), 1))
        rows.append((i, x, t, y))
    df = spark.createDataFrame(rows, "row_id int, x double, treated int, y_true int")
    train, test = df.filter("row_id % 2 = 0"), df.filter("row_id % 2 = 1")
    got = {r.estimate: r.value for r in L.effect_estimates(train, test, L.Features(("x",))).collect()}
    assert len(got) == 4
    for name in ("G-computation ATE", "Treated effect", "IPW ATE"):
        assert got[name] == pytest.approx(0.25, abs=0.08), name
    assert got["Matched difference"] == pytest.approx(0.25, abs=0.15)


def test_benchmark_queries_run_the_whole_suite(spark, monkeypatch):
    """Five seeds, three regimes and all rounds; summary and deltas are those of the suite's rows."""
    from evenhand.catalog import load, modelling

    load()
    calls, splits = [], []

    def split(df, regime, seed):
        splits.append((regime, seed))
        return df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.pmod("row_id", F.lit(3)).cast("int") + 1))

    def fit(rows, rounds=120, seed=42, which=()):
        calls.append((seed, rounds, *which))
        return {which[0]: L.ConstantModel(1, (seed % 7 + len(calls) % 3) / 20)}

    monkeypatch.setattr(B, "split_by_regime", split)
    monkeypatch.setattr(L, "fit_baselines", fit)
    monkeypatch.setattr(B, "__version__", "test")  # a store of its own
    sf = "/root/testdata/sf0.001"
    assert modelling.benchmark_runs(spark, sf).count() == 75
    assert len(splits) == 11 and {r for r, _ in splits} == {"IID_HOLDOUT", "GROUP_HOLDOUT", "TEMPORAL_HOLDOUT"}
    fitted = [c[2] for c in calls]
    assert {c[1] for c in calls} == {120} and fitted.count("B4_Proposed_Tuned_XGB") == 15
    assert all(fitted.count(b) == 11 for b in ("B0_Majority_Class_Baseline", "B1_Clean_Unmitigated_Linear", "B2_Fairness_Reweighted"))
    done = len(calls)
    accuracy = [r for r in modelling.benchmark_summary(spark, sf).collect() if r["metric"] == "accuracy"]
    assert len(accuracy) == 15 and all(r["runs"] == 5 for r in accuracy)
    delta = {r["metric"]: r for r in modelling.benchmark_deltas(spark, sf).collect()}["accuracy"]
    assert delta["seeds_count"] == 5 and len(calls) == done  # both read the store


def test_fits_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    """Rows of one file with one row group are one task; what is fitted on them must not stay one."""
    from evenhand import session

    path = str(tmp_path / "one")
    spark.range(4000).select(F.col("id").alias("row_id")).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    parts = session.dealt(one, "row_id")
    assert one.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 4
    assert parts.distinct().count() == 4000 and session.dealt(one.limit(0), "row_id").rdd.getNumPartitions() == 1
    read = session.stored(parts)
    assert len(read.inputFiles()) == 4
