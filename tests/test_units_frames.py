import pytest
from pyspark.sql import functions as F

from evenhand.operators import frames as R
from evenhand.operators import metrics as M
from evenhand.operators import units as U
from evenhand.operators.cells import confusion_cells, merge_cells


def trips(spark):
    rows = [("A0", i, 1, 1, "A") for i in range(20)]
    rows += [(f"A{k}", 0, 0, 0, "A") for k in range(1, 10)]
    rows += [(f"B{k}", i, 1, 1, "B") for k in range(10) for i in range(2)]
    return spark.createDataFrame(rows, "entity_id string, row_id int, y_true int, y_pred int, grp string")


def test_entity_divergence(spark):
    df = trips(spark)
    by_row = M.with_rates(confusion_cells(df)).filter("grp = 'A'").first()
    assert by_row.selection_rate == pytest.approx(20 / 29)
    one = U.collapse_entities(df)
    assert one.count() == 20
    assert M.with_rates(confusion_cells(one)).filter("grp = 'A'").first().selection_rate == pytest.approx(0.10)


def test_dominant_entity_weighting(spark):
    rows = [("big", 1, 1, "a")] * 90 + [(f"e{i}", 0, 1, "a") for i in range(10)]
    df = spark.createDataFrame(rows, "entity_id string, y_true int, y_pred int, grp string")
    plain = merge_cells(confusion_cells(df)).select(*M.performance_columns()).first()
    assert plain.accuracy == pytest.approx(0.90)
    weighted = merge_cells(U.entity_weighted_cells(df)).select(*M.performance_columns()).first()
    assert weighted.accuracy == pytest.approx(1 / 11)


@pytest.mark.parametrize("strategy, expected", [("ANY_FAILURE", (0, 0)), ("MAJORITY_VOTE", (1, 0)), ("ALL_SUCCESS", (1, 0))])
def test_collapse_strategies(spark, strategy, expected):
    rows = [("T1", i, 1, p, "g") for i, p in enumerate([1, 0, 1])] + [("T2", i, 0, 0, "g") for i in range(3)]
    df = spark.createDataFrame(rows, "entity_id string, row_id int, y_true int, y_pred int, grp string")
    got = {r.entity_id: r.y_pred for r in U.collapse_entities(df, target_strategy=strategy).collect()}
    assert (got["T1"], got["T2"]) == expected


def test_collapse_refusals(spark):
    with pytest.raises(U.UnsupportedCollapseError):
        U.collapse_entities(trips(spark), target_strategy="UNSUPPORTED_EVALUATION_UNIT")


def test_entity_weights(spark):
    df = spark.createDataFrame([("A",), ("A",), ("A",), ("B",)], "entity_id string")
    got = sorted(r.entity_weight for r in U.entity_weights(df).collect())
    assert got == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2.0])
    based = df.withColumn("w", F.lit(2.0))
    assert sum(r.entity_weight for r in U.entity_weights(based, base="w").collect()) == pytest.approx(4.0)


def test_unit_guard(spark):
    df = spark.createDataFrame([(i // 2,) for i in range(8)], "trip int")
    with pytest.raises(U.UnitMismatchError):
        U.guard_row_bootstrap(df, "trip", "TRIP_LEVEL")
    assert U.guard_row_bootstrap(df, "trip", "TRIP_LEVEL", override=True)
    assert U.guard_row_bootstrap(df, "trip", "ROW_LEVEL") is None
    assert U.guard_row_bootstrap(df.distinct(), "trip", "TRIP_LEVEL") is None


def test_profile_and_configuration(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    r = U.entity_profile(df, "k").first()
    assert (r.unit_cardinality, r.null_count, r.min_rows, r.max_rows) == (2, 1, 1, 2)
    assert any("null" in e for e in U.unit_configuration_errors(df, "k"))
    assert U.unit_configuration_errors(df, "nope") and not U.unit_configuration_errors(df.na.drop(), "k")


def test_intersections(spark):
    rows = [("M", "Day", 1, 1), ("M", "Night", 0, 0), ("F", "Day", 0, 0), ("F", "Night", 1, 1)] * 10
    df = spark.createDataFrame(rows, "sex string, shift string, y_true int, y_pred int")
    by_sex = M.disparity_wide(confusion_cells(df.withColumn("grp", F.col("sex")))).first()
    assert by_sex.eodds_value == 0 and by_sex.dp_value == 0
    spec = U.IntersectionSpec(["sex", "shift"])
    crossed = M.disparity_wide(confusion_cells(U.with_intersection(df, spec))).first()
    assert crossed.dp_value == 1.0
    labels = {r.grp: r.attributes for r in U.intersection_provenance(df, spec).collect()}
    assert labels["M x Day"] == {"sex": "M", "shift": "Day"}
    with pytest.raises(KeyError):
        U.with_intersection(df, U.IntersectionSpec(["sex", "age"]))


def test_missing_groups(frame):
    df = frame([1, 0, 1, 0, 1, 0], [1, 0, 1, 0, 1, 0], ["A", "A", None, "B", "B", " other "])
    s = R.missing_group_summary(df, "REJECT").first()
    assert s.missing_count == 2 and s.initial_status == "MISSING_ATTRIBUTE_VIOLATION"
    assert R.apply_missing_policy(df, "EXCLUDE").count() == 4
    known = {r.grp for r in R.apply_missing_policy(df, "EXPLICIT_UNKNOWN_GROUP").collect()}
    assert known == {"A", "B", "UNKNOWN"}
    imputed = {r.grp for r in R.apply_missing_policy(df, "IMPUTE_WITH_DOCUMENTED_RULE").collect()}
    assert imputed == {"A", "B", "DERIVED_PROXY_IMPUTED", " other "}


def test_roles_and_guards(spark, frame):
    df = spark.createDataFrame([(1, "a", 2.0, "k")], "y int, g string, x double, key string")
    out = R.audit_frame(df, R.ColumnRoles(target="y", sensitive=["g", "key"], unit_key="key"))
    assert out.first().grp == "a_x_k" and "x" in out.columns
    with pytest.raises(R.MissingColumnsError):
        R.audit_frame(df, R.ColumnRoles(target="nope", sensitive=["g"]))
    bad = df.withColumn("y_true", F.lit(float("nan"))).withColumn("y_pred", F.lit(1))
    with pytest.raises(R.InvalidLabelsError):
        R.require_clean_labels(bad)
    R.require_clean_labels(frame([1], [0], ["a"]))


def test_reweighing_mean_is_one(frame):
    df = frame([1, 1, 0, 0, 1, 0], [0] * 6, list("AAABBB"))
    w = [r.weight for r in U.with_reweighing(df).collect()]
    assert sum(w) / len(w) == pytest.approx(1.0)
    by = {(r.grp, r.y_true): r.weight for r in U.reweighing_table(df).collect()}
    assert by[("A", 0)] / by[("A", 1)] == pytest.approx(2.0)


def test_median_impute_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert sorted(r.v for r in R.impute_median(df, "v").collect()) == [1.0, 2.0, 2.5, 2.5, 3.0, 10.0]
