"""Exact ranks without a global sort, under skew, and splits that do not leak."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenhand.operators import order as O
from evenhand.operators import ranking as K
from evenhand.operators import splits as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one key."""
    rnd = random.Random(5)
    rows = [(i, 7.0 if i % 3 == 0 else rnd.uniform(0, 20), "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)]
    return spark.createDataFrame(rows, "id int, v double, k string").repartition(5)


def test_rank_cuts_hit_the_sorted_position(spark, skewed):
    df = skewed.withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("p", O.hash_prefix("h"))
    binned = O.with_range_bucket(df, "v", O.range_bounds(df, "v", 16), "b")
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate([1, 700, 1500, 3000])], "cut int, rank bigint")
    got = {r.cut: (r.v, r.h) for r in O.rank_cuts(binned, wanted, ["b", "v", "p", "h"]).collect()}
    order = sorted((r.v, r.h) for r in df.collect())
    assert got == {0: order[0], 1: order[699], 2: order[1499], 3: order[2999]}


def test_prefix_sums_equal_running_totals(spark, skewed):
    distinct = skewed.groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: r.upto for r in O.prefix_sums(distinct, "v", {"n": "upto"}, buckets=7).collect()}
    total, want = 0, {}
    for r in sorted(distinct.collect(), key=lambda r: r.v):
        total += r.n
        want[r.v] = total
    assert got == want


def test_attach_paths_agree(spark, skewed):
    small = skewed.groupBy("k").agg(F.count("*").alias("n"))
    plain = O.attach(skewed, small, ["k"])
    salted = O.attach(skewed, small, ["k"], limit=3)
    assert "__salt" not in salted.columns
    assert sorted(map(tuple, plain.select("id", "n").collect())) == sorted(map(tuple, salted.select("id", "n").collect()))
    inner = O.salted_join(skewed, small.filter("k = 'hot'"), ["k"], "inner")
    assert inner.count() == 1000


def test_exact_quantiles(spark, skewed):
    want = skewed.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.77)))).first()[0]
    assert O.exact_quantiles(skewed, "v", [0.1, 0.5, 0.77]) == pytest.approx(want)
    assert O.exact_quantiles(skewed.filter("id < 0"), "v", [0.5]) == [None]


def test_group_split_isolated_and_sized(spark, skewed):
    out = S.group_split(skewed, "k")
    S.verify_isolation(out, "k")
    sizes = {r.split: r.groups for r in S.split_summary(out, group="k").collect()}
    n = skewed.select("k").distinct().count()
    assert sizes["train"] == round(n * 0.6) and sizes["val"] == round(n * 0.2) and sum(sizes.values()) == n
    with pytest.raises(S.GroupLeakageError):
        S.verify_isolation(out.withColumn("split", F.when(F.col("id") == 0, "test").otherwise("train")), "k")
    with pytest.raises(ValueError):
        S.group_split(skewed.withColumn("k", F.lit("one")), "k")


def test_temporal_split_daily(spark):
    df = spark.range(100).select("id", F.expr("timestamp '2026-01-01' + make_interval(0,0,0,int(id))").alias("ts"))
    out = S.temporal_split(df, "ts", "id")
    S.verify_temporal_order(out, "ts")
    assert {r.split: r.rows for r in S.split_summary(out).collect()} == {"train": 60, "val": 20, "test": 20}
    with pytest.raises(S.TemporalLeakageError):
        S.verify_temporal_order(out.withColumn("split", F.when(F.col("id") == 99, "train").otherwise("val")), "ts")


def test_temporal_split_one_hot_time(spark):
    """All rows at one time: still cut exactly 60/20/20."""
    df = spark.range(500).select("id", F.expr("timestamp '2026-01-01'").alias("ts"))
    out = S.temporal_split(df, "ts", "id")
    assert {r.split: r.rows for r in S.split_summary(out).collect()} == {"train": 300, "val": 100, "test": 100}


def test_stratified_split_and_partition_independence(spark, skewed):
    df = skewed.withColumn("y", (F.col("v") == 7.0).cast("int"))
    labels = lambda d: {r.id: r.split for r in S.stratified_split(d, "y", "id").collect()}
    one, many = labels(df.repartition(1)), labels(df.repartition(64))
    assert one == many
    counts = {(r.y, r.split): r.n for r in S.stratified_split(df, "y", "id").groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    n1 = sum(v for (y, _), v in counts.items() if y == 1)
    assert counts[(1, "train")] == round(n1 * 0.6) and counts[(1, "val")] == round(n1 * 0.2)


def test_folds_sample_and_guard(spark, skewed):
    df = skewed.withColumn("y", (F.col("v") == 7.0).cast("int"))
    folds = S.stratified_folds(df, "y", "id", 4).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()
    for y in (0, 1):
        sizes = [r.n for r in folds if r.y == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert S.stratified_sample(df, "y", "id", 301).count() == 301
    assert S.stratified_sample(df, "y", "id", 10**6).count() == 3000
    assert S.can_stratify(df, "y")
    split = S.stratified_split(df, "y", "id")
    with pytest.raises(S.HoldoutContractError):
        S.require_no_holdout(split)
    assert S.require_no_holdout(split.filter("split <> 'test'")) is not None


def test_percent_rank_and_quartiles(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 1, 3, 9, 9])], "id int, v double")
    got = {r.id: r.pct_rank for r in K.percent_ranks(df, "v").collect()}
    assert got == pytest.approx({0: 4 / 6, 1: 1.5 / 6, 2: 1.5 / 6, 3: 3 / 6, 4: 5.5 / 6, 5: 5.5 / 6})
    six = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, v double")
    bins = [r.quartile for r in K.quartile_labels(six, "v", "id", ["1", "2", "3", "4"]).orderBy("id").collect()]
    assert bins == ["1", "1", "2", "3", "4", "4"]


def test_pareto(spark):
    rnd = random.Random(3)
    rows = [(i, round(rnd.random(), 2), round(rnd.random(), 2)) for i in range(200)] + [(900, 0.999, 0.5), (901, 0.999, 0.5)]
    df = spark.createDataFrame(rows, "id int, accuracy double, fairness_gap double")
    want = {
        i for i, a, g in rows
        if not any(b >= a and h <= g and (b > a or h < g) for j, b, h in rows if j != i)
    }
    assert {r.id for r in K.pareto_frontier(df).collect()} == want


def test_nearest_controls_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, round(rnd.random(), 2), rnd.randint(0, 1)) for i in range(400)] + [(999, 5.0, 1), (1000, -4.0, 1)]
    df = spark.createDataFrame(rows, "row_id int, score double, treated int")
    controls = sorted((s, i) for i, s, t in rows if t == 0)
    first = {}
    for s, i in controls:
        first.setdefault(s, i)
    for r in K.nearest_controls(df).collect():
        best = min(first, key=lambda s: (abs(s - r.score), s))
        assert abs(best - r.score) == pytest.approx(abs(r.control_score - r.score), abs=1e-12)
        assert first[r.control_score] == r.control_id


def test_nearest_controls_is_linear_in_a_bucket(spark):
    """No frame of a bucket's rows ends at its last row: Spark works such a frame out anew for every row."""
    df = spark.range(1000).selectExpr("id AS row_id", "id / 1000 AS score", "CAST(id % 3 = 0 AS INT) AS treated")
    text = K.nearest_controls(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" in K.nearest_controls(df).withColumn(
        "x", F.first("score").over(Window.orderBy("score").rowsBetween(0, Window.unboundedFollowing)))._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in text


def test_redaction_order(spark):
    rows = [("a", 50), ("b", 9), ("c", 70), ("d", 70)]
    df = spark.createDataFrame(rows, "grp string, n bigint")
    out = K.redacted_subgroups(df, 10, max_groups=2, mask_labels=True).orderBy("disclosure_rank").collect()
    assert [(r.grp, r.n) for r in out] == [("REDACTED_GROUP_001", 70), ("REDACTED_GROUP_002", 70)]
