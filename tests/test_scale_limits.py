"""Sizes that tests cannot hold as rows: draws, sums and limits at 1e11 and more."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import draws
from evenhand.functions.expr import draw60, uniform_index
from evenhand.functions.special import f_tail, f_tail_column
from evenhand.operators import leakage as G
from evenhand.operators import models as L
from evenhand.operators import order
from evenhand.operators import quality as Q
from evenhand.operators import resample as B
from evenhand.sources import readers as R


@pytest.mark.parametrize("size", [1, 7, 3 * 10**9, 10**12, 10**17])
def test_keyed_draws_reach_every_size(spark, size):
    u = spark.range(2000).select(uniform_index(draw60(F.lit(1), "id"), F.lit(size)).alias("u"), draw60(F.lit(1), "id").alias("d")).collect()
    assert all(r.u == r.d * size >> 60 for r in u) and max(r.u for r in u) < size
    assert size == 1 or abs(np.mean([r.u for r in u]) / size - (0.5 if size > 7 else 3 / 7)) < 0.05


def test_generators_differ_by_key():
    assert len({B._generator(1, b, g).integers(1 << 62) for b in range(300) for g in range(30)}) == 9000


def test_hypergeometric_law_at_small_size(monkeypatch):
    monkeypatch.setattr(draws, "NUMPY_LIMIT", 0)
    rng, good, bad, n, times = np.random.default_rng(3), 30, 50, 20, 20_000
    got = np.bincount([draws.hypergeometric(rng, good, bad, n) for _ in range(times)], minlength=21)
    want = np.array([math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(21)]) * times
    ok = want > 5
    chi = ((got - want)[ok] ** 2 / want[ok]).sum()
    assert chi < 3 * ok.sum() and [draws.hypergeometric(rng, 4, 0, 3), draws.hypergeometric(rng, 0, 4, 3), draws.hypergeometric(rng, 5, 5, 10)] == [3, 0, 5]


def test_hypergeometric_moments_at_huge_size():
    rng, good, bad, n = np.random.default_rng(5), 3 * 10**11, 7 * 10**11, 10**11
    x = np.array([draws.hypergeometric(rng, good, bad, n) for _ in range(400)], dtype=float)
    p = good / (good + bad)
    sd = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    assert abs(x.mean() - n * p) < 5 * sd / 20 and 0.85 < x.std() / sd < 1.15
    left = np.array([10**11, 5, 2 * 10**11, 10**9])
    got = draws.multivariate_hypergeometric(rng, left, 10**10)
    assert got.sum() == 10**10 and (got <= left).all() and (got >= 0).all()


def test_beta_fraction_converges_for_many_degrees():
    assert f_tail(1.0, 10**6, 10**6) == pytest.approx(0.5, abs=1e-3)
    assert 0 < f_tail(1.001, 10**9, 10**9) < 0.5


def test_sums_are_wide(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train")], "a int, split string")
    assert G.split_overlap(df, ["a"]).schema["overlap_count"].dataType.simpleString() == "decimal(38,0)"
    assert Q.table_fingerprint(df).schema["part_0"].dataType.simpleString() == "decimal(38,0)"
    assert Q.table_fingerprint(df.limit(0)).first()["part_0"] == 0


def test_limits_hold_only_if_given(spark):
    wide = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(1001)])
    assert Q.resource_limits(wide) == [] and Q.resource_limits(wide, max_columns=1000) == ["1001 columns exceed 1000"]
    assert Q.resource_limits(wide, 2) == ["more than 2 rows"]


def test_only_banner_lines_are_left_out(spark, tmp_path):
    (tmp_path / "a").write_text("|1x3 banner\n1, a\nbroken, b\n2, c\n")
    df = R.read_headerless_csv(spark, [str(tmp_path / "a")], "n int, t string")
    assert R.malformed_count(df) == 1 and sorted(r.n for r in R.good_rows(df).collect()) == [1, 2] and len(df.collect()) == 3


def test_numeric_groups_and_large_values(spark):
    same = spark.createDataFrame([(g, float(g)) for g in range(12) for _ in range(3)], "grp int, x double")
    assert G.group_correlations(same, ["x"]).first()["correlation"] == pytest.approx(1.0)
    rows = [(g, float(v)) for g, vs in {"a": [1, 2, 3, 4, 9], "b": [2, 4, 6, 8, 1]}.items() for v in vs]
    near = spark.createDataFrame(rows, "grp string, x double")
    far = near.withColumn("x", F.col("x") + 1.7e15)
    one, two = (G.group_separation(d, ["x"]).first()["f_statistic"] for d in (near, far))
    assert one == pytest.approx(two, rel=1e-6) and one > 0
    codes = {r["grp"]: r["code"] for r in G.group_codes(spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "grp string"), "grp").collect()}
    assert codes == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_elimination_sizes():
    assert L.set_sizes(20, 0.15, 8, 8) == [20, 17, 15, 13, 12, 11, 10, 9, 8]
    assert L.set_sizes(20, 0.5, 8, 1) == [20, 10] and L.set_sizes(5, 0.15, 8, 0) == [5]

    class Model:
        class featureImportances:  # noqa: N801
            toArray = staticmethod(lambda: np.array([0.2, 0.0, 0.0, 0.8]))

    assert L.most_important(Model, list("abcd"), 3) == ["a", "c", "d"]


def test_hull_of_slices_is_the_hull(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000)
    rows = [("a", int(v), float(np.clip(rng.normal(0.4 + 0.2 * v, 0.2), 0, 1))) for v in y]  # 3,000 distinct scores
    from evenhand.operators import thresholds as H
    from evenhand.operators.calibration import roc_curve

    roc = roc_curve(spark.createDataFrame(rows, "grp string, y_true int, y_prob double"))
    pts = roc.select("fpr", "tpr", "threshold").toPandas().to_numpy(dtype=float)
    whole = H._hull(pts[np.lexsort((pts[:, 1], pts[:, 0]))])
    some = H.hull_vertices(roc, 64).select("fpr", "tpr", "threshold").toPandas().to_numpy(dtype=float)
    assert len(some) < len(pts) and np.allclose(H._hull(some[np.lexsort((some[:, 1], some[:, 0]))]), whole)


def test_null_keys_are_spread(spark):
    from evenhand.operators.order import salted_join

    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("k"), "id").repartition(4)
    small = spark.createDataFrame([(i, i * 10) for i in range(7)], "k bigint, v int")
    out = salted_join(big, small, ["k"])
    assert out.count() == 4000 and out.filter("v IS NULL AND k IS NULL").count() == 2000 and out.filter("v = k * 10").count() == 2000


def test_older_statuses_are_renamed(spark):
    from evenhand.plans.report import canonical_status

    df = spark.createDataFrame([("HEALTHY",), ("VALID",), (None,), ("COLLAPSED_CONSTANT",)], "s string")
    assert [r.s for r in df.select(canonical_status("s").alias("s")).collect()] == ["VALID", "VALID", None, "DEGENERATE"]


def test_f_tail_of_columns_equals_that_of_numbers(spark):
    cases = [(f, d1, d2) for f in (0.0, 0.3, 1.0, 2.5, 40.0, 900.0) for d1 in (1, 2, 7, 300) for d2 in (1, 5, 60, 14995, 10**8)]
    df = spark.createDataFrame([(float(f), float(a), float(b)) for f, a, b in cases] + [(None, 1.0, 1.0), (1.0, 1.0, 0.0)], "f double, a double, b double")
    for r in df.withColumn("p", f_tail_column(F.col("f"), F.col("a"), F.col("b"))).collect():
        if r.f is None or r.b == 0:
            assert r.p is None
        else:
            assert r.p == pytest.approx(f_tail(r.f, r.a, r.b), rel=1e-6, abs=1e-12), r


@pytest.mark.parametrize("limit", [40, 100_000])
def test_no_task_orders_more_values_than_the_limit(spark, monkeypatch, limit):
    """One value holds a third of the rows, the others are lopsided; ranks are exact and every final histogram is small."""
    df = spark.range(30_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 5.0 ELSE pow(2.0, (id * 7919 % 30000) / 1500.0) END AS v", "md5(CAST(id AS STRING)) AS h"
    ).withColumn("b", F.least(F.floor(F.col("v") / 200000), F.lit(3)).cast("int")).withColumn("p", F.substring("h", 1, 1))
    seen = []
    real = order._finer_bounds

    def spy(scope, keys, level, top):
        out = real(scope, keys, level, top)
        if out is None:
            most = scope.select(*keys, level).distinct().groupBy(*keys).count().agg(F.max("count")).first()[0]
            seen.append((level, most))
        return out

    monkeypatch.setattr(order, "_finer_bounds", spy)
    ranks = [1, 2, 9_000, 12_345, 15_001, 29_999, 30_000]
    cuts = spark.createDataFrame(list(enumerate(ranks)), "cut int, rank bigint")
    got = {r.cut: (r.v, r.h) for r in order.rank_cuts(df, cuts, ["b", "v", "p", "h"], limit=limit).collect()}
    rows = sorted((r.v, r.h) for r in df.select("v", "h").collect())
    assert got == {i: rows[k - 1] for i, k in enumerate(ranks)}
    assert all(most <= limit for _, most in seen)
