import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from evenhand.operators import models as L
from evenhand.operators import perceptron as P
from evenhand.operators import trees as T


@pytest.fixture(scope="module")
def stepped(spark):
    """Three features of few values, so that every value has a bin of its own in both learners."""
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        a, b, c = rnd.randrange(20), rnd.randrange(9), rnd.randrange(3)
        rows.append((i, int(rnd.random() < 1 / (1 + 2.7 ** (-(a - 10) / 4 + (b > 4) * c))), float(a), float(b), float(c), 1.0 + rnd.randrange(3), "AB"[i % 2]))
    df = spark.createDataFrame(rows, "row_id int, y_true int, a double, b double, c double, w double, grp string")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("split", F.lit("train")).cache()


def gap(df, mine, other):
    a = L.score(mine, df).select("row_id", F.col("y_prob").alias("p"))
    return a.join(L.score(other, df).select("row_id", "y_prob"), "row_id").agg(F.max(F.abs(F.col("p") - F.col("y_prob"))).alias("d")).first()["d"]


def test_folded_trees_are_those_of_spark_ml(stepped):
    for weight in (None, "w"):
        mine = T.fit_boosted(stepped, weight, rounds=8, sample=1.0)
        assert gap(stepped, mine, L.boosted(weight, rounds=8, sample=1.0).fit(stepped)) < 1e-9
    mine = T.fit_forest(stepped, trees=1, depth=6, bootstrap=False)
    assert gap(stepped, mine, L.forest(trees=1, depth=6).setBootstrap(False).fit(stepped)) < 1e-9


def test_bagged_forest_has_the_law_of_spark_ml(stepped):
    mine = T.fit_forest(stepped, trees=60)
    assert len(mine.trees) == 60 and len({t[2].tobytes() for t in mine.trees}) > 50
    assert gap(stepped, mine, L.forest(trees=60).fit(stepped)) < 0.15  # two draws of 60 trees


def test_folding_adds_up(spark, stepped):
    cells = T.fold(stepped, "w")
    assert cells.table.agg(F.sum("k")).first()[0] == 1500 and cells.sizes == [20, 9, 3]
    assert T.fold(stepped, "w", limit=10) is None  # too many cells for a task: Spark ML's trees are taken
    wide = spark.range(5000).select(F.rand(1).alias("u")).withColumn("y_true", F.lit(1))
    many = T.fold(VectorAssembler(inputCols=["u"], outputCol="features").transform(wide))
    sizes = [r["k"] for r in many.table.collect()]
    assert len(sizes) == T.BINS and max(sizes) < 2 * 5000 / T.BINS


def test_jobs_of_a_boosted_fit_do_not_grow_with_its_rounds(spark, stepped):
    sc, counts = spark.sparkContext, []
    for rounds in (5, 40):
        sc.setJobGroup(f"boosted-{rounds}", "")
        model = L.fit_baselines(stepped, rounds, 42, ["B4_Proposed_Tuned_XGB"])["B4_Proposed_Tuned_XGB"]
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"boosted-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.model.trees) == 40 and counts[0] == counts[1] < 40


def test_jobs_of_a_forest_do_not_grow_with_its_trees(spark, stepped):
    sc, counts = spark.sparkContext, []
    for trees in (4, 40):
        sc.setJobGroup(f"forest-{trees}", "")
        assert len(L.any_forest(stepped, trees, 10).trees) == trees
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"forest-{trees}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] < 10


def test_perceptron_slope_by_differences():
    rng = np.random.default_rng(5)
    x, y, sizes = rng.normal(size=(50, 3)), (rng.random(50) < 0.4).astype(float), [3, 5, 4, 2]
    w = rng.normal(size=4 * 5 + 6 * 4 + 5 * 2)
    _, slope = P.loss_and_slope(w, sizes, x, y)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        two = P.loss_and_slope(w + e, sizes, x, y)[0] - P.loss_and_slope(w - e, sizes, x, y)[0]
        assert slope[i] == pytest.approx(two / 2e-6, abs=1e-5)


def test_perceptron_fits_as_well_as_that_of_spark_ml(stepped):
    def loss(model):
        s = L.score(model, stepped)
        return s.agg(F.avg(-F.log(F.when(F.col("y_true") == 1, F.col("y_prob")).otherwise(1 - F.col("y_prob"))))).first()[0]

    scaled = P.fit_perceptron(stepped, (8, 4), 60)
    assert loss(scaled) == pytest.approx(scaled.loss, abs=1e-9)
    assert scaled.loss < 1.03 * loss(L.perceptron(3, (8, 4), 60).fit(stepped))


def test_minimise_finds_the_bottom():
    def valley(w):
        a, b = w
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert P.minimise(valley, np.array([-1.2, 1.0]), 200, 1e-12) == pytest.approx([1, 1], abs=1e-4)


def test_models_fitted_side_by_side_are_scored_in_one_pass(spark, stepped):
    fits = {"three_trees": lambda rows: L.any_forest(rows, 3, 3), "line": lambda rows: L.logistic(1500).fit(rows)}
    models = L.fitted_side_by_side(stepped, fits)
    out = L.scores_side_by_side(stepped, models)
    for name, m in models.items():
        alone = L.score(m, stepped).select("row_id", "y_prob").join(out.select("row_id", name), "row_id")
        assert alone.filter(F.abs(F.col("y_prob") - F.col(name)) > 1e-12).count() == 0
