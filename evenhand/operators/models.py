"""Spark ML jobs: preprocessing, baselines, scoring, search, elimination, effects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evenhand.operators import metrics as M
from evenhand.operators.cells import confusion_cells, merge_cells
from evenhand.operators.frames import categorical_columns, numeric_columns
from evenhand.operators.ranking import nearest_controls
from evenhand.operators.splits import require_no_holdout, stratified_folds
from evenhand.operators.trees import fit_boosted, fit_forest
from evenhand.operators.units import with_reweighing
from evenhand.session import dealt, durable, stored


# --- preprocessing -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Features:
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> "Features":
        picked = df.select(*columns)
        return cls(tuple(numeric_columns(picked)), tuple(categorical_columns(picked)))


@dataclass
class Preprocessor:
    """Fitted on training rows only: medians, modes, scale, categories."""

    features: Features
    modes: dict[str, str]
    model: PipelineModel

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        ready = _typed(df, self.features).na.fill(self.modes)
        return self.model.transform(ready).withColumnRenamed("__features", out)


def _typed(df: DataFrame, f: Features) -> DataFrame:
    out = df
    for c in f.numeric:
        out = out.withColumn(f"__n_{c}", F.col(c).cast("double"))
    for c in f.categorical:
        out = out.withColumn(f"__c_{c}", F.col(c).cast("string"))
    return out


def fit_preprocessor(train: DataFrame, features: Features) -> Preprocessor:
    """Median + standardise for numbers; most frequent + one-hot for text. The indexer keeps
    a last slot for unseen categories and the encoder drops it, so they are all zeros."""
    df = _typed(train, features)
    modes: dict[str, str] = {}
    if features.categorical:
        row = df.agg(*[F.mode(f"__c_{c}", True).alias(f"__c_{c}") for c in features.categorical]).first()
        modes = {k: (v if v is not None else "missing") for k, v in row.asDict().items()}
    stages: list = []
    parts: list[str] = []
    if features.numeric:
        cols = [f"__n_{c}" for c in features.numeric]
        filled = [f"__i_{c}" for c in features.numeric]
        stages += [
            Imputer(strategy="median", inputCols=cols, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="__num"),
            StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=True, withStd=True),
        ]
        parts.append("__num_scaled")
    if features.categorical:
        cols = [f"__c_{c}" for c in features.categorical]
        idx = [f"__x_{c}" for c in features.categorical]
        hot = [f"__h_{c}" for c in features.categorical]
        stages += [
            StringIndexer(inputCols=cols, outputCols=idx, handleInvalid="keep"),
            OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True),
        ]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="__features"))
    return Preprocessor(features, modes, Pipeline(stages=stages).fit(df.na.fill(modes)))


# --- classifiers ----------------------------------------------------------------------------------------

def logistic(n: int, weight: str | None = None, c: float = 1.0, max_iter: int = 100) -> LogisticRegression:
    """L2 logistic regression; ``c`` is the inverse strength against the summed loss."""
    est = LogisticRegression(
        labelCol="y_true", featuresCol="features", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter,
    )
    return est.setWeightCol(weight) if weight else est


def boosted(weight: str | None = None, depth: int = 4, rounds: int = 120, step: float = 0.08, sample: float = 0.85, seed: int = 42):
    est = GBTClassifier(
        labelCol="y_true", featuresCol="features", maxDepth=depth, maxIter=rounds, stepSize=step,
        subsamplingRate=sample, seed=seed,
    )
    return est.setWeightCol(weight) if weight else est


def forest(trees: int = 200, depth: int = 10, weight: str | None = None, seed: int = 42):
    est = RandomForestClassifier(labelCol="y_true", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return est.setWeightCol(weight) if weight else est


def perceptron(inputs: int, hidden: Sequence[int] = (64, 32), max_iter: int = 100, seed: int = 42):
    """Takes no weights."""
    return MultilayerPerceptronClassifier(
        labelCol="y_true", featuresCol="features", layers=[inputs, *hidden, 2], maxIter=max_iter, seed=seed
    )


class CalibratedSVM:
    """Linear SVM whose raw score goes through a one-feature logistic curve."""

    def __init__(self, max_iter: int = 100):
        self.max_iter = max_iter

    def fit(self, df: DataFrame) -> "CalibratedSVM":
        self.svm = LinearSVC(labelCol="y_true", featuresCol="features", maxIter=self.max_iter).fit(df)
        self.curve = LogisticRegression(labelCol="y_true", featuresCol="__raw").fit(self._raw(df))
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        scored = self.svm.transform(df).withColumn("__r", vector_to_array("rawPrediction")[1])
        slim = scored.drop("rawPrediction", "prediction")
        return VectorAssembler(inputCols=["__r"], outputCol="__raw").transform(slim)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.curve.transform(self._raw(df)).drop("__r", "__raw")


def score(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``y_prob`` and ``y_pred``. Without probabilities the decision value goes through a
    sigmoid."""
    out = model.transform(df)
    if "probability" in out.columns:
        prob = vector_to_array("probability")[1]
    else:
        prob = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    return (
        out.withColumn("y_prob", prob)
        .withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))
        .drop("probability", "rawPrediction", "prediction")
    )


def scores_side_by_side(df: DataFrame, models: dict[str, object]) -> DataFrame:
    """A column of scores per fitted model, from one pass over the rows."""
    out = df
    for name, m in models.items():
        out = score(m, out).withColumnRenamed("y_prob", name).drop("y_pred")
    return out


def soft_vote(df: DataFrame, models: Sequence, threshold: float = 0.5) -> DataFrame:
    """Mean score of several fitted models."""
    out = df
    for i, m in enumerate(models):
        out = score(m, out).withColumnRenamed("y_prob", f"__v{i}").drop("y_pred")
    mean = sum((F.col(f"__v{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return (
        out.withColumn("y_prob", mean)
        .withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))
        .drop(*[f"__v{i}" for i in range(len(models))])
    )


def fitted_side_by_side(train: DataFrame, fits: dict[str, Callable[[DataFrame], object]]) -> dict[str, object]:
    """Models of fits that do not need each other: one waits for its short jobs while another uses the cores."""
    with ThreadPoolExecutor(len(fits)) as pool:
        running = {name: pool.submit(inheritable_thread_target(train.sparkSession)(fit), train) for name, fit in fits.items()}
        return {name: r.result() for name, r in running.items()}


def any_forest(train: DataFrame, trees: int = 200, depth: int = 10, seed: int = 42):
    """A forest on folded rows; on rows that do not fold, Spark ML's."""
    return fit_forest(train, trees, depth, seed=seed) or forest(trees, depth, seed=seed).fit(train)


# --- baselines --------------------------------------------------------------------------------------------

BASELINES = {
    "B0_Majority_Class_Baseline": "most frequent label",
    "B1_Clean_Unmitigated_Linear": "logistic regression",
    "B2_Fairness_Reweighted": "logistic regression with reweighing",
    "B3_Validation_Threshold_Mitigated": "B1 with equalized-odds thresholds tuned on validation rows",
    "B4_Proposed_Tuned_XGB": "boosted trees with reweighing and class balance",
}


class ConstantModel:
    """Predicts the majority label; the score is the prevalence."""

    def __init__(self, label: int, prevalence: float):
        self.label, self.prevalence = label, prevalence

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("y_prob", F.lit(self.prevalence)).withColumn("y_pred", F.lit(self.label))


class FittedModel:
    """A fitted classifier behind the same ``score`` call, optionally with a mixing rule."""

    def __init__(self, model, rule: DataFrame | None = None):
        self.model, self.rule = model, rule

    def score(self, df: DataFrame) -> DataFrame:
        out = score(self.model, df)
        if self.rule is not None:
            from evenhand.operators.thresholds import apply_mixing

            out = apply_mixing(out, self.rule).drop("decision_chance")
        return out


def fit_baselines(
    fit_rows: DataFrame, rounds: int = 120, seed: int = 42, which: Sequence[str] = tuple(BASELINES)
) -> dict[str, ConstantModel | FittedModel]:
    """B0 to B4 from rows with ``features, y_true, grp, split``; test rows are refused.

    Models fit on train; thresholds of B3 are tuned on val. The boosted trees grow on folded rows (``operators/trees``),
    in one job instead of several a round; rows that do not fold go through Spark ML's trees.
    """
    from evenhand.operators.thresholds import equalized_odds_rule

    require_no_holdout(fit_rows)
    train = fit_rows.filter(F.col("split") == "train")
    val = fit_rows.filter(F.col("split") == "val")
    out: dict[str, ConstantModel | FittedModel] = {}
    if "B0_Majority_Class_Baseline" in which:
        base = M.majority_class(train).first()
        out["B0_Majority_Class_Baseline"] = ConstantModel(base["majority_label"], base["constant_score"] or 0.5)
    need_b1 = {"B1_Clean_Unmitigated_Linear", "B3_Validation_Threshold_Mitigated"} & set(which)
    n = train.count() if need_b1 or "B2_Fairness_Reweighted" in which else 0
    b1 = logistic(n).fit(train) if need_b1 else None
    if "B1_Clean_Unmitigated_Linear" in which:
        out["B1_Clean_Unmitigated_Linear"] = FittedModel(b1)
    weighted = with_reweighing(train, "fair_weight") if {"B2_Fairness_Reweighted", "B4_Proposed_Tuned_XGB"} & set(which) else None
    if "B2_Fairness_Reweighted" in which:
        out["B2_Fairness_Reweighted"] = FittedModel(logistic(n, "fair_weight").fit(weighted))
    if "B3_Validation_Threshold_Mitigated" in which:
        rule = equalized_odds_rule(score(b1, val))
        out["B3_Validation_Threshold_Mitigated"] = FittedModel(b1, rule)
    if "B4_Proposed_Tuned_XGB" in which:
        scale = M.class_balance(train).first()["positive_scale"]
        balanced = weighted.withColumn(
            "boost_weight", F.col("fair_weight") * F.when(F.col("y_true") == 1, scale).otherwise(1.0)
        )
        model = fit_boosted(balanced, "boost_weight", rounds=rounds, seed=seed)
        out["B4_Proposed_Tuned_XGB"] = FittedModel(model or boosted("boost_weight", rounds=rounds, seed=seed).fit(balanced))
    return out


# --- search and elimination -------------------------------------------------------------------------------

def candidate_metrics(scored: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Balanced accuracy, three-term gap and utility per fold from one grouped scan."""
    cells = confusion_cells(scored, (*by, "grp"))
    perf = merge_cells(cells, by).select(*by, *M.performance_columns())
    gap = M.legacy_disparities(cells, by).select(*by, M.fairness_gap(("dp", "eo", "eodds")).alias("fairness_gap"))
    return perf.join(gap, list(by)).withColumn("utility", M.utility_score("balanced_accuracy", "fairness_gap"))


def cross_validated_scores(
    df: DataFrame, build: Callable[[dict], object], grid: Sequence[dict], row_id: str = "row_id", folds: int = 2, seed: int = 42
) -> DataFrame:
    """Mean utility over stratified folds for every setting; each fit is a Spark job."""
    if "split" in df.columns:
        require_no_holdout(df)
    folded = durable(stratified_folds(df, "y_true", row_id, folds, seed))
    out = None
    for i, params in enumerate(grid):
        for k in range(folds):
            model = build(params).fit(folded.filter(F.col("fold") != k))
            part = candidate_metrics(score(model, folded.filter(F.col("fold") == k))).withColumn("setting", F.lit(i))
            out = part if out is None else out.unionByName(part)
    agg = out.groupBy("setting").agg(
        F.avg("utility").alias("utility"), F.avg("balanced_accuracy").alias("balanced_accuracy"),
        F.avg("fairness_gap").alias("fairness_gap"), F.avg("accuracy").alias("accuracy"),
    )
    names = df.sparkSession.createDataFrame(
        [(i, str(sorted(p.items()))) for i, p in enumerate(grid)], "setting int, params string"
    )
    return names.join(agg, "setting")


def set_sizes(columns: int, drop_share: float, min_features: int, max_rounds: int) -> list[int]:
    """Numbers of columns that an elimination tries, from all of them downwards."""
    sizes = [columns]
    while sizes[-1] > min_features and len(sizes) <= max_rounds:
        sizes.append(sizes[-1] - max(1, int(sizes[-1] * drop_share)))
    return sizes


def most_important(model, columns: Sequence[str], count: int) -> list[str]:
    """The ``count`` columns that matter most to a model, in the given order; later columns win ties."""
    ranked = np.lexsort((np.arange(len(columns)), model.featureImportances.toArray()))
    return [columns[i] for i in sorted(ranked[len(columns) - count :])]


def eliminate_features(
    train: DataFrame, val: DataFrame, columns: Sequence[str], build: Callable[[], object] | None = None,
    drop_share: float = 0.15, min_features: int | None = None, max_rounds: int | None = None,
) -> tuple[list[str], DataFrame]:
    """Column sets of falling size, each made of what mattered most in the one before, and the set
    with the best utility on ``val`` (the first of equals; all columns if none has a utility).

    ``columns`` are numeric. Returns that set and a table of one row per set tried.
    """
    if "split" in train.columns:
        require_no_holdout(train)
    build = build or (lambda: boosted(rounds=20))
    floor = max(8, int(len(columns) * 0.25)) if min_features is None else min_features
    steps = min(8, len(columns) - floor) if max_rounds is None else max_rounds
    train, val = durable(train), durable(val)
    tried: list[tuple[list[str], object, Row]] = []
    for size in set_sizes(len(columns), drop_share, floor, max(0, steps)):
        chosen = most_important(tried[-1][1], tried[-1][0], size) if tried else list(columns)
        vectors = VectorAssembler(inputCols=chosen, outputCol="features", handleInvalid="keep")
        model = build().fit(vectors.transform(train))
        scored = score(model, vectors.transform(val)).withColumn("fold", F.lit(0))
        tried.append((chosen, model, candidate_metrics(scored).first()))
    names = ("utility", "balanced_accuracy", "fairness_gap")
    table = train.sparkSession.createDataFrame(
        [(i, len(c), *[m[x] for x in names]) for i, (c, _, m) in enumerate(tried)],
        "round int, features int, utility double, balanced_accuracy double, fairness_gap double",
    )
    rated = [(m["utility"], -i) for i, (_, _, m) in enumerate(tried) if m["utility"] is not None]
    return tried[-max(rated)[1]][0] if rated else list(columns), table


# --- effects ------------------------------------------------------------------------------------------------

def weighted_effect(df: DataFrame, effect: str | Column, propensity: str, treated: str = "treated", clip: float = 1e-3) -> DataFrame:
    """Mean effect, effect on the treated and inverse-probability weighted effect."""
    d = F.col(effect) if isinstance(effect, str) else effect
    p = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), F.col(propensity)))
    w = F.when(F.col(treated) == 1, 1.0 / p).otherwise(1.0 / (1.0 - p))
    return df.agg(
        F.avg(d).alias("ate"),
        F.avg(F.when(F.col(treated) == 1, d)).alias("treated_effect"),
        (F.sum(w * d) / F.sum(w)).alias("ipw_ate"),
    )


def matched_difference(
    df: DataFrame, propensity: str, outcome: str = "y_true", treated: str = "treated", row_id: str = "row_id"
) -> DataFrame:
    """Mean outcome of treated rows minus their nearest controls.

    Treated rows fold to distinct scores, so one lookup per score and one per control row
    suffices.
    """
    points = df.select(
        F.col(propensity).cast("double").alias("score"), F.col(treated).alias("treated"), F.col(row_id).alias("row_id"),
        F.col(outcome).cast("double").alias("y"),
    )
    match = nearest_controls(points)
    need = points.filter("treated = 1").groupBy("score").agg(F.sum("y").alias("y_sum"), F.count(F.lit(1)).alias("k"))
    controls = points.filter("treated = 0").select(F.col("row_id").alias("control_id"), F.col("y").alias("control_y"))
    joined = need.join(match, "score").join(controls, "control_id")
    return joined.agg(
        ((F.sum("y_sum") - F.sum(F.col("control_y") * F.col("k"))) / F.sum("k")).alias("matched_difference"),
        F.sum("k").alias("treated_rows"),
    )


def effect_estimates(
    train: DataFrame, test: DataFrame, features: Features, treated: str = "treated", outcome: str = "y_true", row_id: str = "row_id"
) -> DataFrame:
    """G-computation, effect on the treated, IPW and matched difference on the test rows.

    Outcome and propensity models fit on train with balanced classes. Rows and scores are read many times: both are
    dealt over tasks and written once.
    """
    train, test = stored(dealt(train, row_id)), stored(dealt(test, row_id))
    n = train.count()

    def balanced(df: DataFrame, label: str) -> DataFrame:
        r = df.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.5
        r = min(max(r, 1e-9), 1 - 1e-9)
        return df.withColumn("__w", F.when(F.col(label) == 1, 0.5 / r).otherwise(0.5 / (1 - r)))

    with_t = replace(features, numeric=(*features.numeric, treated))
    prep_y = fit_preprocessor(train, with_t)
    y_model = logistic(n, "__w").setLabelCol(outcome).fit(balanced(prep_y.transform(train), outcome))
    prep_t = fit_preprocessor(train, features)
    t_model = logistic(n, "__w").setLabelCol(treated).fit(balanced(prep_t.transform(train), treated))

    keep = [c for c in test.columns]

    def outcome_under(df: DataFrame, value: int, out: str) -> DataFrame:
        forced = df.withColumn("__t", F.col(treated)).withColumn(treated, F.lit(float(value)))
        scored = y_model.transform(prep_y.transform(forced)).withColumn(out, vector_to_array("probability")[1])
        extra = [c for c in df.columns if c not in keep]
        return scored.withColumn(treated, F.col("__t")).select(*keep, *extra, out)

    scored = outcome_under(outcome_under(test, 0, "p0"), 1, "p1")
    scored = t_model.transform(prep_t.transform(scored)).withColumn("propensity", vector_to_array("probability")[1])
    scored = stored(scored.select(*keep, (F.col("p1") - F.col("p0")).alias("effect"), "propensity"))
    means = weighted_effect(scored, "effect", "propensity", treated)
    clipped = scored.withColumn("propensity", F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("propensity"))))
    matched = matched_difference(clipped, "propensity", outcome, treated, row_id).select("matched_difference").scalar()
    return means.select(
        F.inline(
            F.array(
                F.struct(F.lit("G-computation ATE").alias("estimate"), F.col("ate").alias("value")),
                F.struct(F.lit("Treated effect").alias("estimate"), F.col("treated_effect").alias("value")),
                F.struct(F.lit("IPW ATE").alias("estimate"), F.col("ipw_ate").alias("value")),
                F.struct(F.lit("Matched difference").alias("estimate"), matched.alias("value")),
            )
        )
    )
