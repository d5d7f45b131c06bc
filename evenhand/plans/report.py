"""Run tables: long and flat results, seed summaries, paired deltas, slices, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.expr import ratio
from evenhand.operators import metrics as M
from evenhand.operators.cells import confusion_cells, merge_cells
from evenhand.operators.order import exact_quantiles

#: Suite columns that count as metrics of a run.
RUN_METRICS = [
    "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "fairness_gap", "dp_value", "eo_value",
    "eodds_value", "pp_value", "di_value", "utility_score", "brier_score", "expected_calibration_error",
    "tp", "tn", "fp", "fn", "specificity", "prediction_rate",
]


def run_rows(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(RUN_METRICS)) -> DataFrame:
    """Long form ``keys..., metric, value``; the width of the result never depends on the data."""
    have = [m for m in metrics if m in runs.columns]
    return runs.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in have])
        ),
    )


def flat_runs(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One wide row per run, for export."""
    return rows.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def subgroup_rows(suites: DataFrame, keys: Sequence[str]) -> DataFrame:
    return suites.select(*keys, F.explode("subgroups").alias("g")).select(*keys, "g.*")


def _spread() -> list[Column]:
    v = F.col("value")
    return [
        F.count(v).alias("runs"),
        F.avg(v).alias("mean"),
        F.percentile(v, 0.5).alias("median"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def seed_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread over seeds per metric. The interval is absent for one run or no spread."""
    agg = rows.filter(F.col("value").isNotNull()).groupBy(*keys, "metric").agg(*_spread())
    half = 1.96 * F.col("std") / F.sqrt("runs")
    usable = (F.col("runs") > 1) & (F.col("std") > 1e-9)
    return agg.withColumn("ci95_low", F.when(usable, F.col("mean") - half)).withColumn(
        "ci95_high", F.when(usable, F.col("mean") + half)
    )


def canonical_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As above, but the interval closes on the mean when there is nothing to spread."""
    out = seed_summary(rows, keys)
    return out.withColumn("ci95_low", F.coalesce("ci95_low", "mean")).withColumn(
        "ci95_high", F.coalesce("ci95_high", "mean")
    )


def canonical_status(c: str) -> Column:
    """A status as it is spelled today: older spellings that stored runs may hold are replaced."""
    names = F.create_map(*[F.lit(x) for pair in V.STATUS_ALIASES.items() for x in pair])
    return F.coalesce(names[F.col(c)], F.col(c))


def status_summary(runs: DataFrame, keys: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Most frequent value of each status column (ties to the smaller) and the compliant share."""
    aggs = [F.count(F.lit(1)).alias("seeds_count")]
    aggs += [F.mode(s, True).alias(s) for s in statuses]
    if "policy_passed" in runs.columns:
        aggs.append(F.avg(F.col("policy_passed").cast("double")).alias("policy_compliant_rate"))
    return runs.groupBy(*keys).agg(*aggs)


def paired_deltas(
    runs: DataFrame,
    reference: str,
    comparison: str,
    regime: str | None = None,
    metrics: Sequence[str] = ("accuracy", "balanced_accuracy", "eodds_value", "dp_value", "di_value"),
    key: str = "baseline_id",
    seed: str = "seed",
) -> DataFrame:
    """Per-metric difference over the seeds both baselines have.

    The two baselines meet by aggregation on the seed, not by a self-join.
    """
    subset = runs if regime is None else runs.filter(F.col("regime") == regime)
    subset = subset.filter(F.col(key).isin(reference, comparison))
    is_ref = F.col(key) == reference
    per = run_rows(subset, [seed, key], metrics).groupBy(seed, "metric").agg(
        F.max(F.when(is_ref, F.col("value"))).alias("a"),
        F.max(F.when(~is_ref, F.col("value"))).alias("b"),
        F.count(F.when(is_ref, 1)).alias("has_a"),
        F.count(F.when(~is_ref, 1)).alias("has_b"),
    )
    d = F.col("b") - F.col("a")
    both = per.filter("has_a > 0 AND has_b > 0").withColumn("d", d)
    return both.groupBy("metric").agg(
        F.count(F.lit(1)).alias("seeds_count"),
        F.avg("d").alias("mean_paired_delta"),
        F.when(F.count("d") > 1, F.stddev_samp("d")).otherwise(0.0).alias("std_paired_delta"),
        F.percentile("d", 0.5).alias("median_paired_delta"),
        F.min("d").alias("min_paired_delta"),
        F.max("d").alias("max_paired_delta"),
    ).select(
        "metric", F.lit(reference).alias("baseline_reference"), F.lit(comparison).alias("baseline_comparison"),
        "seeds_count", "mean_paired_delta", "std_paired_delta", "median_paired_delta", "min_paired_delta",
        "max_paired_delta",
    )


def subgroup_summary(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Count, accuracy and positive rate for several groupings in one pass."""
    tagged = df.select(
        "y_true",
        "y_pred",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(d).alias("dimension"), F.coalesce(c.cast("string"), F.lit("nan")).alias("value"))
                    for d, c in dimensions.items()
                ]
            )
        ),
    )
    right = (F.col("y_true") == F.col("y_pred")).cast("int")
    return tagged.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.sum(right), F.count(F.lit(1))).alias("accuracy"),
        ratio(F.sum("y_pred"), F.count(F.lit(1))).alias("positive_rate"),
    )


def robustness_slices(df: DataFrame, column: str, baseline: str, mitigated: str, dataset: str = "Dataset") -> DataFrame:
    """Accuracy and four-term gap of two predictors on the whole table and on both halves of a
    column. Both predictors and all slices share one grouped scan."""
    (median,) = exact_quantiles(df, column, [0.5])
    half = F.when(F.col(column) <= median, "Time Split (Early)").otherwise("Time Split (Late)")
    tagged = df.select(
        "y_true",
        "grp",
        F.explode(F.array(F.lit("Unseen Holdout"), half)).alias("slice"),
        F.col(baseline).alias("__a"),
        F.col(mitigated).alias("__b"),
    ).select(
        "y_true",
        "grp",
        "slice",
        F.inline(
            F.array(
                F.struct(F.lit("baseline").alias("model"), F.col("__a").alias("y_pred")),
                F.struct(F.lit("mitigated").alias("model"), F.col("__b").alias("y_pred")),
            )
        ),
    )
    by = ("slice", "model")
    cells = confusion_cells(tagged, (*by, "grp"))
    accuracy = merge_cells(cells, by).select(*by, *M.performance_columns()).select(*by, "accuracy")
    gap = M.legacy_disparities(cells, by).select(*by, M.fairness_gap().alias("gap"))
    joined = accuracy.join(gap, list(by))

    def of(model: str, c: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(c)))

    return joined.groupBy("slice").agg(
        of("baseline", "accuracy").alias("baseline_accuracy"),
        of("mitigated", "accuracy").alias("mitigated_accuracy"),
        of("baseline", "gap").alias("baseline_gap"),
        of("mitigated", "gap").alias("mitigated_gap"),
    ).withColumn("dataset", F.lit(dataset))


def observed_vs_expected(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Group prevalence against reference rates (``grp, expected_rate``), error per group.
    Groups on either side only keep a NULL on the other."""
    seen = M.with_rates(cells).select("grp", F.col("positive_prevalence").alias("observed_rate"))
    return seen.join(expected, "grp", "full_outer").select(
        "grp", "expected_rate", "observed_rate", (F.col("observed_rate") - F.col("expected_rate")).alias("error")
    )


def base_rate_gap_error(compared: DataFrame, first: str, second: str) -> DataFrame:
    """Error of the gap between two named groups."""

    def rate(g: str, c: str) -> Column:
        return F.max(F.when(F.col("grp") == g, F.col(c)))

    gaps = compared.agg(
        (rate(first, "observed_rate") - rate(second, "observed_rate")).alias("observed_gap"),
        (rate(first, "expected_rate") - rate(second, "expected_rate")).alias("expected_gap"),
    )
    return gaps.withColumn("gap_error", F.col("observed_gap") - F.col("expected_gap"))
