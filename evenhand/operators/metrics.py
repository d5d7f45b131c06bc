"""Rates, disparities and statuses as arithmetic on confusion cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.expr import count_where, mean_defined, ratio, unpivot_structs


@dataclass(frozen=True)
class Gates:
    """Minimum support per group."""

    size: int = 5
    positives: int = 0
    negatives: int = 0
    #: DIR alone may use a smaller size.
    ratio_size: int | None = None

    @property
    def di_size(self) -> int:
        return self.size if self.ratio_size is None else self.ratio_size


def with_rates(cells: DataFrame) -> DataFrame:
    """Class-conditional rates; NULL where the denominator is empty."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    picked, total = F.col("tp") + F.col("fp"), pos + neg
    out = cells.select(
        "*",
        pos.alias("positive_count"),
        neg.alias("negative_count"),
        ratio(pos, total).alias("positive_prevalence"),
        ratio(picked, total).alias("selection_rate"),
        ratio("tp", pos).alias("tpr"),
        ratio("tn", neg).alias("tnr"),
        ratio("fp", neg).alias("fpr"),
        ratio("fn", pos).alias("fnr"),
        ratio("tp", picked).alias("ppv"),
    )
    return out.withColumn("balanced_accuracy", (F.col("tpr") + F.col("tnr")) / 2.0)


def support_status(gates: Gates) -> Column:
    thin = F.col("n") < gates.size
    if gates.positives > 0:
        thin = thin | (F.col("positive_count") < gates.positives)
    if gates.negatives > 0:
        thin = thin | (F.col("negative_count") < gates.negatives)
    return F.when(thin, V.INSUFFICIENT_GROUP).otherwise(V.VALID)


def subgroup_table(cells: DataFrame, gates: Gates = Gates()) -> DataFrame:
    return with_rates(cells).withColumn("support_status", support_status(gates))


# --- global performance ------------------------------------------------------------------

def performance_columns() -> list[Column]:
    """Accuracy .. F1 from one row of cells. Precision, recall and F1 are 0 on an empty
    denominator; balanced accuracy is NULL with one class in the target."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ((tpr + tnr) / 2.0).alias("balanced_accuracy"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(tpr, zero).alias("recall"),
        F.coalesce(ratio(tp * 2.0, tp * 2.0 + fp + fn), zero).alias("f1_score"),
    ]


def global_performance(total: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Performance and rates of one predictor (or one per ``by`` key), wide."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return total.select(
        *by,
        "n",
        "tn",
        "fp",
        "fn",
        "tp",
        *performance_columns(),
        ratio(tp, tp + fn).alias("tpr"),
        ratio(tn, tn + fp).alias("tnr"),
        ratio(fp, tn + fp).alias("fpr"),
        ratio(fn, tp + fn).alias("fnr"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tp + fp, tp + fp + fn + tn).alias("positive_prediction_rate"),
        ratio(tp + fn, tp + fp + fn + tn).alias("actual_positive_prevalence"),
    )


def performance_rows(total: DataFrame) -> DataFrame:
    """Long form ``metric, value, status`` of :func:`global_performance`."""
    wide = global_performance(total)

    def row(name: str, value: str, undefined: str | None = None) -> Column:
        status = F.lit(V.VALID)
        if undefined:
            status = F.when(F.col(value).isNull(), undefined).otherwise(V.VALID)
        return F.struct(
            F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"), status.alias("status")
        )

    return wide.select(
        unpivot_structs(
            [
                row("Accuracy", "accuracy"),
                row("Balanced Accuracy", "balanced_accuracy"),
                row("Precision", "precision"),
                row("Recall", "recall"),
                row("F1-Score", "f1_score"),
                row("TP", "tp"),
                row("TN", "tn"),
                row("FP", "fp"),
                row("FN", "fn"),
                row("TPR", "tpr", V.ZERO_POSITIVE),
                row("TNR", "tnr", V.ZERO_NEGATIVE),
                row("FPR", "fpr", V.ZERO_NEGATIVE),
                row("FNR", "fnr", V.ZERO_POSITIVE),
                row("PPV", "ppv", V.UNDEFINED),
                row("Positive Prediction Rate", "positive_prediction_rate"),
                row("Actual Positive Prevalence", "actual_positive_prevalence"),
            ]
        )
    )


# --- group disparities -------------------------------------------------------------------

def _first_failing(status: Column) -> Column:
    """Status of the first group in label order whose own status is not NULL."""
    return F.min_by(status, F.when(status.isNotNull(), F.col("grp")))


def rated_groups(cells: DataFrame, weighted: bool = False) -> DataFrame:
    """Group rows with their rates, as the disparities look at them."""
    g = with_rates(cells)
    if not weighted:
        return g.withColumn("eo_tpr", F.col("tpr"))
    # an all-zero weight gives a defined rate of zero in the weighted path
    g = g.withColumn("selection_rate", F.coalesce("selection_rate", F.lit(0.0)))
    return g.withColumn("eo_tpr", F.when(F.col("pos_n") > 0, F.coalesce("tpr", F.lit(0.0))))


def disparity_wide(
    cells: DataFrame,
    gates: Gates = Gates(),
    by: tuple[str, ...] = (),
    weighted: bool = False,
    keep: dict[str, Column] | None = None,
    rates: bool = False,
) -> DataFrame:
    """All five disparities of each ``by`` key from one aggregation over group rows.

    Columns come in pairs ``dp_value, dp_status`` .. ``di_value, di_status`` plus
    ``groups``, ``min_n`` and the groups with the lowest and the highest selection rate. Every part
    is mergeable and of fixed size, however many groups there are. ``keep`` adds further aggregates of
    the same pass; ``rates`` a map of all groups' selection rates, for reports on few groups
    (:func:`selection_rate_rows` has them as rows).
    """
    keep = keep or {}
    g = rated_groups(cells, weighted)
    pos, neg = F.col("positive_count"), F.col("negative_count")
    eo_fail = F.when(F.col("pos_n") == 0, V.ZERO_POSITIVE)
    odds_fail = F.when(pos == 0, V.ZERO_POSITIVE).when(neg == 0, V.ZERO_NEGATIVE)
    if gates.positives > 0:
        eo_fail = eo_fail.when(F.col("pos_n") < gates.positives, V.INSUFFICIENT_GROUP)
        odds_fail = odds_fail.when(pos < gates.positives, V.INSUFFICIENT_GROUP)
    if gates.negatives > 0:
        odds_fail = odds_fail.when(neg < gates.negatives, V.INSUFFICIENT_GROUP)
    pp_fail = F.when(F.col("sel_n") == 0, V.UNDEFINED)

    def spread(c: str) -> Column:
        return F.max(c) - F.min(c)

    def by_rate(rate: Column) -> Column:
        """Order by rate, then label; groups without a rate take no part."""
        return F.when(rate.isNotNull(), F.struct(rate, F.col("grp")))

    agg = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.min("n").alias("min_n"),
        spread("selection_rate").alias("__dp"),
        spread("eo_tpr").alias("__eo"),
        F.greatest(spread("tpr"), spread("fpr")).alias("__odds"),
        spread("ppv").alias("__pp"),
        F.min("selection_rate").alias("min_rate"),
        F.max("selection_rate").alias("max_rate"),
        F.min(F.when(F.col("selection_rate") > 0, F.col("selection_rate"))).alias("min_positive_rate"),
        (F.max(F.coalesce("ppv", F.lit(0.0))) - F.min(F.coalesce("ppv", F.lit(0.0)))).alias("__pp_zero"),
        _first_failing(eo_fail).alias("__eo_fail"),
        _first_failing(odds_fail).alias("__odds_fail"),
        _first_failing(pp_fail).alias("__pp_fail"),
        F.min_by("grp", by_rate(F.col("selection_rate"))).alias("lowest_group"),
        F.min_by("grp", by_rate(-F.col("selection_rate"))).alias("highest_group"),
        *([F.map_from_entries(F.sort_array(F.collect_list(F.struct("grp", "selection_rate")))).alias("__rates")] if rates else []),
        *[c.alias(name) for name, c in keep.items()],
    )
    few = F.col("groups") < 2

    def gated(size: int) -> Column:
        return F.when(few, V.MISSING_SENSITIVE).when(F.col("min_n") < size, V.INSUFFICIENT_GROUP)

    di_status = (
        gated(gates.di_size)
        .when(F.col("max_rate") <= 0, V.UNDEFINED)
        .when((F.col("max_rate") < V.DI_RATE_FLOOR) | (F.col("min_rate") < V.DI_RATE_FLOOR), V.UNSTABLE_RATIO)
        .otherwise(V.VALID)
    )
    out = agg.select(
        "*",
        gated(gates.size).otherwise(V.VALID).alias("dp_status"),
        F.coalesce(gated(gates.size), F.col("__eo_fail"), F.lit(V.VALID)).alias("eo_status"),
        F.coalesce(gated(gates.size), F.col("__odds_fail"), F.lit(V.VALID)).alias("eodds_status"),
        F.coalesce(F.when(few, V.MISSING_SENSITIVE), F.col("__pp_fail"), F.lit(V.VALID)).alias("pp_status"),
        di_status.alias("di_status"),
    )

    no_rates = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))

    def when_valid(status: str, value: Column) -> Column:
        return F.when(F.col(status) == V.VALID, value)

    return out.select(
        *by,
        "groups",
        "min_n",
        "min_rate",
        "max_rate",
        "min_positive_rate",
        F.col("__pp_zero").alias("pp_zero_spread"),
        when_valid("dp_status", F.col("__dp")).alias("dp_value"),
        "dp_status",
        when_valid("eo_status", F.col("__eo")).alias("eo_value"),
        "eo_status",
        when_valid("eodds_status", F.col("__odds")).alias("eodds_value"),
        "eodds_status",
        when_valid("pp_status", F.col("__pp")).alias("pp_value"),
        "pp_status",
        when_valid("di_status", ratio("min_rate", "max_rate")).alias("di_value"),
        "di_status",
        "lowest_group",
        "highest_group",
        *([F.when(F.col("di_status").isin(*NO_RATES), no_rates).otherwise(F.col("__rates")).alias("selection_rates")] if rates else []),
        *keep,
    )


#: With these statuses of the ratio no selection rates are shown.
NO_RATES = (V.MISSING_SENSITIVE, V.INSUFFICIENT_GROUP)


def selection_rate_rows(cells: DataFrame, gates: Gates = Gates(), by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., grp, selection_rate, status`` of every group behind the disparate impact ratio, one row each."""
    rows = with_rates(cells).select(*by, "grp", "selection_rate")
    wide = disparity_wide(cells, gates, by).select(*by, F.col("di_status").alias("status")).filter(~F.col("status").isin(*NO_RATES))
    return rows.join(wide, list(by)) if by else rows.crossJoin(wide)  # one row when there is one predictor


DISPARITIES = [(V.DP, "dp"), (V.EO, "eo"), (V.EODDS, "eodds"), (V.PP, "pp"), (V.DIR, "di")]


def disparity_rows(wide: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Long form ``metric, value, status, message, lowest_group, highest_group``; the groups stand with the ratio."""

    def note(short: str) -> Column:
        return (
            F.when(F.col(f"{short}_status") == V.VALID, F.format_string("computed over %d groups", "groups"))
            .when(F.col(f"{short}_status") == V.MISSING_SENSITIVE, F.lit("needs two groups or more"))
            .when(
                F.col(f"{short}_status") == V.INSUFFICIENT_GROUP,
                F.format_string("support below the gate (smallest group has %d rows)", "min_n"),
            )
            .when(F.col(f"{short}_status") == V.UNSTABLE_RATIO, F.lit("a selection rate is next to zero"))
            .otherwise(F.lit("a group has no cases in the denominator"))
        )

    def named(short: str, c: str) -> Column:
        return (F.when(~F.col("di_status").isin(*NO_RATES), F.col(c)) if short == "di" else F.lit(None).cast("string")).alias(c)

    return wide.select(
        *by,
        unpivot_structs(
            [
                F.struct(
                    F.lit(name).alias("metric"),
                    F.col(f"{short}_value").alias("value"),
                    F.col(f"{short}_status").alias("status"),
                    note(short).alias("message"),
                    named(short, "lowest_group"),
                    named(short, "highest_group"),
                )
                for name, short in DISPARITIES
            ]
        ),
    )


def fairness_gap(terms: tuple[str, ...] = ("dp", "eo", "eodds", "pp")) -> Column:
    """Mean of the defined disparities of a wide row."""
    return mean_defined(*[F.abs(F.col(f"{t}_value")) for t in terms])


def utility_score(balanced_accuracy: str | Column, gap: str | Column, alpha: float = 0.25) -> Column:
    acc = F.col(balanced_accuracy) if isinstance(balanced_accuracy, str) else balanced_accuracy
    g = F.col(gap) if isinstance(gap, str) else gap
    return acc - F.lit(alpha) * F.coalesce(g, F.lit(0.5))


def accuracy_tradeoff(base: Column, mitigated: Column) -> Column:
    return F.greatest(F.lit(0.0), base - mitigated)


def overall_status(initial: Column) -> Column:
    """Predictive parity takes no part in the overall verdict."""
    broken = F.lit(False)
    for short in ("dp", "eo", "eodds", "di"):
        broken = broken | (F.col(f"{short}_status") != V.VALID)
    return F.when(initial != V.VALID, initial).when(broken, V.UNDEFINED).otherwise(V.VALID)


# --- ungated variants kept under their own names ---------------------------------------------

def legacy_disparities(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ungated metric set: an empty class gives a rate of 0, not an undefined one."""
    g = with_rates(cells)
    zero = F.lit(0.0)

    def spread(c: str) -> Column:
        x = F.coalesce(F.col(c), zero)
        return F.max(x) - F.min(x)

    agg = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        spread("selection_rate").alias("dp"),
        spread("tpr").alias("eo"),
        F.greatest(spread("tpr"), spread("fpr")).alias("eodds"),
        spread("ppv").alias("pp"),
        F.min("selection_rate").alias("low"),
        F.max("selection_rate").alias("high"),
        F.min(F.when(F.col("selection_rate") > 0, F.col("selection_rate"))).alias("low_positive"),
    )
    enough = F.col("groups") >= 2
    return agg.select(
        *by,
        *[F.when(enough, F.col(c)).alias(f"{c}_value") for c in ("dp", "eo", "eodds", "pp")],
        F.when(enough & (F.col("high") > 0), ratio("low_positive", "high")).alias("di_positive_only"),
        F.when(enough & (F.col("high") > 0), ratio("low", "high")).alias("di_raw"),
    )


# --- predictor collapse ------------------------------------------------------------------------

def collapse_columns(
    low: float = 0.02, high: float = 0.98, min_entropy: float = 0.10
) -> list[Column]:
    """Degeneracy of a predictor from one row of raw cells."""
    picked = F.col("tp") + F.col("fp")
    total = picked + F.col("tn") + F.col("fn")
    rate = ratio(picked, total)
    entropy = -((1.0 - rate) * F.log2(1.0 - rate) + rate * F.log2(rate))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    bal = (ratio("tp", pos) + ratio("tn", neg)) / 2.0
    majority_share = F.when(pos > neg, rate).otherwise(ratio(F.col("tn") + F.col("fn"), total))
    status = (
        F.when((picked == 0) | (picked == total), V.DEGENERATE)
        .when(rate <= low, V.DEGENERATE)
        .when(rate >= high, V.DEGENERATE)
        .when(entropy < min_entropy, V.DEGENERATE)
        .when((F.abs(bal - 0.50) < 0.015) & (majority_share > 0.85), V.INSUFFICIENT_SIGNAL)
        .otherwise(V.NORMAL)
    )
    reason = (
        F.when((picked == 0) | (picked == total), "one predicted class only")
        .when(rate <= low, "positive rate too low")
        .when(rate >= high, "positive rate too high")
        .when(entropy < min_entropy, "prediction entropy too low")
        .when((F.abs(bal - 0.50) < 0.015) & (majority_share > 0.85), "chance level behind a majority class")
        .otherwise("predictions vary enough")
    )
    return [rate.alias("prediction_rate"), status.alias("degeneracy_status"), reason.alias("degeneracy_message")]


def prediction_collapse(total: DataFrame, by: tuple[str, ...] = (), **limits) -> DataFrame:
    return total.select(*by, *collapse_columns(**limits))


# --- operating point, class balance -------------------------------------------------------------

def operating_point(total: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    zero = F.lit(0.0)
    return total.select(
        *by,
        F.coalesce(ratio("fp", F.col("fp") + F.col("tn")), zero).alias("fpr"),
        F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), zero).alias("tpr"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Balanced class weights and the negative-to-positive ratio (floor 1)."""
    y = F.col("y_true") == 1
    counts = df.agg(count_where(y).alias("pos"), count_where(~y).alias("neg"))
    n = F.col("pos") + F.col("neg")
    return counts.select(
        "pos",
        "neg",
        ratio(n, F.col("pos") * 2).alias("weight_positive"),
        ratio(n, F.col("neg") * 2).alias("weight_negative"),
        F.greatest(
            F.col("neg").cast("double") / F.greatest(F.col("pos"), F.lit(1)).cast("double"), F.lit(1.0)
        ).alias("positive_scale"),
    )


def majority_class(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent label (ties to the smaller) and the constant score it goes with."""
    y = F.col("y_true") == 1
    counts = df.groupBy(*by).agg(count_where(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    return counts.select(
        *by,
        F.when(F.col("pos") * 2 > F.col("n"), 1).otherwise(0).alias("majority_label"),
        ratio("pos", "n").alias("constant_score"),
    )
