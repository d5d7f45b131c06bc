"""Ranks, quartile labels, Pareto frontier, nearest match, top lists, redaction order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.expr import digest
from evenhand.operators.order import (
    attach, default_buckets, hash_prefix, prefix_sums, range_bounds, range_profile, rank_cuts, with_positions, with_range_bucket,
)
from evenhand.session import stored


def _rank_table(df: DataFrame, value: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Percent rank per distinct value, and how often each value occurs."""
    # read for the total, the bounds, the running sums and the hot keys: folded once, then written
    distinct = stored(
        df.filter(F.col(value).cast("double").isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    )
    total = distinct.agg(F.sum("__n").alias("n")).scalar()
    ranked = prefix_sums(distinct, value, {"__n": "__upto"}).select(
        value, ((F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2.0) / total).alias(out)
    )
    return ranked, distinct


def percent_ranks(df: DataFrame, value: str, out: str = "pct_rank") -> DataFrame:
    """Average-tie rank divided by the number of non-null values. NULL keeps NULL.

    Ranks are worked out per distinct value and looked up; a value shared by a third of the
    rows is one row in that table and its lookup is salted.
    """
    ranked, counts = _rank_table(df, value, out)
    return attach(df, ranked, [value], counts=counts, many=True)


def rank_signal(df: DataFrame, weights: dict[str, float], out: str = "signal") -> DataFrame:
    """Weighted sum of percent ranks. All rank tables come from the plain input, so a lookup
    never repeats the ones before it."""
    ranked, total = df, None
    for i, (c, w) in enumerate(weights.items()):
        table, counts = _rank_table(df, c, f"__r{i}")
        ranked = attach(ranked, table, [c], counts=counts, many=True)
        term = F.col(f"__r{i}") * F.lit(float(w))
        total = term if total is None else total + term
    return ranked.withColumn(out, total).drop(*[f"__r{i}" for i in range(len(weights))])


def quartile_labels(
    df: DataFrame, value: str, row_id: str, labels: Sequence[str], out: str = "quartile"
) -> DataFrame:
    """Equal-count bins of the first-come rank: bin k ends at rank 1 + (n - 1) k / bins.

    Ties are ordered by the digest of the row key. The bin edges are exact rank cuts, so rows
    are compared with constants and never numbered.
    """
    bins = len(labels)
    keyed = (
        df.filter(F.col(value).isNotNull())
        .select(F.col(value).cast("double").alias("v"), digest(row_id).alias("h"))
        .withColumn("p", hash_prefix("h"))
    )
    n, bounds = range_profile(keyed, "v", default_buckets(df))
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("string"))
    ranks = [(k, int(1 + (n - 1) * k / bins)) for k in range(1, bins)]
    cuts = df.sparkSession.createDataFrame(ranks, "cut int, rank bigint")
    binned = with_range_bucket(keyed, "v", bounds, "b")
    found = sorted(rank_cuts(binned, cuts, ["b", "v", "p", "h"]).collect(), key=lambda r: r["cut"])
    v, h = F.col(value).cast("double"), digest(row_id)
    expr: Column | None = None
    for row, label in zip(found, labels):
        inside = (v < row["v"]) | ((v == row["v"]) & (h <= row["h"]))
        expr = F.when(inside, label) if expr is None else expr.when(inside, label)
    expr = expr.otherwise(labels[-1])
    return df.withColumn(out, F.when(F.col(value).isNotNull(), expr))


def pareto_frontier(candidates: DataFrame, good: str = "accuracy", bad: str = "fairness_gap") -> DataFrame:
    """Candidates that no other one beats on both axes.

    Per distinct ``bad`` value only the best ``good`` can survive, and only if it is better
    than everything at a smaller ``bad``; a running maximum over the distinct values replaces
    the comparison of all pairs. Equal candidates all stay.
    """
    best = candidates.groupBy(bad).agg(F.max(good).alias("__best"))
    bounds = range_bounds(best, bad, default_buckets(candidates))
    binned = with_range_bucket(best, bad, bounds, "__b")
    per = binned.groupBy("__b").agg(F.max("__best").alias("__top"))
    carry = per.select(
        "__b",
        F.max("__top")
        .over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        .alias("__before"),
    )
    local = Window.partitionBy("__b").orderBy(bad).rowsBetween(Window.unboundedPreceding, -1)
    edge = binned.join(F.broadcast(carry), "__b").select(  # one row per bucket
        bad, "__best", F.greatest(F.max("__best").over(local), F.col("__before")).alias("__beaten")
    )
    kept = edge.filter(F.col("__beaten").isNull() | (F.col("__best") > F.col("__beaten"))).select(bad, "__best")
    return attach(candidates, kept, [bad], "inner").filter(F.col(good) == F.col("__best")).drop("__best")


def nearest_controls(
    df: DataFrame, score: str = "score", treated: str = "treated", row_id: str = "row_id"
) -> DataFrame:
    """For every treated score the nearest control score (with replacement) and the control
    row that stands for it: the smaller score on a tie, then the smallest key.

    Both sides fold to distinct scores. Inside a range bucket a window finds the last control
    below and the first above; buckets without controls take the neighbours carried across a
    table of one row per bucket.
    Returns ``score, control_score, control_id``.
    """
    s = F.col(score).cast("double")
    points = df.groupBy(s.alias("score")).agg(
        F.min(F.when(F.col(treated) == 0, F.col(row_id))).alias("control_id"),
        F.max(F.col(treated)).alias("has_treated"),
    )
    bounds = range_bounds(df, score, default_buckets(df))
    binned = with_range_bucket(points, "score", bounds, "b").withColumn(
        "ctl", F.when(F.col("control_id").isNotNull(), F.struct("score", "control_id"))
    )
    per = binned.groupBy("b").agg(F.max("ctl").alias("hi"), F.min("ctl").alias("lo"))
    order = Window.partitionBy(F.lit(0)).orderBy("b")
    carried = per.select(
        "b",
        F.last("hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
        F.first("lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
    )
    # both frames begin at the edge they run from: one that ends at the last row is worked out anew for every row
    rising, falling = (Window.partitionBy("b").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("score"), F.desc("score")))
    joined = binned.join(F.broadcast(carried), "b")  # one row per bucket
    below = F.coalesce(F.last("ctl", ignorenulls=True).over(rising), F.col("left"))
    above = F.coalesce(F.last("ctl", ignorenulls=True).over(falling), F.col("right"))
    both = joined.select("score", "has_treated", below.alias("below"), above.alias("above")).filter("has_treated = 1")
    near_below = F.col("above").isNull() | (
        F.col("below").isNotNull() & (F.col("score") - F.col("below.score") <= F.col("above.score") - F.col("score"))
    )
    pick = F.when(near_below, F.col("below")).otherwise(F.col("above"))
    return both.select("score", pick.alias("m")).select(
        "score", F.col("m.score").alias("control_score"), F.col("m.control_id").alias("control_id")
    )


def worst_groups(subgroups: DataFrame, k: int = 3) -> DataFrame:
    """Supported groups with the lowest balanced accuracy (NULL last, then by label)."""
    return (
        subgroups.filter(F.col("support_status") == V.VALID)
        .orderBy(F.asc_nulls_last("balanced_accuracy"), "grp")
        .limit(k)
        .select("grp", "balanced_accuracy", "tpr", F.col("n").alias("sample_size"))
    )


def worst_group_disclosure(subgroups: DataFrame) -> DataFrame:
    """What was searched before a worst group was named."""
    ok = F.col("support_status") == V.VALID
    return subgroups.agg(
        F.count(F.lit(1)).alias("groups_searched"),
        F.count(F.when(ok, 1)).alias("supported_groups"),
        F.count(F.when(~ok, 1)).alias("unsupported_groups"),
        F.lit(5).alias("metrics_searched"),
        (F.count(F.lit(1)) * 5 + F.count(F.lit(1)) * 3).alias("comparisons"),
    )


def redacted_subgroups(
    subgroups: DataFrame, min_population: int = 10, max_groups: int | None = None, mask_labels: bool = False
) -> DataFrame:
    """Groups fit for an external report: small ones dropped, the rest by size, at most
    ``max_groups``, labels replaced on request."""
    kept = subgroups.filter(F.col("n") >= min_population)
    order = [F.desc("n"), F.asc("grp")]
    if max_groups is not None:  # the largest come from a heap per task; only so many rows are numbered
        few = kept.orderBy(*order).limit(max_groups)
        numbered = few.withColumn("disclosure_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    else:
        numbered = with_positions(kept, order, "disclosure_rank")
    if mask_labels:
        numbered = numbered.withColumn("grp", F.format_string("REDACTED_GROUP_%03d", "disclosure_rank"))
    return numbered
