"""Target leakage, group contamination and split overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand import vocab as V
from evenhand.functions.expr import ratio
from evenhand.functions.special import f_tail_column
from evenhand.operators.frames import numeric_columns
from evenhand.session import durable

FINDING = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("automatically_verified", T.BooleanType()),
        T.StructField("domain_interpretation_required", T.BooleanType()),
    ]
)


def _as_number(df: DataFrame, c: str) -> Column:
    """Coerced number: text that is no number becomes NULL, NaN too."""
    x = F.expr(f"try_cast(`{c}` AS double)") if _castable(df.schema[c].dataType) else F.lit(None).cast("double")
    return F.when(~F.isnan(x), x)


def _castable(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.StringType, T.BooleanType))


def _pearson(x: Column, y: Column) -> Column:
    """Correlation that is NULL, not an error, for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def target_statistics(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Copy counts, valid pairs and Pearson r of every feature with the target.

    All features go through ONE aggregation, so the table is read once whatever its width.
    """
    y = _as_number(df, target)
    aggs = []
    for i, c in enumerate(features):
        x = _as_number(df, c)
        both = x.isNotNull() & y.isNotNull()
        same = F.col(f"`{c}`").eqNullSafe(F.col(f"`{target}`")) if df.schema[c].dataType == df.schema[target].dataType else x.eqNullSafe(y)
        aggs += [
            F.sum(F.when(same, 0).otherwise(1)).alias(f"d{i}"),
            F.sum(F.when(x.eqNullSafe(1 - y), 0).otherwise(1)).alias(f"i{i}"),
            F.sum(F.when(both, 1).otherwise(0)).alias(f"n{i}"),
            _pearson(F.when(both, x), F.when(both, y)).alias(f"r{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
        ]
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.stddev_samp(y).alias("target_std"),
        F.sum(F.when(y.isNull() | y.isin(0.0, 1.0), 0).otherwise(1)).alias("not_binary"),
        *aggs,
    )
    return wide.select(
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(c).alias("feature_name"),
                        (F.col(f"d{i}") == 0).alias("is_copy"),
                        ((F.col(f"i{i}") == 0) & (F.col("not_binary") == 0)).alias("is_inverse"),
                        F.col(f"n{i}").cast("bigint").alias("pairs"),
                        F.when(
                            (F.col(f"n{i}") > 10) & (F.col(f"s{i}") > 1e-9) & (F.col("target_std") > 1e-9),
                            F.when(~F.isnan(f"r{i}"), F.col(f"r{i}")),
                        ).alias("correlation"),
                    )
                    for i, c in enumerate(features)
                ]
            )
        ),
    )


def name_semantics(stats: DataFrame, known: Sequence[str] | None = None) -> DataFrame:
    """Flags from the column name alone. A caller's list replaces the default one."""
    post = list(known) if known else V.POST_OUTCOME_COLUMNS
    low = F.lower("feature_name")
    words = F.filter(F.array(*[F.lit(s) for s in V.SUSPICIOUS_SUBSTRINGS]), lambda s: F.contains(low, s))
    return stats.withColumn("post_outcome", F.col("feature_name").isin(post) | low.isin(post)).withColumn(
        "suspicious_words", words
    )


def feature_findings(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    dataset: str = "Dataset",
    known: Sequence[str] | None = None,
    threshold: float = 0.98,
) -> DataFrame:
    """Leakage findings of the features (default: all columns but the target).

    A copy or an inverse ends the checks of a column; the name flags follow; a strong
    correlation is reported next to them.
    """
    names = list(features) if features is not None else [c for c in df.columns if c != target]
    if not names:
        return df.sparkSession.createDataFrame([], FINDING)
    stats = name_semantics(target_statistics(df, target, names), known)
    r, confirmed = F.col("correlation"), F.lit("CONFIRMED_LEAKAGE")

    def finding(status: Column, severity: Column, reason: Column, value: Column, verified: bool, review: Column) -> Column:
        return F.struct(
            F.lit(dataset).alias("dataset"),
            F.col("feature_name"),
            status.alias("status"),
            severity.alias("severity"),
            reason.alias("reason"),
            value.cast("double").alias("metric_value"),
            F.lit(verified).alias("automatically_verified"),
            review.alias("domain_interpretation_required"),
        )

    no, null = F.lit(False), F.lit(None)
    copied = finding(confirmed, F.lit("CRITICAL"), F.lit("copy of the target"), F.lit(1.0), True, no)
    inverse = finding(confirmed, F.lit("CRITICAL"), F.lit("inverse of the binary target"), F.lit(-1.0), True, no)
    post = finding(confirmed, F.lit("HIGH"), F.lit("known only after the outcome"), null, True, no)
    words = finding(
        F.lit("SUSPICIOUS_FEATURE"),
        F.lit("HIGH"),
        F.concat(F.lit("name contains: "), F.array_join("suspicious_words", ", ")),
        null,
        False,
        F.lit(True),
    )
    sure = F.abs(r) > 0.999
    linear = finding(
        F.when(sure, confirmed).otherwise("SUSPICIOUS_FEATURE"),
        F.when(sure, "CRITICAL").otherwise("HIGH"),
        F.format_string("correlation with the target, |r| = %.4f", F.abs(r)),
        r,
        True,
        ~sure,
    )
    others = F.array(
        F.when(F.col("post_outcome"), post),
        F.when(~F.col("post_outcome") & (F.size("suspicious_words") > 0), words),
        F.when(F.abs(r) >= threshold, linear),
    )
    picked = (
        F.when(F.col("is_copy"), F.array(copied)).when(F.col("is_inverse"), F.array(inverse)).otherwise(others)
    )
    return stats.select("position", F.explode(F.filter(picked, lambda f: f.isNotNull())).alias("f")).select("f.*")


# --- group contamination -------------------------------------------------------------------

def group_codes(labels: DataFrame, group: str) -> DataFrame:
    """Each text label with its place in sorted order (0-based). Labels are counted per leading
    part of their digest-free sort order, so no task numbers all of them."""
    at = durable(labels.select(F.col(group).cast("string").alias(group)).na.drop().distinct().orderBy(group).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))  # one row per task of the sort
    base = sizes.select("__part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("__part")) - F.col("n")).alias("__base"))
    code = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("__part", part).join(base, "__part").select(group, code.cast("double").alias("code"))


def group_correlations(
    df: DataFrame, features: Sequence[str], group: str = "grp", threshold: float = 0.20
) -> DataFrame:
    """Pearson r of the group with each numeric feature (> 20 pairs, both deviations above 1e-9).

    A numeric group counts with its own value; a text label with its place in sorted order, a
    missing one with -1. The value is constant inside a group, so r follows from per-group sums:
    the rows fold to one row per group and the codes join those few rows, not the table. Sums
    are taken around the means, which keeps r accurate far from zero.
    """
    numeric = isinstance(df.schema[group].dataType, T.NumericType)
    mean_code = df.agg(F.avg(F.col(group).cast("double")).alias("m")).first()["m"] or 0.0 if numeric else 0.0
    means = df.agg(*[F.avg(_as_number(df, c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    aggs = []
    for i, c in enumerate(features):
        x = _as_number(df, c) - F.lit(means[f"m{i}"] or 0.0)
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    if numeric:
        per = df.groupBy(group).agg(*aggs)
        coded = per.withColumn("code", F.coalesce(F.col(group).cast("double"), F.lit(-1.0)) - F.lit(mean_code))
    else:
        per = df.groupBy(F.col(group).cast("string").alias(group)).agg(*aggs)
        coded = per.join(group_codes(per, group), group, "left").withColumn("code", F.coalesce("code", F.lit(-1.0)))
    k = F.col("code")
    wide = coded.agg(
        *[
            F.struct(
                F.sum(f"n{i}").alias("n"),
                F.sum(f"s{i}").alias("x"),
                F.sum(f"q{i}").alias("xx"),
                F.sum(k * F.col(f"n{i}")).alias("k"),
                F.sum(k * k * F.col(f"n{i}")).alias("kk"),
                F.sum(k * F.col(f"s{i}")).alias("kx"),
            ).alias(f"f{i}")
            for i in range(len(features))
        ]
    )
    long = wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(f"f{i}").alias("m")) for i, c in enumerate(features)])
        )
    )
    n = F.col("m.n")
    cov = n * F.col("m.kx") - F.col("m.k") * F.col("m.x")
    var_x = n * F.col("m.xx") - F.col("m.x") * F.col("m.x")
    var_k = n * F.col("m.kk") - F.col("m.k") * F.col("m.k")
    usable = (n > 20) & (F.sqrt(var_x) / n > 1e-9) & (F.sqrt(var_k) / n > 1e-9)
    r = F.when(usable, cov / (F.sqrt(var_x) * F.sqrt(var_k)))
    return long.select(
        "feature_name",
        n.alias("pairs"),
        r.alias("correlation"),
        F.coalesce(F.abs(r) >= threshold, F.lit(False)).alias("contaminated"),
    )


def group_separation(df: DataFrame, features: Sequence[str], group: str = "grp") -> DataFrame:
    """One-way ANOVA of every feature over the groups with more than three values.

    After the means, one pass gives count, mean and population variance per group and feature; the F ratio is
    arithmetic on those rows.
    """
    means = df.agg(*[F.avg(_as_number(df, c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    aggs = []
    for i, c in enumerate(features):
        x = _as_number(df, c) - F.lit(means[f"m{i}"] or 0.0)  # centred: squares of large values would cancel
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per = df.filter(F.col(group).isNotNull()).groupBy(group).agg(*aggs)
    long = per.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature_name"),
                        F.col(f"n{i}").alias("n"),
                        F.col(f"m{i}").alias("m"),
                        F.col(f"v{i}").alias("v"),
                    )
                    for i, c in enumerate(features)
                ]
            )
        )
    ).filter("n > 3")
    # between-group spread from the mergeable second moment of the group means
    agg = long.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    return agg.filter("groups >= 2").select(
        "feature_name",
        "groups",
        "n",
        (F.col("groups") - 1).alias("df_between"),
        (F.col("n") - F.col("groups")).alias("df_within"),
        F.try_divide(
            between / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups"))
        ).alias("f_statistic"),
    )


def contamination_report(
    df: DataFrame, features: Sequence[str] | None = None, group: str = "grp", threshold: float = 0.20
) -> DataFrame:
    """Both contamination tests with the p-value of the ANOVA, one row per feature."""
    features = list(features or [c for c in numeric_columns(df) if c != group])
    tail = f_tail_column(F.col("f_statistic"), F.col("df_between"), F.col("df_within"))
    p = group_separation(df, features, group).select("feature_name", "f_statistic", tail.alias("p_value")).filter("p_value IS NOT NULL")
    out = group_correlations(df, features, group, threshold).join(p, "feature_name", "left")
    separated = F.coalesce(F.col("p_value") < 0.001, F.lit(False))
    return out.withColumn("separated", separated).withColumn(
        "heavily_contaminated", F.col("contaminated") | separated
    )


# --- splits ----------------------------------------------------------------------------------

PAIRS = [("Train vs Test", "train", "test"), ("Train vs Validation", "train", "val"), ("Validation vs Test", "val", "test")]


def split_overlap(
    df: DataFrame, keys: Sequence[str], split: str = "split", dataset: str = "Dataset", only_hits: bool = True
) -> DataFrame:
    """Rows shared by two splits, as the number of matching pairs.

    Counting per key and split first makes ``sum(n_a * n_b)`` the size of the join without
    making the join: a key with a billion copies on both sides costs one row. The share is of
    the right-hand rows and may exceed one; ``overlap_rows`` counts right-hand rows once.
    """
    clean = df.select(split, *keys).na.drop(subset=list(keys))
    per = clean.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(split) == s, 1).otherwise(0)).alias(s) for s in ("train", "val", "test")]
    )
    wide = per.agg(
        *[
            F.struct(
                F.sum(F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(18,0)")).alias("pairs"),
                F.sum(F.when(F.col(a) > 0, F.col(b)).otherwise(0)).cast("bigint").alias("rows"),
                F.sum(b).cast("bigint").alias("right"),
            ).alias(f"p{i}")
            for i, (_, a, b) in enumerate(PAIRS)
        ]
    )
    long = wide.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("split_pair"), F.col(f"p{i}").alias("p")) for i, (n, _, _) in enumerate(PAIRS)]))
    )
    fraction = F.col("p.pairs").cast("double") / F.greatest(F.col("p.right"), F.lit(1))
    out = long.select(
        F.lit(dataset).alias("dataset"),
        "split_pair",
        F.col("p.pairs").alias("overlap_count"),
        fraction.alias("overlap_fraction"),
        F.col("p.rows").alias("overlap_rows"),
        F.coalesce(ratio("p.rows", "p.right"), F.lit(0.0)).alias("overlap_row_fraction"),
        F.when(F.col("p.pairs") > 0, "CONFIRMED_LEAKAGE").otherwise("CLEAN").alias("status"),
        F.when(F.col("p.pairs") == 0, "INFO").when(fraction > 0.05, "CRITICAL").otherwise("HIGH").alias("severity"),
    )
    return out.filter("overlap_count > 0") if only_hits else out


def integrity_report(
    df: DataFrame, target: str, keys: Sequence[str] | None = None, split: str = "split", dataset: str = "Dataset",
    known: Sequence[str] | None = None,
) -> DataFrame:
    """Feature findings over all splits together with overlap findings; ``critical`` marks
    the ones that stop a benchmark."""
    features = [c for c in df.columns if c not in (target, split)]
    found = feature_findings(df, target, features, dataset, known).select(
        F.lit("feature").alias("kind"), F.col("feature_name").alias("subject"), "status", "severity",
        F.col("metric_value").alias("value"),
    )
    overlap = split_overlap(df, keys or features, split, dataset).select(
        F.lit("split").alias("kind"), F.col("split_pair").alias("subject"), "status", "severity",
        F.col("overlap_count").cast("double").alias("value"),
    )
    return found.unionByName(overlap).withColumn(
        "critical", F.col("severity").isin("CRITICAL", "HIGH") & (F.col("status") == "CONFIRMED_LEAKAGE")
    )
