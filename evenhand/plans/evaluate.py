"""A whole audit as one row per predictor: the *suite row*.

One scan and one shuffle of the big table give cells per (run, group, reliability bin). All
performance, disparity, calibration and collapse values of any number of runs follow from those
few rows. The ROC area needs distinct scores and is the only second pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.expr import count_where
from evenhand.operators import frames as R
from evenhand.operators import metrics as M
from evenhand.operators import resample as B
from evenhand.operators import units as U
from evenhand.operators.calibration import roc_auc
from evenhand.operators.cells import ece_bin
from evenhand.session import stored


@dataclass(frozen=True)
class AuditConfig:
    """What to evaluate and how. ``by`` names the columns that tell runs apart."""

    by: Sequence[str] = ()
    gates: M.Gates = field(default_factory=M.Gates)
    missing_policy: str = "REJECT"
    imputation_rule_id: str | None = None
    imputation_rule: str | None = None
    weight: str | None = None
    unit_level: str = "ROW_LEVEL"
    unit_key: str | None = None
    strategy: str = "NONE"
    target_strategy: str | None = None
    prediction_strategy: str | None = None
    record_order: Sequence[str] = ("row_id",)
    min_calibration: int = 30
    alpha: float = 0.25
    baseline_accuracy: float | None = None
    uncertainty: bool = False
    replicates: int = 200
    resampling: str = "ROW_BOOTSTRAP"
    cluster: str | None = None
    allow_row_bootstrap: bool = False
    min_valid_fraction: float = 0.80
    seed: int = 42
    with_auc: bool = True


RAW = ["tn", "fp", "fn", "tp"]


def prepare(df: DataFrame, config: AuditConfig) -> tuple[DataFrame, str | None, list[str]]:
    """Unit handling. Returns frame, weight column and warnings."""
    warnings: list[str] = []
    weight = config.weight
    custom = config.target_strategy is not None or config.prediction_strategy is not None
    if config.unit_key and config.strategy == "NONE" and not custom and config.uncertainty:
        note = U.guard_row_bootstrap(
            df, config.unit_key, config.unit_level, config.resampling != "ROW_BOOTSTRAP", config.allow_row_bootstrap
        )
        if note:
            warnings.append(note)
    if config.unit_key and (config.strategy != "NONE" or custom):
        if config.strategy == "ENTITY_WEIGHTED" and not custom:
            df = U.entity_weights(df, config.unit_key, weight, config.by)
            weight = "entity_weight"
        else:
            df = U.collapse_entities(
                df,
                config.unit_key,
                config.record_order,
                config.target_strategy or config.strategy,
                config.prediction_strategy or config.strategy,
                config.by,
            )
            if weight:
                warnings.append("row weights do not apply to collapsed entities")
            weight = None
    return df, weight, warnings


BINS = range(10)


def suite_cells(df: DataFrame, config: AuditConfig, weight: str | None) -> DataFrame:
    """The one grouped scan: counts, weighted cells and score sums per run, raw group and bin."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    w = F.col(weight).cast("double") if weight else F.lit(1)
    score = F.col("y_prob").cast("double") if "y_prob" in df.columns else F.lit(None).cast("double")
    zero = F.lit(0.0) if weight else F.lit(0)

    def cell(cond: Column) -> Column:
        s = F.sum(F.when(cond, w).otherwise(zero))
        return s if weight else s.cast("bigint")

    conds = {"tn": ~y & ~p, "fp": ~y & p, "fn": y & ~p, "tp": y & p}
    raw = [count_where(c).alias(f"raw_{k}") for k, c in conds.items()] if weight else []
    cells = (
        df.withColumn("__bin", ece_bin(score))
        .groupBy(*config.by, "grp", "__bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *raw,
            *[cell(c).alias(k) for k, c in conds.items()],
            F.sum(score).alias("score_sum"),
            F.sum((score - F.col("y_true")) * (score - F.col("y_true"))).alias("sq_error"),
        )
    )
    return cells if weight else cells.select("*", *[F.col(c).alias(f"raw_{c}") for c in RAW])


def _group_rows(cells: DataFrame, config: AuditConfig) -> DataFrame:
    """Cells per run and group with support and calibration, after the missing-group policy.

    The policy looks at labels only, so it is applied to cells; what it drops or relabels is
    counted in the same pass.
    """
    by = list(config.by)
    missing = R.is_missing_group()
    tagged = cells.withColumn("__missing", F.when(missing, F.col("n")).otherwise(0)).withColumn(
        "__out", missing & F.lit(config.missing_policy == "EXCLUDE")
    )
    relabel = "REJECT" if config.missing_policy == "EXCLUDE" else config.missing_policy
    tagged = R.apply_missing_policy(tagged, relabel)
    raw_pos = F.col("raw_fn") + F.col("raw_tp")
    gap = F.when(F.col("__bin").isNotNull(), F.abs(raw_pos - F.col("score_sum"))).otherwise(0.0)
    g = tagged.groupBy(*by, "grp", "__out").agg(
        F.sum("n").alias("n"),
        F.sum("__missing").alias("__missing"),
        F.sum(raw_pos).alias("pos_n"),
        F.sum(F.col("raw_tn") + F.col("raw_fp")).alias("neg_n"),
        F.sum(F.col("raw_fp") + F.col("raw_tp")).alias("sel_n"),
        *[F.sum(c).alias(c) for c in RAW],
        *[F.sum(f"raw_{c}").alias(f"raw_{c}") for c in RAW],
        F.sum("sq_error").alias("sq_error"),
        F.sum("score_sum").alias("score_sum"),
        F.sum(gap).alias("bin_gap"),
        # signed distance per bin: group distances add up to the distance of the run
        F.array(
            *[F.sum(F.when(F.col("__bin") == i, raw_pos - F.col("score_sum")).otherwise(0.0)) for i in BINS]
        ).alias("bin_distance"),
    )
    thin = (
        (F.col("n") < config.min_calibration)
        | (F.col("fn") + F.col("tp") < 5)
        | (F.col("tn") + F.col("fp") < 5)
    )
    status = F.when(F.col("score_sum").isNull(), None).when(thin, V.INSUFFICIENT_CALIBRATION).otherwise(V.VALID)
    return g.select(
        "*",
        status.alias("calibration_support_status"),
        F.when(~thin, F.col("sq_error") / F.col("n")).alias("brier_score"),
        F.when(~thin, F.col("bin_gap") / F.col("n")).alias("expected_calibration_error"),
        F.when(thin, V.INSUFFICIENT_GROUP).otherwise(V.VALID).alias("calibration_status"),
    )


def subgroup_struct(gates: M.Gates) -> Column:
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return F.struct(
        "grp",
        "n",
        pos.cast("double").alias("positive_count"),
        neg.cast("double").alias("negative_count"),
        "positive_prevalence",
        "selection_rate",
        *[F.col(c).cast("double").alias(c) for c in ("tp", "tn", "fp", "fn")],
        "tpr",
        "tnr",
        "fpr",
        "fnr",
        "ppv",
        "balanced_accuracy",
        M.support_status(gates).alias("support_status"),
        "calibration_support_status",
        "brier_score",
        "expected_calibration_error",
        "calibration_status",
    )


def evaluate(df: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Suite rows: one per run with everything later stages need, its groups in a list."""
    return _suites(df, config)[0]


def evaluate_long(df: DataFrame, config: AuditConfig = AuditConfig()) -> tuple[DataFrame, DataFrame]:
    """Suite rows without lists of groups, and ``by..., grp, ...`` rows of the groups: for any number of groups.

    The groups are written once, as both results come from them. No row grows with their number; the worst three of a run
    are found by a limit in each task before anything meets.
    """
    suites, groups = _suites(df, config, nested=False)
    return suites, groups


def _worst_of(groups: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """``by..., worst_groups``: supported groups with the lowest balanced accuracy, ``k`` a run."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("balanced_accuracy"), "grp"))
    few = groups.filter(F.col("support_status") == V.VALID).withColumn("__at", place).filter(F.col("__at") <= k)
    entry = F.struct("__at", F.struct("grp", "balanced_accuracy", "tpr", F.col("n").alias("sample_size")).alias("g"))
    listed = few.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("w"))  # k entries
    return listed.select(*by, F.transform("w", lambda x: x["g"]).alias("worst_groups"))


def _suites(df: DataFrame, config: AuditConfig, nested: bool = True) -> tuple[DataFrame, DataFrame | None]:
    by = list(config.by)
    if not by:
        df, by = df.withColumn("run", F.lit("all")), ["run"]
    cfg = AuditConfig(**{**config.__dict__, "by": tuple(by)})
    frame, weight, warnings = prepare(df, cfg)
    groups = _group_rows(suite_cells(frame, cfg, weight), cfg)
    if cfg.missing_policy == "EXCLUDE":
        # the counts of dropped groups stay with their run
        dropped = groups.groupBy(*by).agg(F.sum("__missing").alias("missing_count"), F.sum("n").alias("rows_in"))
        groups = groups.filter(~F.col("__out"))
    rows = None
    if not nested:
        groups = stored(groups)
        rows = M.rated_groups(groups, weight is not None).select(*by, subgroup_struct(cfg.gates).alias("g")).select(*by, "g.*")
    distance = [F.sum(F.col("bin_distance")[i]) for i in BINS]
    keep = {
        "n": F.sum("n"),
        **{c: F.sum(c) for c in RAW},
        **{f"raw_{c}": F.sum(f"raw_{c}") for c in RAW},
        **({"subgroups": F.array_sort(F.collect_list(subgroup_struct(cfg.gates)))} if nested else {}),
        "run_brier": F.sum("sq_error") / F.sum("n"),
        "run_ece": F.when(
            F.count("score_sum") > 0, F.aggregate(F.array(*distance), F.lit(0.0), lambda acc, d: acc + F.abs(d)) / F.sum("n")
        ),
    }
    if cfg.missing_policy != "EXCLUDE":
        keep |= {"missing_count": F.sum("__missing"), "rows_in": F.sum("n")}
    out = M.disparity_wide(groups, cfg.gates, tuple(by), weighted=weight is not None, keep=keep, rates=nested)
    if rows is not None:
        worst = _worst_of(rows, by)
        none = F.array().cast(worst.schema["worst_groups"].dataType)
        out = out.join(worst, by, "left").withColumn("worst_groups", F.coalesce("worst_groups", none))
    if cfg.missing_policy == "EXCLUDE":
        out = out.join(dropped, by, "left")
    if cfg.with_auc and "y_prob" in frame.columns:
        auc = roc_auc(R.apply_missing_policy(frame, cfg.missing_policy), tuple(by)).withColumnRenamed("status", "auc_status")
        out = out.join(auc, by, "left")
    else:
        out = out.withColumn("roc_auc", F.lit(None).cast("double")).withColumn("auc_status", F.lit(V.VALID))
    return _suite_columns(out, by, cfg, warnings), rows


def _suite_columns(wide: DataFrame, by: list[str], cfg: AuditConfig, warnings: list[str]) -> DataFrame:
    initial = F.when(
        F.lit(cfg.missing_policy == "REJECT") & (F.coalesce("missing_count", F.lit(0)) > 0), V.MISSING_VIOLATION
    ).otherwise(V.VALID)
    some = F.coalesce("missing_count", F.lit(0)) > 0
    action = {
        "REJECT": "REJECTED_EVALUATION",
        "EXCLUDE": "EXCLUDED_FROM_METRICS",
        "EXPLICIT_UNKNOWN_GROUP": "MAPPED_TO_EXPLICIT_UNKNOWN_GROUP",
        "IMPUTE_WITH_DOCUMENTED_RULE": "IMPUTED_WITH_DOCUMENTED_RULE",
    }[cfg.missing_policy]
    collapsed = wide.select(
        "*",
        *M.performance_columns(),
        F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double")).alias("specificity"),
    )
    raw = {c: F.col(f"raw_{c}") for c in RAW}
    # collapse looks at unweighted predictions
    collapse = collapsed.select(
        "*",
        F.struct(*[raw[c].alias(c) for c in RAW]).alias("__raw"),
    )
    cols = _collapse_from(collapse)
    out = cols.withColumn("fairness_gap", M.fairness_gap()).withColumn("overall_status", M.overall_status(initial))
    utility = F.coalesce(M.utility_score("balanced_accuracy", "fairness_gap", cfg.alpha), F.lit(0.0))
    tradeoff = (
        M.accuracy_tradeoff(F.lit(cfg.baseline_accuracy), F.col("accuracy"))
        if cfg.baseline_accuracy is not None
        else F.lit(None).cast("double")
    )
    lists = ["selection_rates", "subgroups"] if "subgroups" in wide.columns else ["lowest_group", "highest_group"]
    if "subgroups" not in wide.columns:
        return _suite_row(out, by, cfg, warnings, utility, tradeoff, some, action, F.col("worst_groups"), lists)
    supported = F.filter("subgroups", lambda g: g["support_status"] == V.VALID)
    ranked = F.array_sort(
        F.transform(
            supported,
            lambda g: F.struct(
                F.coalesce(g["balanced_accuracy"], F.lit(float("inf"))).alias("key"), g["grp"].alias("grp"), g.alias("g")
            ),
        )
    )
    worst = F.transform(
        F.slice(ranked, 1, 3),
        lambda r: F.struct(
            r["grp"].alias("grp"),
            r["g"]["balanced_accuracy"].alias("balanced_accuracy"),
            r["g"]["tpr"].alias("tpr"),
            r["g"]["n"].alias("sample_size"),
        ),
    )
    return _suite_row(out, by, cfg, warnings, utility, tradeoff, some, action, worst, lists)


def _suite_row(
    out: DataFrame, by: list[str], cfg: AuditConfig, warnings: list[str], utility: Column, tradeoff: Column, some: Column, action: str,
    worst: Column, lists: list[str],
) -> DataFrame:
    return out.select(
        *by,
        F.col("n").alias("sample_size"),
        "groups",
        *[F.col(c).cast("double").alias(c) for c in RAW],
        "accuracy",
        "balanced_accuracy",
        "precision",
        "recall",
        "f1_score",
        "specificity",
        "prediction_rate",
        "roc_auc",
        "auc_status",
        F.col("run_brier").alias("brier_score"),
        F.col("run_ece").alias("expected_calibration_error"),
        *[f"{s}_{k}" for s in ("dp", "eo", "eodds", "pp", "di") for k in ("value", "status")],
        "fairness_gap",
        utility.alias("utility_score"),
        tradeoff.alias("accuracy_tradeoff"),
        "overall_status",
        "degeneracy_status",
        "degeneracy_message",
        (F.col("groups") * 5 + F.col("groups") * 3).alias("number_of_comparisons"),
        *lists,
        worst.alias("worst_groups"),
        F.struct(
            F.lit(cfg.missing_policy).alias("policy"),
            F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
            (F.coalesce("missing_count", F.lit(0)) / F.greatest("rows_in", F.lit(1))).alias("missing_fraction"),
            F.when(some, action).otherwise("NONE").alias("action_taken"),
        ).alias("missing_handling"),
        F.when(
            some & F.lit(cfg.missing_policy == "IMPUTE_WITH_DOCUMENTED_RULE"),
            R.imputation_struct(F.col("missing_count"), cfg.imputation_rule_id, cfg.imputation_rule),
        ).alias("imputation"),
        F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"),
        F.lit(cfg.unit_level).alias("unit_level"),
        F.lit(cfg.unit_key).cast("string").alias("unit_key"),
        F.lit(cfg.strategy).alias("aggregation_strategy"),
        F.lit(cfg.target_strategy or cfg.strategy).alias("target_strategy"),
        F.lit(cfg.prediction_strategy or cfg.strategy).alias("prediction_strategy"),
    )


def _collapse_from(df: DataFrame) -> DataFrame:
    """Collapse columns from the raw cells, keeping the weighted ones untouched."""
    kept = df.select("*", *[F.col(c).alias(f"__w_{c}") for c in RAW]).drop(*RAW)
    renamed = kept.select("*", *[F.col(f"__raw.{c}").alias(c) for c in RAW])
    collapsed = renamed.select("*", *M.collapse_columns()).drop(*RAW, "__raw")
    for c in RAW:
        collapsed = collapsed.withColumnRenamed(f"__w_{c}", c)
    return collapsed


def attach_uncertainty(suites: DataFrame, df: DataFrame, config: AuditConfig) -> DataFrame:
    """Add an ``intervals`` map (metric -> interval) to the suite row of a single run.

    As in the evaluation itself, fewer than two groups give no intervals.
    """
    frame, _, _ = prepare(df, config)
    frame = R.apply_missing_policy(frame, config.missing_policy)
    if config.resampling == "CLUSTER_BOOTSTRAP":
        if not config.cluster:
            raise ValueError("cluster resampling needs a cluster column")
        rows = B.cluster_bootstrap(
            frame, config.cluster, config.replicates, config.seed, min_group_size=config.gates.size,
            min_valid_fraction=config.min_valid_fraction,
        )
    else:
        rows = B.bootstrap(
            frame, config.replicates, config.seed, min_group_size=config.gates.size,
            min_valid_fraction=config.min_valid_fraction,
        )
    entry = F.struct("metric", F.struct("ci_low", "ci_high", "support_status", "valid_fraction").alias("v"))
    packed = rows.agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return suites.withColumn("intervals", F.when(F.col("groups") >= 2, packed.scalar()))
