"""Benchmark runs: split, fit on train, tune on val, evaluate test rows once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand import __version__
from evenhand.operators import metrics as M
from evenhand.operators import models as L
from evenhand.operators import splits as S
from evenhand.operators.cells import confusion_cells, merge_cells
from evenhand.operators.thresholds import apply_mixing, equalized_odds_rule
from evenhand.plans import policy as P
from evenhand.plans.evaluate import AuditConfig, attach_uncertainty, evaluate
from evenhand.session import path_exists, shared_dir, stored


class LeakageRefusal(RuntimeError):
    """The ingest manifest shows critical leakage."""


def split_by_regime(df: DataFrame, regime: str, seed: int) -> DataFrame:
    """IID_HOLDOUT, GROUP_HOLDOUT (needs ``holdout_key``) or TEMPORAL_HOLDOUT (needs ``ts``)."""
    if regime == "GROUP_HOLDOUT" and "holdout_key" in df.columns:
        return S.group_split(df, "holdout_key", seed)
    if regime == "TEMPORAL_HOLDOUT" and "ts" in df.columns:
        out = S.temporal_split(df, "ts", "row_id")
        S.verify_temporal_order(out, "ts")
        return out
    return S.stratified_split(df, "y_true", "row_id", seed)


class RunStore:
    """Tables of benchmark runs in the shared folder, under a fingerprint of the input and the settings.

    A table is written once and read ever after: by the other fits of a run, by later queries, and by a suite that
    is started again after a failure. One that was not written to its end is written anew.
    """

    def __init__(self, df: DataFrame, *settings):
        self.spark = df.sparkSession
        names = sorted(df.columns)
        h = F.xxhash64(*[F.col(f"`{c}`") for c in names])
        mark = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
        key = hashlib.sha256(repr((__version__, names, tuple(mark), settings)).encode()).hexdigest()[:24]
        self.root = f"{shared_dir(self.spark).rstrip('/')}/evenhand/benchmark-{key}"

    def table(self, name: str, make) -> DataFrame:
        """The table of this name; ``make`` gives its rows where it is not there yet."""
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


#: What decides over the rows of a run's splits; a temporal split is the same for every seed.
def split_key(df: DataFrame, regime: str, seed: int) -> str:
    return regime if regime == "TEMPORAL_HOLDOUT" and "ts" in df.columns else f"{regime}-{seed}"


#: Training rows of a task. Fits run many short jobs, and on few rows more tasks only make these longer.
FIT_ROWS = 200_000

BOOSTED, LINEAR, MIXED, MAJORITY = "B4_Proposed_Tuned_XGB", "B1_Clean_Unmitigated_Linear", "B3_Validation_Threshold_Mitigated", "B0_Majority_Class_Baseline"


def prepared(df: DataFrame, features: Sequence[str], regime: str, seed: int, store: RunStore) -> DataFrame:
    """``row_id, y_true, grp, split, features`` of one split, encoded on its training rows."""

    def make() -> DataFrame:
        split = split_by_regime(df, regime, seed)
        prep = L.fit_preprocessor(split.filter(F.col("split") == "train"), L.Features.of(df, features))
        ready = prep.transform(split).select("row_id", "y_true", "grp", "split", "features")
        tasks = -(-df.count() // FIT_ROWS)
        return ready.repartition(min(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "row_id")

    return store.table(f"prepared/{split_key(df, regime, seed)}", make)


def scores_of(name: str, ready: DataFrame, at: str, seed: int, rounds: int, store: RunStore) -> DataFrame:
    """Scores of one baseline on the rows it was not fitted on, with ``at`` for what they depend on.

    B3 is the mixing rule on the stored scores of B1, so B1 is fitted once.
    """

    def make() -> DataFrame:
        if name == MIXED:
            linear = scores_of(LINEAR, ready, at, seed, rounds, store)
            rule = equalized_odds_rule(linear.filter(F.col("split") == "val"))
            rows = apply_mixing(linear.drop("baseline_id", "at"), rule)
        else:
            model = L.fit_baselines(ready.filter(F.col("split") != "test"), rounds, seed, [name])[name]
            rows = model.score(ready.filter(F.col("split") != "train"))
        return rows.select(F.lit(at).alias("at"), F.lit(name).alias("baseline_id"), "row_id", "y_true", "grp", "split", "y_prob", "y_pred")

    return store.table(f"scores/{at}-{name}", make)


def judged(scored: DataFrame, policy: P.Policy | None, gates: M.Gates) -> DataFrame:
    """Decided suite rows of all runs in ``scored`` (by ``regime, seed, baseline_id``), from one scan."""
    keys = ["regime", "seed"]
    suites = stored(evaluate(scored.filter(F.col("split") == "test").drop("split"), AuditConfig(by=(*keys, "baseline_id"), gates=gates)))
    cells = merge_cells(confusion_cells(scored.filter((F.col("split") == "val") & (F.col("baseline_id") == MAJORITY)), (*keys, "grp")), tuple(keys))
    majority = cells.select(*keys, *M.performance_columns()).select(*keys, F.col("balanced_accuracy").alias("majority_balanced_accuracy"))
    b1 = suites.filter(F.col("baseline_id") == LINEAR).select(*keys, F.col("accuracy").alias("__b1"))
    suites = suites.join(majority, keys, "left").join(b1, keys, "left")
    suites = suites.withColumn("accuracy_tradeoff", M.accuracy_tradeoff(F.col("__b1"), F.col("accuracy"))).drop("__b1")
    return P.decide(suites, [policy or P.Policy()])


def run_suite(
    df: DataFrame,
    features: Sequence[str],
    seeds: Sequence[int] = (42, 43, 44, 45, 46),
    regimes: Sequence[str] = ("IID_HOLDOUT",),
    manifest: DataFrame | None = None,
    policy: P.Policy | None = None,
    rounds: int = 120,
    which: Sequence[str] = tuple(L.BASELINES),
    dataset: str = "Dataset",
    gates: M.Gates = M.Gates(),
    side_by_side: int = 12,
) -> DataFrame:
    """Result rows of every regime, seed and baseline, from a :class:`RunStore`.

    Splits with their features, and the scores of each fit, are written once: fits are iterative and read their rows
    many times, and a lost executor costs a re-read. A temporal split is the same for every seed, and so are all fits on
    it but the boosted ones. Fits wait for many short jobs, so those that do not need each other go side by side. One
    scan of all scores gives the result rows. What an earlier suite on the same table has finished is read.
    """
    if manifest is not None and manifest.filter("has_critical_leakage").limit(1).count():
        raise LeakageRefusal("the table failed the leakage screen; no benchmark was run")
    spark: SparkSession = df.sparkSession
    store = RunStore(df, tuple(features))
    rows = store.table("input", lambda: df)
    runs = [(regime, seed) for regime in regimes for seed in seeds]
    splits = {split_key(df, *run): run for run in runs}
    fits: dict[str, tuple[str, list[tuple[str, str, int]]]] = {}  # what follows each other: the line of a split, and each boosted fit
    table = []
    for regime, seed in runs:
        key = split_key(df, regime, seed)
        boosted = f"{key}-{seed}-{rounds}"
        table += [(boosted if name == BOOSTED else key, name, regime, seed) for name in which]
        fits[key] = (key, [(name, key, seed) for name in which if name != BOOSTED])
        if BOOSTED in which:
            fits[boosted] = (key, [(BOOSTED, boosted, seed)])

    def fit(key: str, line: list[tuple[str, str, int]]) -> None:
        ready = prepared(rows, features, *splits[key], store)
        for name, at, seed in line:
            scores_of(name, ready, at, seed, rounds, store)

    def judge() -> DataFrame:
        with ThreadPoolExecutor(side_by_side) as pool:
            todo = [[(prepared, (rows, features, *run, store)) for run in splits.values()], [(fit, x) for x in reversed(fits.values())]]
            for phase in todo:
                for done in [pool.submit(inheritable_thread_target(spark)(f), *args) for f, args in phase]:
                    done.result()
        of_run = spark.createDataFrame(table, "at string, baseline_id string, regime string, seed int")
        scored = spark.read.parquet(*sorted({f"{store.root}/scores/{at}-{name}" for at, name, _, _ in table}))
        decided = judged(scored.join(F.broadcast(of_run), ["at", "baseline_id"]).drop("at"), policy, gates)  # a row per run and baseline
        return decided.select(F.lit(dataset).alias("dataset"), "regime", "seed", *[c for c in decided.columns if c not in ("regime", "seed")])

    settings = hashlib.sha256(repr((runs, policy, rounds, tuple(which), dataset, gates)).encode()).hexdigest()[:16]
    return store.table(f"results/{settings}", judge)


def run_once(df: DataFrame, features: Sequence[str], regime: str = "IID_HOLDOUT", seed: int = 42, **kwargs) -> DataFrame:
    """The suite of one split."""
    return run_suite(df, features, [seed], [regime], **kwargs)


def black_box_audit(
    df: DataFrame,
    features: Sequence[str] | None = None,
    model=None,
    regime: str = "IID_HOLDOUT",
    seed: int = 42,
    policy: P.Policy | None = None,
    config: AuditConfig = AuditConfig(),
    estimand_status: str | Column | None = None,
) -> DataFrame:
    """Audit a given model on held-out rows, or the decisions already in the table.

    An unfitted estimator is fitted on train. The result has passed the confirmatory gate.
    """
    split = split_by_regime(df, regime, seed)
    test = split.filter(F.col("split") == "test")
    if model is not None:
        prep = L.fit_preprocessor(split.filter(F.col("split") == "train"), L.Features.of(df, features or []))
        if hasattr(model, "fit"):
            train = S.require_no_holdout(split.filter(F.col("split") == "train"))
            model = model.fit(prep.transform(train))
        drop = [c for c in ("y_prob", "y_pred") if c in test.columns]
        test = L.score(model, prep.transform(test.drop(*drop)))
    suites = evaluate(test, config)
    if config.uncertainty:
        suites = attach_uncertainty(suites, test, config)
    decided = P.decide(suites, [policy or P.Policy("External_Audit_Standard_Policy")])
    status = F.lit(estimand_status) if not isinstance(estimand_status, Column) else estimand_status
    gated = P.decision_gate(decided, estimand_status=status.cast("string"))
    return P.review_codes(P.taxonomy(gated, gate_passed=F.col("gate_passed")))
