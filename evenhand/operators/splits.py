"""Leak-free splits keyed by digests: one label column, no data movement.

The rows of a split are those whose digest is not above an exact rank cut. Finding the cut
needs two or three narrow histograms; labelling is a comparison in a map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.expr import digest
from evenhand.operators.order import (
    BROADCAST_ROWS, attach, default_buckets, hash_prefix, range_profile, rank_cuts, with_range_bucket,
)


class GroupLeakageError(ValueError):
    """A group lies in more than one split."""


class TemporalLeakageError(ValueError):
    """A later split begins before an earlier one ends."""


class HoldoutContractError(ValueError):
    """Held-out rows reached a fitting or tuning step."""


def _half_even(x: float) -> int:
    return int(round(x))


def split_sizes(n: int, train: float, val: float, test: float, at_least_one: bool) -> tuple[int, int]:
    total = train + val + test if at_least_one else 1.0
    floor = 1 if at_least_one else 0
    n_train = max(floor, _half_even(n * (train / total)))
    n_val = max(floor, _half_even(n * (val / total)))
    if at_least_one and n_train + n_val >= n:
        n_val = max(1, n - n_train - 1)
    return n_train, n_val


def _label(position: Column, first: Column, second: Column) -> Column:
    return F.when(position <= first, "train").when(position <= second, "val").otherwise("test")


def _two_cuts(df: DataFrame, n_train: int, n_val: int, levels: Sequence[str]) -> list:
    """The rows at ranks n_train and n_train + n_val, as plan constants."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(1, n_train), (2, n_train + n_val)], "cut int, rank bigint")
    rows = {r["cut"]: r for r in rank_cuts(df, wanted, levels).collect()}
    return [rows.get(1), rows.get(2)]


def group_split(
    df: DataFrame, group: str, seed: int = 42, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)
) -> DataFrame:
    """Groups in digest order; whole groups go to train, val or test."""
    keyed = df.select(group).distinct().select(digest(F.lit(seed), group).alias("h"))
    # one digest per group is read three times below; it spills to disk if need be
    keyed = keyed.withColumn("p", hash_prefix("h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = keyed.count()
        if n < 3:
            raise ValueError(f"a three-way group split needs three groups, found {n}")
        n_train, n_val = split_sizes(n, *ratios, at_least_one=True)
        first, second = _two_cuts(keyed, n_train, n_val, ["p", "h"])
    finally:
        keyed.unpersist()
    h = digest(F.lit(seed), group)
    return df.withColumn("split", _label(h, F.lit(first["h"]), F.lit(second["h"])))


def temporal_split(
    df: DataFrame, ts: str, row_id: str, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)
) -> DataFrame:
    """First 60 % by time, next 20 %, rest. Equal times are ordered by the digest of the row
    key, so a time stamp shared by a third of all rows can still be cut exactly."""
    keyed = df.select(
        F.col(ts).alias("t"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), digest(row_id).alias("h")
    ).withColumn("p", hash_prefix("h"))
    n, bounds = range_profile(keyed, "us", default_buckets(df))
    n_train, n_val = split_sizes(n, *ratios, at_least_one=False)
    binned = with_range_bucket(keyed, "us", bounds, "b")
    first, second = _two_cuts(binned, n_train, n_val, ["b", "us", "p", "h"])
    if first is None or second is None:
        raise ValueError("not enough rows for three splits")
    us, h = F.unix_micros(F.col(ts).cast("timestamp")), digest(row_id)

    def upto(cut) -> Column:
        return (us < cut["us"]) | ((us == cut["us"]) & (h <= cut["h"]))

    return df.withColumn("split", F.when(upto(first), "train").when(upto(second), "val").otherwise("test"))


def verify_temporal_order(df: DataFrame, ts: str, split: str = "split") -> None:
    """Raise unless max(train) <= min(val) and max(val) <= min(test)."""
    r = df.groupBy(split).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).collect()
    at = {x[split]: x for x in r}
    for a, b in (("train", "val"), ("val", "test")):
        if a in at and b in at and at[a]["hi"] > at[b]["lo"]:
            raise TemporalLeakageError(f"{a} reaches past the start of {b}")


def verify_isolation(df: DataFrame, group: str, split: str = "split") -> None:
    """Raise when a group is in two splits."""
    crossing = (
        df.groupBy(group)
        .agg(F.min(split).alias("a"), F.max(split).alias("b"))
        .filter("a <> b")
        .limit(1)
        .collect()
    )
    if crossing:
        raise GroupLeakageError(f"group {crossing[0][group]!r} lies in two splits")


def _strata_cuts(
    df: DataFrame, label: str, h: Column, cuts_of: Column, seed_levels: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Digest cuts per stratum; ``cuts_of`` is an array of ranks as a function of ``n``."""
    keyed = df.select(F.col(label).alias("label"), h.alias("h")).withColumn("p", hash_prefix("h", seed_levels))
    counts = keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.take(BROADCAST_ROWS + 1)
    small = len(rows) <= BROADCAST_ROWS
    if small:
        counts = df.sparkSession.createDataFrame(rows, counts.schema)
    wanted = counts.select("label", F.posexplode(cuts_of).alias("cut", "rank"))
    found = rank_cuts(keyed, wanted, ["p", "h"], strata=["label"], small=small)
    table = found.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("cut", "h"))).alias("__cuts")  # a few cuts per label
    )
    return table.withColumnRenamed("label", label), counts.withColumnRenamed("label", label)


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    seed: int = 42,
    ratios: tuple[float, float, float] = (0.6, 0.2, 0.2),
) -> DataFrame:
    """60/20/20 within every label, in digest order of the row key."""
    h = digest(F.lit(seed), row_id)
    n = F.col("n")
    n_train = F.bround(n * ratios[0]).cast("bigint")
    n_val = F.bround(n * ratios[1]).cast("bigint")
    cuts, _ = _strata_cuts(df, label, h, F.array(n_train, n_train + n_val))
    joined = attach(df, cuts, [label])
    return joined.withColumn("split", _label(h, F.col("__cuts")[0], F.col("__cuts")[1])).drop("__cuts")


def holdout_80_20(df: DataFrame, label: str, row_id: str, seed: int = 42, share: float = 0.8) -> DataFrame:
    """Two-way stratified split."""
    h = digest(F.lit(seed), row_id)
    cuts, _ = _strata_cuts(df, label, h, F.array(F.bround(F.col("n") * share).cast("bigint")))
    joined = attach(df, cuts, [label])
    return joined.withColumn("split", F.when(h <= F.col("__cuts")[0], "train").otherwise("test")).drop("__cuts")


def can_stratify(df: DataFrame, label: str) -> bool:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("m")).first()
    return counts["k"] >= 2 and counts["m"] >= 2


def stratified_sample(df: DataFrame, label: str, row_id: str, cap: int, seed: int = 42) -> DataFrame:
    """Exactly ``cap`` rows with the label shares of the table (largest remainders get the
    odd rows). A table not above the cap is returned whole."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    total = sum(r["n"] for r in counts)
    if total <= cap:
        return df
    exact = {r[label]: cap * r["n"] / total for r in counts}
    take = {k: int(v) for k, v in exact.items()}
    order = sorted(exact, key=lambda k: (take[k] - exact[k], str(k)))
    for k in order[: cap - sum(take.values())]:
        take[k] += 1
    lookup = F.create_map(*[x for k, v in take.items() for x in (F.lit(k), F.lit(v))])
    h = digest(F.lit(seed), row_id)
    cuts, _ = _strata_cuts(df, label, h, F.array(F.element_at(lookup, F.col("label")).cast("bigint")))
    return attach(df, cuts, [label], "inner").filter(h <= F.col("__cuts")[0]).drop("__cuts")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 2, seed: int = 42) -> DataFrame:
    """Fold number 0 .. k-1; every fold has its share of every label (differing by one row
    at most)."""
    h = digest(F.lit(seed), row_id)
    n = F.col("n")
    ranks = F.array(*[F.ceil(n * i / k).cast("bigint") for i in range(1, k)])
    cuts, _ = _strata_cuts(df, label, h, ranks)
    joined = attach(df, cuts, [label])
    reached = F.coalesce(F.map_values("__cuts"), F.array().cast("array<string>"))
    passed = F.size(F.filter(reached, lambda c: c < h))
    return joined.withColumn("fold", passed).drop("__cuts")


def split_summary(df: DataFrame, split: str = "split", group: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    if group:
        aggs.append(F.countDistinct(group).alias("groups"))
    return df.groupBy(split).agg(*aggs)


def require_no_holdout(df: DataFrame, split: str = "split", holdout: str = "test") -> DataFrame:
    """Guard for anything that fits or tunes: its input may not hold test rows."""
    if not df.filter(F.col(split) == holdout).isEmpty():
        raise HoldoutContractError(f"rows of split '{holdout}' must not be used for fitting or tuning")
    return df
