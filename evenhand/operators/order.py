"""Order-dependent work on big tables without a single-task window.

* ``rank_cuts``    exact order statistics by histogram refinement
* ``prefix_sums``  running totals by range bucket + carried offsets
* ``attach``       lookup join: checked broadcast, otherwise a salted join
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.session import stored, stored_bytes

#: A lookup table up to this many rows may be broadcast; ``attach`` checks it.
BROADCAST_ROWS = 20_000
#: A lookup table that was written may be broadcast up to this size of its files (a few times that in memory).
BROADCAST_BYTES = 4 << 20
#: A key holding more than this share of all rows is salted. At most
#: ``1 / HOT_SHARE`` such keys can exist, which bounds the list of them.
HOT_SHARE = 0.002
SALTS = 64


def range_profile(df: DataFrame, value: str, buckets: int) -> tuple[int, list[float]]:
    """Row count and bucket edges of about equal mass, from one pass with a mergeable
    quantile sketch."""
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(F.col(value).cast("double"), probs, F.lit(max(1000, 10 * buckets))).alias("q"),
    ).first()
    return row["n"], sorted({float(q) for q in (row["q"] or [])}) if buckets > 1 else []


def range_bounds(df: DataFrame, value: str, buckets: int) -> list[float]:
    return range_profile(df, value, buckets)[1]


def with_range_bucket(df: DataFrame, value: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Monotone bucket number of ``value``; the edges are constants of the plan, so a
    recomputed task puts every row where it was before."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    inf = float("inf")
    edges = [-inf, *bounds, inf]
    tmp = f"{out}__value"
    binned = Bucketizer(splits=edges, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(tmp, F.col(value).cast("double"))
    )
    return binned.withColumn(out, F.col(out).cast("int")).drop(tmp)


def default_buckets(df: DataFrame) -> int:
    """As many range buckets as the session has shuffle partitions (16 to 4000)."""
    return max(16, min(4000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    counts: DataFrame | None = None,
    many: bool = False,
) -> DataFrame:
    """Join a lookup table to a big one.

    ``small`` is fetched up to ``limit + 1`` rows. If it fits it becomes a local
    relation and the big side is not shuffled. If it does not fit, the join is
    shuffled with hot keys of the big side salted. ``counts`` (keys and ``__n``), where the
    caller has it, saves counting the keys of the big side.

    With ``many`` the lookup table may have a row per value of the big one, and working it out twice would cost as
    much as the join: it is written once, and the size of its files decides (``BROADCAST_BYTES``).
    """
    if many:
        table = stored(small)
        if stored_bytes(table) <= BROADCAST_BYTES:
            return big.join(F.broadcast(table), list(keys), how)
        return salted_join(big, table, keys, how, counts=counts)
    rows = small.take(limit + 1)
    if len(rows) <= limit:
        local = big.sparkSession.createDataFrame(rows, small.schema)
        return big.join(F.broadcast(local), list(keys), how)
    return salted_join(big, small, keys, how, counts=counts)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which a key with more than ``HOT_SHARE`` of the big side is spread
    over ``salts`` tasks and its lookup rows are repeated that often. Rows with a NULL key match
    nothing and are spread in the same way.

    The salt is the number of the input partition, so a recomputed task salts as before.
    """
    keys = list(keys)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__n")).scalar()
    hot = counts.filter(F.col("__n") > total * HOT_SHARE).select(*keys, F.lit(True).alias("__hot"))
    lost = F.lit(False)
    for k in keys:
        lost = lost | F.col(k).isNull()
    spread = big.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt",
        F.when(F.col("__hot") | lost, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)),
    )
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt",
        F.explode(
            F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    joined = spread.drop("__hot").join(repeated.drop("__hot"), keys + ["__salt"], how)
    return joined.drop("__salt")


def with_positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """The rows with their 1-based place in a total order. Each task of the sort numbers its own rows; what stands
    before it is a table of one row per task. Nothing is numbered in one task."""
    at = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part")) - F.col("__n")).alias("__base"))
    place = (F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")
    return at.join(F.broadcast(base), "__part").withColumn(out, place).drop("__part", "__at", "__base")


def prefix_sums(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Running totals of ``sums`` (input column -> output column) in ascending order of
    ``value``, which must be distinct within ``by``. Totals include the current row.

    Each range bucket is summed on its own; bucket offsets are a table of at most
    ``buckets`` rows per ``by`` group.
    """
    buckets = buckets or default_buckets(df)
    bounds = range_bounds(df, value, buckets)
    binned = with_range_bucket(df, value, bounds, "__bucket")
    by = list(by)
    running = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    offsets = totals.select(
        *by,
        "__bucket",
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most `buckets` rows
    out = binned.join(offsets, [*by, "__bucket"])
    for c, name in sums.items():
        out = out.withColumn(name, F.sum(c).over(running) + F.col(f"__o_{c}"))
    return out.drop("__bucket", *[f"__o_{c}" for c in sums])


#: Values that one task may put in order to find a rank. A bucket with more is cut again first.
WINDOW_ROWS = 100_000
#: Parts of a bucket that is cut again.
FINER = 256


def rank_cuts(
    df: DataFrame, cuts: DataFrame, levels: Sequence[str], strata: Sequence[str] = (), small: bool = True, limit: int = WINDOW_ROWS
) -> DataFrame:
    """The row at given 1-based ranks, exactly.

    ``cuts`` holds ``strata..., cut, rank`` and is a handful of rows; with ``small=False`` it may
    be of any size and is joined without a broadcast. ``levels`` are columns
    ordered coarse to fine; together they give the total order, and the first has few values by its
    making. Every level costs one narrow scan that ends in a histogram; after it only the bucket that
    contains a wanted rank stays in scope. Where a bucket may hold more than ``limit`` distinct values
    of the next level, quantiles of these cut it again, as often as it takes; so no task sorts more
    than ``limit`` values, even when one value holds a third of all rows.
    Returns ``strata..., cut, levels...``.
    """
    if not small:
        return _rank_cuts_joined(df, cuts, levels, strata)
    spark, strata = df.sparkSession, list(strata)
    keys = ["__all", *strata]
    one = F.lit(1).alias("__all")
    scope = df.select(one, *strata, *levels)
    wanted = cuts.select(one, *strata, "cut", F.col("rank").cast("bigint").alias("rank"))
    largest = 0  # rows of the largest bucket in scope

    def descend(level: str) -> None:
        """Find the wanted ranks in the histogram of ``level`` and keep only their buckets."""
        nonlocal scope, wanted, largest
        hist = scope.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(level))
        hist = hist.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("__n"))
        inside = (F.col("__lo") < F.col("rank")) & (F.col("rank") <= F.col("__hi"))
        found = hist.join(F.broadcast(wanted), keys).filter(inside).select(
            *keys, level, "cut", (F.col("rank") - F.col("__lo")).alias("rank"), "__n"
        )
        rows = found.collect()  # one per cut
        largest = max((r["__n"] for r in rows), default=0)
        keys.append(level)
        wanted = spark.createDataFrame(rows, found.schema).drop("__n")
        scope = scope.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")

    for i, level in enumerate(levels):
        while i and largest > limit:
            bounds = _finer_bounds(scope, keys, level, limit)
            if bounds is None:
                break
            fine = f"__fine{len(keys)}"
            place = F.size(F.filter("__bounds", lambda b: b <= _number(scope, level)))
            scope = scope.join(F.broadcast(bounds), keys).withColumn(fine, place).drop("__bounds")
            descend(fine)
        descend(level)
    return wanted.select(*strata, "cut", *levels)


def _number(df: DataFrame, level: str) -> Column:
    """A number that never falls as the level rises; of a digest its first 13 digits."""
    if df.schema[level].dataType.simpleString() == "string":
        return F.conv(F.substring(level, 1, 13), 16, 10).cast("double")
    return F.col(level).cast("double")


def _finer_bounds(scope: DataFrame, keys: Sequence[str], level: str, limit: int) -> DataFrame | None:
    """Quantiles of a level's distinct values in each bucket, or None where all buckets are small or cannot be cut."""
    distinct = scope.select(*keys, level).distinct().select(*keys, _number(scope, level).alias("__v"))
    probs = F.array(*[F.lit(i / FINER) for i in range(1, FINER)])
    per = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__k"), F.min("__v").alias("__low"),
        F.array_distinct(F.percentile_approx("__v", probs, F.lit(20 * FINER))).alias("__bounds"),
    )
    rows = per.collect()  # one per bucket with a wanted rank
    if not any(r["__k"] > limit and any(b > r["__low"] for b in r["__bounds"]) for r in rows):
        return None
    return scope.sparkSession.createDataFrame(rows, per.schema).drop("__k", "__low")


def _rank_cuts_joined(df: DataFrame, cuts: DataFrame, levels: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """:func:`rank_cuts` for a table of cuts of any size: nothing is collected, and buckets of many strata are small."""
    strata = list(strata)
    keys = ["__all", *strata]
    one = F.lit(1).alias("__all")
    wanted = cuts.select(one, *strata, "cut", F.col("rank").cast("bigint").alias("rank"))
    scope = df.select(one, *strata, *levels)
    for level in levels:
        hist = scope.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(level))
        hist = hist.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("__n"))
        inside = (F.col("__lo") < F.col("rank")) & (F.col("rank") <= F.col("__hi"))
        wanted = hist.join(wanted, keys).filter(inside).select(
            *keys, level, "cut", (F.col("rank") - F.col("__lo")).alias("rank")
        )
        keys.append(level)
        if level != levels[-1]:
            scope = scope.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return wanted.drop("rank", "__all")


def hash_prefix(digest_col: str | Column, digits: int = 4) -> Column:
    """Leading hex digits of a digest: the coarse level for ``rank_cuts``."""
    return F.substring(digest_col, 1, digits)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Linear-interpolation quantiles of a big column (same rule as ``percentile``), found by
    rank instead of by collecting all distinct values in one task."""
    clean = df.select(F.col(value).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    spark = df.sparkSession
    n, bounds = range_profile(clean, "v", default_buckets(df))
    if n == 0:
        return [None for _ in probs]
    wanted = []
    for i, p in enumerate(probs):
        position = p * (n - 1)
        low = int(position)
        wanted.append((2 * i, low + 1))
        wanted.append((2 * i + 1, min(low + 2, n)))
    cuts = spark.createDataFrame(wanted, "cut int, rank bigint")
    binned = with_range_bucket(clean, "v", bounds, "bucket")
    at = {r["cut"]: r["v"] for r in rank_cuts(binned, cuts, ["bucket", "v"]).collect()}
    out: list[float | None] = []
    for i, p in enumerate(probs):
        position = p * (n - 1)
        weight = position - int(position)
        low, high = at[2 * i], at[2 * i + 1]
        out.append(low + (high - low) * weight)
    return out
