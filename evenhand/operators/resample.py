"""Bootstrap intervals and negative controls on cells.

Every statistic that is collected is a function of confusion cells, so replicates are drawn
from cells:

* ``slots``: one keyed draw per row and replicate. Any engine can replay it; costs B*N.
* ``cells``: multinomial / hypergeometric draws per replicate. Same law, costs B*G.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.draws import decimal_tails, draw_end, draws60, md5_words, multivariate_hypergeometric, text_tails
from evenhand.functions.expr import count_where, digest, draw60, uniform_index
from evenhand.operators.cells import confusion_cells
from evenhand.operators.metrics import Gates, disparity_wide
from evenhand.operators.order import attach, exact_quantiles, hash_prefix, rank_cuts
from evenhand.session import stored

CELL_NAMES = ("tn", "fp", "fn", "tp")
REPLICATE_SCHEMA = "b int, grp string, tn bigint, fp bigint, fn bigint, tp bigint"


def _generator(*key) -> np.random.Generator:
    """A generator that depends on the key only; 128 bits of a digest keep keys apart."""
    seed = hashlib.sha256("|".join(map(str, key)).encode()).digest()[:16]
    return np.random.default_rng(np.random.SeedSequence(int.from_bytes(seed, "big")))


def _complete(cells: DataFrame, by: tuple[str, ...] = ("b", "grp")) -> DataFrame:
    """Add the support counts of unweighted cells."""
    return cells.select(
        *by,
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        (F.col("fn") + F.col("tp")).alias("pos_n"),
        (F.col("tn") + F.col("fp")).alias("neg_n"),
        (F.col("fp") + F.col("tp")).alias("sel_n"),
        *CELL_NAMES,
    )


def _exploded(df: DataFrame, row_id: str, replicates: int) -> DataFrame:
    """Every row once per replicate, of rows from :func:`_spread`."""
    return _spread(df, row_id).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def _spread(df: DataFrame, row_id: str) -> DataFrame:
    """The narrow rows, spread by key: the work grows by the number of replicates, so it must not sit
    where the input files happened to be, nor be coalesced by the size of the input."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.select("y_true", "y_pred", row_id).repartition(tasks, F.col(row_id))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur, and how often."""
    if len(codes) and codes.max() < 4 * len(codes):
        k = np.bincount(codes)
        return np.flatnonzero(k), k[k > 0]
    return np.unique(codes, return_counts=True)


#: Rows of a batch that one step of draws takes at once.
BATCH = 1 << 14
#: A replicate's rows of a task, folded: how often each label and prediction (null: 2) stand at a key.
FOLDED_SCHEMA = "b int, key string, y int, p int, k bigint"


def _folded_draws(df: DataFrame, replicates: int, row_id: str, mark: str, fold: Callable[[np.ndarray], Iterator]) -> DataFrame:
    """``b, key`` with the cells of the rows at each key, from one keyed draw per row and replicate.

    ``mark`` opens the text that is digested. ``fold`` takes the digests of a batch, and gives places of rows (null:
    all) with codes and the keys of the codes.
    """
    rows = _spread(df, row_id).select(
        F.coalesce((F.col("y_true") == 1).cast("int"), F.lit(2)).alias("y"),
        F.coalesce((F.col("y_pred") == 1).cast("int"), F.lit(2)).alias("p"), F.col(row_id).cast("string").alias("id"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = (batch["y"] * 3 + batch["p"]).to_numpy()
            for places, tails in text_tails(batch["id"].tolist(), BATCH):
                here, keyed, numbers = cell[places], [], []
                for b in range(replicates):
                    # a null id is left out of the text, as concat_ws does
                    prefix = f"{mark}|{b}" if batch["id"].iloc[places[0]] is None else f"{mark}|{b}|"
                    words = md5_words(prefix.encode(), tails)
                    for rows_of, codes, keys in fold(words):
                        both, k = _counted(codes * 9 + (here if rows_of is None else here[rows_of]))
                        keyed += [keys[c] for c in (both // 9).tolist()]
                        numbers.append(np.stack([np.full(len(both), b), both % 9 // 3, both % 3, k]))
                found = np.concatenate(numbers, axis=1)
                yield pd.DataFrame({"b": found[0], "key": keyed, "y": found[1], "p": found[2], "k": found[3]})

    found = rows.mapInPandas(run, FOLDED_SCHEMA)
    y, p, k = F.col("y"), F.col("p"), F.col("k")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, k).otherwise(F.lit(0))).cast("bigint")

    return found.groupBy("b", "key").agg(
        F.sum(k).alias("n"), count(y == 1).alias("pos_n"), count(y == 0).alias("neg_n"), count(p == 1).alias("sel_n"),
        count((y == 0) & (p == 0)).alias("tn"), count((y == 0) & (p == 1)).alias("fp"),
        count((y == 1) & (p == 0)).alias("fn"), count((y == 1) & (p == 1)).alias("tp"),
    )


# --- replicates: rows inside groups ------------------------------------------------------------

#: Draws of a row of work; a task takes such rows one after the other.
CHUNK = 1 << 15


def row_replicates_slots(cells: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """n_g keyed draws per group and replicate; a draw picks a slot of the group's cells laid end to end.

    A draw is compared with the ends of the cells. Groups and replicates are cut into chunks of draws, which are
    spread by key before they become draws, and each folds to counts.
    """
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = F.col("n").cast("bigint")
    chunks = cells.filter("n > 0").select("grp", n.alias("n"), *CELL_NAMES, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / CHUNK).cast("bigint"))
    chunks = chunks.select("*", F.explode(parts).alias("part")).repartition(tasks, "b", "grp", "part")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), len(CELL_NAMES)), dtype=np.int64)
            counts = batch[list(CELL_NAMES)].to_numpy(dtype=np.int64)
            for i, (b, g, n, part) in enumerate(zip(batch["b"], batch["grp"], batch["n"], batch["part"])):
                ends = [draw_end(int(x), n) for x in np.cumsum(counts[i])]
                prefix = "|".join(str(x) for x in (seed, b, g) if x is not None) + "|"
                below = np.zeros(len(ends), dtype=np.int64)
                for _, tails in decimal_tails(part * CHUNK, min(n, (part + 1) * CHUNK)):
                    u = draws60(md5_words(prefix.encode(), tails))
                    below += [int((u < np.uint64(e)).sum()) for e in ends]
                out[i] = np.diff(below, prepend=0)
            yield pd.DataFrame({"b": batch["b"], "grp": batch["grp"], **dict(zip(CELL_NAMES, out.T))})

    found = chunks.mapInPandas(draw, REPLICATE_SCHEMA)
    return _complete(found.groupBy("b", "grp").agg(*[F.sum(c).alias(c) for c in CELL_NAMES]))


def row_replicates_cells(cells: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """One multinomial draw per group and replicate: the same law at B*G cost."""
    width = len(CELL_NAMES)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), width), dtype=np.int64)
            counts = batch[list(CELL_NAMES)].to_numpy(dtype=np.int64)
            for i, (b, g) in enumerate(zip(batch["b"], batch["grp"])):
                n = int(counts[i].sum())
                if n:
                    out[i] = _generator(seed, b, g).multinomial(n, counts[i] / n)
            yield pd.DataFrame({"b": batch["b"], "grp": batch["grp"], **dict(zip(CELL_NAMES, out.T))})

    per = cells.select(
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"), "grp", *CELL_NAMES
    )
    return _complete(per.mapInPandas(draw, REPLICATE_SCHEMA))


# --- replicates: whole clusters -------------------------------------------------------------------

def cluster_cells(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Cells per cluster and group: all that a cluster contributes to a replicate."""
    return confusion_cells(df.filter(F.col(cluster).isNotNull()), (cluster, "grp"))


def cluster_replicates_slots(per: DataFrame, replicates: int, cluster: str = "cluster_id", seed: int = 42) -> DataFrame:
    """C keyed draws of a cluster index per replicate. Draws fold to (replicate, cluster)
    multiplicities before they meet the cluster cells."""
    spark = per.sparkSession
    ids = per.select(cluster).distinct()
    n = ids.count()
    # cluster numbers in key order from per-bucket counts, without numbering in one task
    numbered = _dense_index(ids, cluster)
    drawn = (
        spark.range(0, replicates * n)
        .select((F.col("id") / F.lit(n)).cast("int").alias("b"), (F.col("id") % F.lit(n)).alias("slot"))
        .select("b", uniform_index(draw60(F.lit(seed), "b", "slot"), F.lit(n)).alias("idx"))
        .groupBy("b", "idx")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    members = per.join(numbered, cluster)
    joined = drawn.join(members, "idx")
    out = joined.groupBy("b", "grp").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in CELL_NAMES])
    return _complete(out)


def _dense_index(ids: DataFrame, key: str) -> DataFrame:
    """0-based number of distinct keys in digest order."""
    keyed = ids.withColumn("h", digest(key)).withColumn("p", hash_prefix("h", 3))
    sizes = keyed.groupBy("p").agg(F.count(F.lit(1)).alias("k"))  # at most 4096 rows
    before = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("p", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("p").orderBy("h")) - 1
    return keyed.join(F.broadcast(starts), "p").select(key, (F.col("start") + inside).cast("bigint").alias("idx"))


#: Clusters of a bucket: what one task draws from at a time.
BUCKET_CLUSTERS = 50_000


def bucket_paths(sizes: DataFrame, depth: int) -> DataFrame:
    """``bucket, path``: what a bucket needs of the binary tree over all buckets, in ``depth`` steps from the root.

    A node is a prefix of bucket numbers and weighs the clusters below it. A step holds the number of the node, its
    weight, the weight of its left child, and whether the bucket lies to the right.
    """
    steps = sizes.select("bucket", "c", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    steps = steps.withColumn("node", F.expr(f"shiftright(bucket, {depth} - level)"))
    weights = steps.groupBy("level", "node").agg(F.sum("c").alias("weight"))
    known = steps.select("bucket", "level", "node").join(weights, ["level", "node"])
    per = known.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("level", "node", "weight"))).alias("p"))  # depth + 1 entries
    up, down = F.slice("p", 1, depth), F.slice("p", 2, depth)

    def step(x, y):
        right = y["node"] % 2 == 1
        return F.struct(
            x["node"].alias("node"), x["weight"].alias("weight"),
            F.when(right, x["weight"] - y["weight"]).otherwise(y["weight"]).alias("left"), right.alias("right"),
        )

    return per.select("bucket", F.element_at("p", 1)["weight"].alias("total"), F.zip_with(up, down, step).alias("path"))


def bucket_share(path: list, total: int, b: int, seed: int) -> int:
    """How many of ``total`` draws of replicate ``b`` fall into a bucket: a binomial at each node on its path.

    The draw of a node depends on the node, so all buckets below it see the same one and the shares of all buckets
    together are one multinomial draw. The work is the length of the path.
    """
    for level, x in enumerate(path):
        if total == 0 or x["left"] == (0 if x["right"] else x["weight"]):
            continue  # the other child is empty
        left = int(_generator(seed, b, level, x["node"]).binomial(total, x["left"] / x["weight"]))
        total = total - left if x["right"] else left
    return total


def cluster_replicates_cells(
    per: DataFrame, replicates: int, cluster: str = "cluster_id", seed: int = 42, depth: int | None = None
) -> DataFrame:
    """The same law without moving draws.

    Clusters fall into 2^depth hash buckets of about ``BUCKET_CLUSTERS``. The C draws of a replicate go down a binary
    tree of binomial splits (:func:`bucket_paths`), so a bucket finds its share in ``depth`` steps; inside it draws
    are uniform. Only partial cell sums leave a bucket, and nothing but the number of clusters reaches the driver.
    """
    total = per.select(cluster).distinct().count()
    if depth is None:
        depth = max(3, (total // BUCKET_CLUSTERS).bit_length())
    bucket = F.shiftrightunsigned(F.xxhash64(F.col(cluster).cast("string")), 63 - depth).bitwiseAND(F.lit((1 << depth) - 1))
    bucketed = per.withColumn("bucket", bucket.cast("bigint"))
    sizes = bucketed.groupBy("bucket").agg(F.countDistinct(cluster).alias("c"))

    def draw(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        names = ["b", "grp", *CELL_NAMES]
        if not len(pdf):
            return pd.DataFrame([], columns=names)
        number, whole, steps = int(pdf["bucket"].iloc[0]), int(path["total"].iloc[0]), list(path["path"].iloc[0])
        codes, _ = pd.factorize(pdf["key"], sort=True)
        groups, labels = pd.factorize(pdf["grp"], sort=True)
        members = int(codes.max()) + 1
        values = pdf[list(CELL_NAMES)].to_numpy(dtype=np.float64)
        rows = []
        for b in range(replicates):
            share = bucket_share(steps, whole, b, seed)
            picks = _generator(seed, b, "in", number).integers(0, members, size=share)
            times = np.bincount(picks, minlength=members)[codes]
            sums = np.stack([np.bincount(groups, values[:, j] * times, minlength=len(labels)) for j in range(4)], axis=1)
            for g, label in enumerate(labels):
                if sums[g].any():
                    rows.append((b, label, *sums[g].astype(np.int64)))
        return pd.DataFrame(rows, columns=names)

    parts = (
        bucketed.select("bucket", F.col(cluster).cast("string").alias("key"), "grp", *CELL_NAMES)
        .groupBy("bucket")
        .cogroup(bucket_paths(sizes, depth).withColumnRenamed("bucket", "place").groupBy("place"))
        .applyInPandas(draw, REPLICATE_SCHEMA)
    )
    out = parts.groupBy("b", "grp").agg(*[F.sum(c).alias(c) for c in CELL_NAMES])
    return _complete(out)


# --- intervals ---------------------------------------------------------------------------------------

#: Why a replicate can drop out of a metric.
DISCARD_REASONS = [
    V.MISSING_SENSITIVE, V.INSUFFICIENT_GROUP, V.ZERO_POSITIVE, V.ZERO_NEGATIVE, V.UNDEFINED, V.UNSTABLE_RATIO,
    "NAN_VALUE", "UNSTABLE_OR_EXTREME_RATIO", "EMPTY_GROUP_IN_SAMPLE", "ZERO_POSITIVES_IN_SAMPLE",
]


def _group_rows(groups: Column) -> Column:
    """Two metric rows (selection rate, TPR) per group of a ``grp, selection_rate, tpr`` list."""

    def rows(g: Column) -> Column:
        return F.array(
            F.struct(
                F.concat(F.lit("Selection Rate ("), g["grp"], F.lit(")")).alias("metric"),
                g["selection_rate"].alias("value"),
                F.when(g["selection_rate"].isNull(), "EMPTY_GROUP_IN_SAMPLE").alias("reason"),
            ),
            F.struct(
                F.concat(F.lit("TPR ("), g["grp"], F.lit(")")).alias("metric"),
                g["tpr"].alias("value"),
                F.when(g["tpr"].isNull(), "ZERO_POSITIVES_IN_SAMPLE").alias("reason"),
            ),
        )

    return F.flatten(F.transform(groups, rows))


def _group_list() -> dict[str, Column]:
    return {"__groups": F.collect_list(F.struct("grp", "selection_rate", "tpr"))}


def replicate_metrics(replicates: DataFrame) -> DataFrame:
    """``b, metric, value, reason``: value of every collected metric, or why it was dropped.
    One aggregation per replicate feeds all of them."""
    wide = disparity_wide(replicates, Gates(2), by=("b",), keep=_group_list())

    def row(name: str, short: str) -> Column:
        value, status = F.col(f"{short}_value"), F.col(f"{short}_status")
        ok = (status == V.VALID) & value.isNotNull()
        broken = "NAN_VALUE"
        if short == "di":
            ok = ok & (value <= V.DI_RATIO_CEILING)
            broken = "UNSTABLE_OR_EXTREME_RATIO"
        return F.struct(
            F.lit(name).alias("metric"),
            F.when(ok, value).alias("value"),
            F.when(status != V.VALID, status).when(~ok, broken).alias("reason"),
        )

    overall = F.array(row(V.EODDS, "eodds"), row(V.DP, "dp"), row(V.DIR, "di"))
    return wide.select("b", F.inline(F.concat(overall, _group_rows(F.col("__groups")))))


def point_estimates(cells: DataFrame, min_group_size: int = 5) -> DataFrame:
    wide = disparity_wide(cells, Gates(min_group_size), keep=_group_list())
    overall = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"), F.col(f"{s}_value").alias("value"), F.col(f"{s}_status").alias("reason")
            )
            for n, s in ((V.EODDS, "eodds"), (V.DP, "dp"), (V.DIR, "di"))
        ]
    )
    return wide.select(F.inline(F.concat(overall, _group_rows(F.col("__groups"))))).select(
        "metric", F.col("value").alias("point_estimate")
    )


def intervals(
    cells: DataFrame,
    metrics: DataFrame,
    replicates: int,
    level: float = 0.95,
    min_valid_fraction: float = 0.80,
    min_group_size: int = 5,
    clusters: int | None = None,
) -> DataFrame:
    """Percentile intervals with the support gate, one row per metric.

    A group that drew nothing in a replicate has no row there; it counts as discarded.
    """
    tail = (1.0 - level) / 2.0
    agg = metrics.groupBy("metric").agg(
        F.count("value").alias("successful"),
        F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"),
        F.count("reason").alias("flagged"),
        F.map_from_arrays(
            F.array(*[F.lit(r) for r in DISCARD_REASONS]),
            F.array(*[count_where(F.col("reason") == r) for r in DISCARD_REASONS]),
        ).alias("reasons"),
    )
    out = point_estimates(cells, min_group_size).join(agg, "metric", "left")
    ok_n = F.coalesce("successful", F.lit(0)).cast("bigint")
    fraction = ok_n / F.lit(max(replicates, 1))
    few_clusters = F.lit(clusters is not None and clusters < 5)
    thin = few_clusters | (fraction < min_valid_fraction) | (ok_n < 10)
    absent = F.lit(replicates) - ok_n - F.coalesce("flagged", F.lit(0))
    no_row = F.when(F.startswith("metric", F.lit("TPR")), "ZERO_POSITIVES_IN_SAMPLE").otherwise("EMPTY_GROUP_IN_SAMPLE")
    zeros = F.map_from_arrays(
        F.array(*[F.lit(r) for r in DISCARD_REASONS]), F.array(*[F.lit(0).cast("bigint") for _ in DISCARD_REASONS])
    )
    counted = F.transform_values(
        F.coalesce("reasons", zeros), lambda k, v: v + F.when(k == no_row, absent).otherwise(F.lit(0))
    )
    return out.select(
        "metric",
        "point_estimate",
        F.when(~thin, F.col("q")[0]).alias("ci_low"),
        F.when(~thin, F.col("q")[1]).alias("ci_high"),
        F.lit(replicates).alias("requested"),
        ok_n.alias("successful"),
        (F.lit(replicates) - ok_n).alias("discarded"),
        (1.0 - fraction).alias("discard_fraction"),
        fraction.alias("valid_fraction"),
        F.map_filter(counted, lambda _, v: v > 0).alias("discard_reasons"),
        F.when(thin, V.INSUFFICIENT_BOOTSTRAP).otherwise(V.VALID).alias("support_status"),
    )


def bootstrap(
    df: DataFrame,
    replicates: int = 500,
    seed: int = 42,
    method: str = "cells",
    level: float = 0.95,
    min_group_size: int = 5,
    min_valid_fraction: float = 0.80,
) -> DataFrame:
    """Stratified row bootstrap of the group disparities and rates."""
    cells = confusion_cells(df)
    draw = {"cells": row_replicates_cells, "slots": row_replicates_slots}[method]
    metrics = replicate_metrics(draw(cells, replicates, seed))
    return intervals(cells, metrics, replicates, level, min_valid_fraction, min_group_size)


def cluster_bootstrap(
    df: DataFrame,
    cluster: str = "cluster_id",
    replicates: int = 500,
    seed: int = 42,
    method: str = "cells",
    level: float = 0.95,
    min_group_size: int = 5,
    min_valid_fraction: float = 0.80,
) -> DataFrame:
    """Bootstrap of whole clusters; fewer than five clusters give no interval."""
    if cluster not in df.columns:
        raise ValueError("cluster bootstrap needs a cluster column; rows are never resampled instead")
    per = cluster_cells(df, cluster)
    draw = {"cells": cluster_replicates_cells, "slots": cluster_replicates_slots}[method]
    metrics = replicate_metrics(draw(per, replicates, cluster, seed))
    n = per.select(cluster).distinct().count()
    return intervals(confusion_cells(df), metrics, replicates, level, min_valid_fraction, min_group_size, clusters=n)


# --- negative controls -----------------------------------------------------------------------------------

#: Standard errors that the windows around the wanted ranks reach to either side.
REACH = 8


def rank_windows(ranks: list[int], total: int) -> list[tuple[int, int]]:
    """Ranges of draws in which the rows of the given ranks lie, apart from one case in 10^14: digests are uniform, so
    the place of a rank is known up to a few standard errors. Ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for r in sorted(ranks):
        wide = int(REACH * (r * (total - r) / total) ** 0.5) + REACH
        low, high = draw_end(r - wide, total), draw_end(r + wide, total)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def permuted_replicates_slots(df: DataFrame, replicates: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Shuffle labels over rows: in each replicate rows are ordered by digest and labels dealt in group order.

    Only the rows near a rank where the label changes must be ordered. One scan keeps those apart, by windows of
    draws, and folds the rows between two windows to their cells; running totals over both deal the labels. Where a
    rank lies outside its window, or groups are many, cuts found by rank deal them (:func:`_permuted_by_cuts`).
    """
    counts = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    groups = sorted((r["grp"], r["n"]) for r in counts.collect())  # one row per group
    ranks = [int(x) for x in np.cumsum([n for _, n in groups])[:-1]]
    total = sum(n for _, n in groups)
    if not 0 < len(ranks) < 64:
        return _permuted_by_cuts(df, groups, replicates, row_id, seed)
    edges = np.array([e for window in rank_windows(ranks, total) for e in window], dtype=np.uint64)
    between = {i: f"{int(edges[i - 1]):015x}" if i else "" for i in range(0, len(edges) + 1, 2)}  # where the window before ends

    def fold(words: np.ndarray) -> Iterator:
        part = np.searchsorted(edges, draws60(words), side="right")
        inside = part % 2 == 1
        out = np.flatnonzero(~inside)
        yield out, part[out], between
        some = np.flatnonzero(inside)
        yield some, np.arange(len(some)), [x.tobytes().hex() for x in words[:, some].T.astype("<u4")]

    ordered = _folded_draws(df, replicates, row_id, str(seed), fold).withColumn(
        "low", F.sum("n").over(Window.partitionBy("b").orderBy("key")) - F.col("n")
    )
    label, cut = F.lit(0), F.lit(False)
    for r in ranks:
        label = label + (F.col("low") >= r).cast("int")
        cut = cut | ((F.col("low") < r) & (F.col("low") + F.col("n") > r))
    folded = F.length("key") < 32
    dealt = ordered.withColumn("grp", F.array(*[F.lit(g) for g, _ in groups])[label]).withColumn("cut", (folded & cut).cast("int"))
    names = ["n", "pos_n", "neg_n", "sel_n", *CELL_NAMES]
    cells = stored(dealt.groupBy("b", "grp").agg(*[F.sum(c).alias(c) for c in names], F.max("cut").alias("cut")))
    if cells.filter("cut > 0").limit(1).count():
        return _permuted_by_cuts(df, groups, replicates, row_id, seed)
    return cells.drop("cut")


def _permuted_by_cuts(df: DataFrame, groups: list[tuple[str, int]], replicates: int, row_id: str, seed: int) -> DataFrame:
    """The ranks where the label changes as exact cuts; nothing is sorted as a whole."""
    spark = df.sparkSession
    bounds, upto = [], 0
    for i, (_, n) in enumerate(groups[:-1]):
        upto += n
        bounds.append((i, upto))
    rows = _exploded(df, row_id, replicates)
    keyed = rows.select("y_true", "y_pred", "b", digest(F.lit(seed), "b", row_id).alias("h")).withColumn(
        "p", hash_prefix("h", 3)
    )
    wanted = spark.createDataFrame(
        [(b, i, r) for b in range(replicates) for i, r in bounds], "b int, cut int, rank bigint"
    )
    cuts = rank_cuts(keyed, wanted, ["p", "h"], strata=["b"])
    per = cuts.groupBy("b").agg(F.array_sort(F.collect_list("h")).alias("cuts"))  # groups - 1 per replicate
    labels = F.array(*[F.lit(g) for g, _ in groups])
    dealt = attach(keyed, per, ["b"], "left").select(
        "b",
        "y_true",
        "y_pred",
        labels[
            F.size(F.filter(F.coalesce("cuts", F.array().cast("array<string>")), lambda c: c < F.col("h")))
        ].alias("grp"),
    )
    return confusion_cells(dealt, ("b", "grp"))


def permuted_replicates_cells(df: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Labels dealt to cells: a chain of multivariate hypergeometric draws per replicate."""
    per = confusion_cells(df).select("grp", "n", *CELL_NAMES).orderBy("grp").collect()  # one row per group
    total = [sum(r[c] for r in per) for c in CELL_NAMES]
    sizes = [(r["grp"], int(r["n"])) for r in per]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch["b"]:
                rng, left = _generator(seed, "permutation", b), np.array(total, dtype=np.int64)
                for g, n in sizes:
                    got = multivariate_hypergeometric(rng, left, n)
                    left = left - got
                    rows.append((b, g, *got))
            yield pd.DataFrame(rows, columns=["b", "grp", *CELL_NAMES])

    base = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("b"))
    return _complete(base.mapInPandas(draw, REPLICATE_SCHEMA))


def random_group_replicates(df: DataFrame, replicates: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Independent labels from the marginal frequencies: a keyed draw per row falls into the
    cumulative group counts. Map-side work, then one small aggregation."""
    groups = sorted((r["grp"], r["n"]) for r in df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in groups)
    edges, upto = [], 0
    for _, n in groups[:-1]:
        upto += n
        edges.append(draw_end(upto, total))
    ends, labels = np.array(edges, dtype=np.uint64), [g for g, _ in groups]

    def fold(words: np.ndarray) -> Iterator:
        yield None, np.searchsorted(ends, draws60(words), side="right"), labels

    return _folded_draws(df, replicates, row_id, f"{seed}r", fold).withColumnRenamed("key", "grp")


def random_group_replicates_cells(df: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """The same law from cells: every cell splits over the labels by one multinomial."""
    per = confusion_cells(df).select("grp", "n", *CELL_NAMES).orderBy("grp").collect()  # one row per group
    total = [int(sum(r[c] for r in per)) for c in CELL_NAMES]
    labels = [r["grp"] for r in per]
    shares = np.array([r["n"] for r in per], dtype=float) / max(1, sum(total))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch["b"]:
                rng = _generator(seed, "random", b)
                dealt = np.stack([rng.multinomial(n, shares) for n in total], axis=1)
                rows += [(b, g, *dealt[i]) for i, g in enumerate(labels)]
            yield pd.DataFrame(rows, columns=["b", "grp", *CELL_NAMES])

    base = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("b"))
    return _complete(base.mapInPandas(draw, REPLICATE_SCHEMA)).filter("n > 0")


#: The gap that a control looks at: the short name of a disparity, or a function that takes cells and the columns that
#: tell tables apart (none, or the replicate) and gives those columns and ``gap``.
Metric = str | Callable[[DataFrame, tuple[str, ...]], DataFrame]


def gap_of(cells: DataFrame, metric: Metric, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., gap``: an ungated disparity of the wide row, or the caller's own metric."""
    if callable(metric):
        return metric(cells, by).select(*by, F.col("gap").cast("double").alias("gap"))
    return disparity_wide(cells, Gates(1), by=by).select(*by, F.col(f"{metric}_value").alias("gap"))


def control_gap(replicates: DataFrame, metric: Metric = "dp") -> DataFrame:
    """Gap per replicate."""
    return gap_of(replicates, metric, ("b",))


def control_result(name: str, cells: DataFrame, gaps: DataFrame, metric: Metric, coupled: Column | None = None) -> DataFrame:
    """Observed gap against the control distribution, one row."""
    observed = gap_of(cells, metric).scalar()
    agg = gaps.filter(F.col("gap").isNotNull()).agg(
        F.avg("gap").alias("control_mean"),
        F.stddev_pop("gap").alias("control_std"),
        F.avg(F.when(F.col("gap") >= observed, 1.0).otherwise(0.0)).alias("p_value"),
    )
    return agg.select(
        F.lit(name).alias("control_name"),
        observed.alias("observed_gap"),
        "control_mean",
        "control_std",
        "p_value",
        (coupled if coupled is not None else F.coalesce(F.col("p_value") > 0.05, F.lit(False))).alias("explained"),
    )


def permutation_control(
    df: DataFrame, replicates: int = 100, metric: Metric = "dp", seed: int = 42, method: str = "cells", row_id: str = "row_id"
) -> DataFrame:
    drawn = (
        permuted_replicates_cells(df, replicates, seed)
        if method == "cells"
        else permuted_replicates_slots(df, replicates, row_id, seed)
    )
    return control_result("PERMUTED_SENSITIVE_ATTRIBUTE_CONTROL", confusion_cells(df), control_gap(drawn, metric), metric)


def random_group_control(
    df: DataFrame, replicates: int = 100, metric: Metric = "dp", seed: int = 42, method: str = "cells", row_id: str = "row_id"
) -> DataFrame:
    drawn = (
        random_group_replicates_cells(df, replicates, seed)
        if method == "cells"
        else random_group_replicates(df, replicates, row_id, seed)
    )
    return control_result(
        "RANDOM_GROUP_CONTROL", confusion_cells(df), control_gap(drawn, metric), metric, coupled=F.lit(False)
    )


def feature_group_control(df: DataFrame, feature: str, metric: Metric = "dp") -> DataFrame:
    """Gap between the halves of a feature, split at its exact median."""
    (median,) = exact_quantiles(df, feature, [0.5])
    halves = df.withColumn("grp", F.when(F.col(feature) > median, "High_Feature").otherwise("Low_Feature"))
    gap = gap_of(confusion_cells(halves), metric)
    observed = gap_of(confusion_cells(df), metric).scalar()
    return gap.select(
        F.lit("FEATURE_DERIVED_GROUP_CONTROL").alias("control_name"),
        observed.alias("observed_gap"),
        F.col("gap").alias("control_mean"),
        F.lit(0.0).alias("control_std"),
        F.lit(None).cast("double").alias("p_value"),
        F.lit(True).alias("explained"),
    )
