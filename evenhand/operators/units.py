"""Decision units: profiles, collapse, equal-entity weights, intersections, reweighing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.expr import ratio
from evenhand.operators.cells import confusion_cells
from evenhand.operators.frames import group_label
from evenhand.operators.order import attach
from evenhand.session import stored


class UnitMismatchError(ValueError):
    """Row resampling asked for on repeated entity rows."""


class UnsupportedCollapseError(ValueError):
    """The chosen strategy cannot collapse records."""


# --- profile -----------------------------------------------------------------------------

def entity_profile(df: DataFrame, key: str, cluster: str | None = None) -> DataFrame:
    """Rows per entity, cardinality, null keys and duplicate-key rate in one row.

    Two-level counting: the second aggregation only sees one row per entity.
    """
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    known = F.col(key).isNotNull()
    out = per.agg(
        F.sum("rows").alias("n_records"),
        F.count(F.when(known, 1)).alias("unit_cardinality"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("null_count"),
        F.min(F.when(known, F.col("rows"))).alias("min_rows"),
        F.avg(F.when(known, F.col("rows"))).alias("mean_rows"),
        F.max(F.when(known, F.col("rows"))).alias("max_rows"),
    ).withColumn(
        "duplicate_key_rate",
        ratio(F.col("n_records") - F.col("unit_cardinality"), "n_records"),
    )
    if cluster:
        card = df.select(cluster).na.drop().distinct().agg(F.count(F.lit(1)).alias("n"))
        out = out.withColumn("cluster_cardinality", card.scalar())
    return out


def unit_configuration_errors(
    df: DataFrame,
    key: str | None,
    group: str | None = None,
    cluster: str | None = None,
    timestamp: str | None = None,
) -> list[str]:
    """Schema part of the unit check first, then one profile pass for the key."""
    have, errors = set(df.columns), []
    for role, name in (("unit key", key), ("group key", group), ("cluster key", cluster), ("timestamp key", timestamp)):
        if name and name not in have:
            errors.append(f"{role} '{name}' is not a column of the table")
    if key and key in have:
        row = entity_profile(df, key).first()
        if not row["n_records"]:
            errors.append("the table has no rows")
        elif row["null_count"]:
            errors.append(f"unit key '{key}' has {row['null_count']} null values")
        elif not row["unit_cardinality"]:
            errors.append(f"unit key '{key}' has no values")
    return errors


def guard_row_bootstrap(
    df: DataFrame, key: str, level: str, cluster_resampling: bool = False, override: bool = False
) -> str | None:
    """Refuse row resampling of repeated entities; with ``override`` return the warning."""
    if cluster_resampling or level in ("ROW_LEVEL", "INDIVIDUAL_LEVEL"):
        return None
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    if not repeated:
        return None
    note = f"row bootstrap on {level} with repeated rows per '{key}' ignores dependence inside entities"
    if not override:
        raise UnitMismatchError(
            note + "; collapse the rows, resample clusters, or pass override=True to accept it"
        )
    return note


# --- collapse ----------------------------------------------------------------------------

def _collapse(value: str, strategy: str, order: Column) -> Column:
    v = F.col(value)
    choices = {
        "ANY_FAILURE": F.min(v),
        "ALL_SUCCESS": F.max(v),
        "MAJORITY_VOTE": F.when(F.avg(v) > 0.5, 1).otherwise(0),
        "FIRST_RECORD": F.min_by(v, order),
        "LAST_RECORD": F.max_by(v, order),
    }
    if strategy not in choices:
        raise UnsupportedCollapseError(f"strategy {strategy} cannot collapse records")
    return choices[strategy].cast("int")


def collapse_entities(
    df: DataFrame,
    entity: str = "entity_id",
    order: Sequence[str] = ("row_id",),
    target_strategy: str = "ANY_FAILURE",
    prediction_strategy: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One decision per entity (within each ``by`` run). ``order`` gives the record order inside an entity.

    Group and cluster come from the first record; ``mixed_groups`` tells how many labels the
    entity really carries. All aggregates combine before the shuffle, so one entity may hold
    any share of the rows.
    """
    prediction_strategy = prediction_strategy or target_strategy
    if target_strategy == "NONE" and prediction_strategy == "NONE":
        return df
    key = F.struct(*[F.col(c) for c in order])
    aggs = [
        _collapse("y_true", target_strategy, key).alias("y_true"),
        _collapse("y_pred", prediction_strategy, key).alias("y_pred"),
        F.min_by("grp", key).alias("grp"),
        F.count(F.lit(1)).alias("records"),
        F.when(F.min("grp") == F.max("grp"), 1).otherwise(2).alias("mixed_groups"),
    ]
    if "y_prob" in df.columns:
        aggs.append(F.avg("y_prob").alias("y_prob"))
    if "cluster_id" in df.columns:
        aggs.append(F.min_by("cluster_id", key).alias("cluster_id"))
    return df.groupBy(*by, entity).agg(*aggs)


# --- equal-entity weights ------------------------------------------------------------------

def entity_weighted_cells(df: DataFrame, entity: str = "entity_id", base: str | None = None) -> DataFrame:
    """Confusion cells in which every entity carries the same total weight.

    Rows first fold into (entity, group, y, prediction) cells; the entity size then comes from
    those few cells, so rows are never joined back to their entity count.
    """
    w = F.col(base).cast("double") if base else F.lit(1.0)
    folded = df.groupBy(entity, "grp", "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(w).alias("base")
    )
    size = F.sum("rows").over(Window.partitionBy(entity))
    folded = folded.withColumn("raw", F.col("base") / size)
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1

    def part(cond: Column, c: str) -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0)))

    cells = folded.groupBy("grp").agg(
        F.sum("rows").alias("n"),
        part(y, "rows").alias("pos_n"),
        part(~y, "rows").alias("neg_n"),
        part(p, "rows").alias("sel_n"),
        part(~y & ~p, "raw").alias("tn"),
        part(~y & p, "raw").alias("fp"),
        part(y & ~p, "raw").alias("fn"),
        part(y & p, "raw").alias("tp"),
    )
    scale = cells.agg(
        (F.sum("n") / F.sum(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).alias("s")
    ).scalar()
    return cells.select(
        "grp", "n", "pos_n", "neg_n", "sel_n", *[(F.col(c) * scale).alias(c) for c in ("tn", "fp", "fn", "tp")]
    )


def entity_weights(
    df: DataFrame, entity: str = "entity_id", base: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Row-level weights: (1 / rows of the entity) * base, rescaled to sum to the row count
    (of each ``by`` run)."""
    keys = [*by, entity]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    joined = attach(df, sizes, keys, "inner", counts=sizes.withColumnRenamed("__rows", "__n"))
    w = F.col(base).cast("double") if base else F.lit(1.0)
    joined = joined.withColumn("__raw", w / F.col("__rows"))
    if base:
        scale = joined.groupBy(*by).agg((F.count(F.lit(1)) / F.sum("__raw")).alias("__scale"))
    else:  # the raw weights of an entity add up to one
        scale = sizes.groupBy(*by).agg((F.sum("__rows") / F.count(F.lit(1))).alias("__scale"))
    if by:
        joined = attach(joined, scale, list(by), "inner")
    else:
        joined = joined.withColumn("__scale", scale.scalar())
    return joined.withColumn("entity_weight", F.col("__raw") * F.col("__scale")).drop("__rows", "__raw", "__scale")


# --- intersections -------------------------------------------------------------------------

@dataclass(frozen=True)
class IntersectionSpec:
    attributes: Sequence[str]
    name: str | None = None
    min_group_size: int = 20
    min_group_positives: int = 5
    min_group_negatives: int = 5

    @property
    def label(self) -> str:
        return self.name or " x ".join(self.attributes)


def with_intersection(df: DataFrame, spec: IntersectionSpec, out: str = "grp") -> DataFrame:
    absent = [a for a in spec.attributes if a not in df.columns]
    if absent:
        raise KeyError(f"attributes not in the table: {absent}")
    return df.withColumn(out, group_label(spec.attributes))


def intersection_provenance(df: DataFrame, spec: IntersectionSpec) -> DataFrame:
    """Distinct label with the attribute values it is made of."""
    return (
        df.select(*spec.attributes)
        .distinct()
        .select(
            group_label(spec.attributes).alias("grp"),
            F.create_map(
                *[x for a in spec.attributes for x in (F.lit(a), F.col(a).cast("string"))]
            ).alias("attributes"),
        )
    )


def grouping_set_cells(df: DataFrame, specs: Sequence[IntersectionSpec]) -> DataFrame:
    """Cells of several groupings from one scan.

    The rows fold once to the finest grouping; every spec then rolls those cells up.
    """
    attributes = sorted({a for s in specs for a in s.attributes})
    finest = confusion_cells(df, attributes)
    names = ["n", "pos_n", "neg_n", "sel_n", "tn", "fp", "fn", "tp"]
    tagged = finest.select(
        *names,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s.label).alias("grouping"), group_label(s.attributes).alias("grp"))
                    for s in specs
                ]
            )
        ),
    )
    return tagged.groupBy("grouping", "grp").agg(*[F.sum(c).alias(c) for c in names])


# --- reweighing and priors -------------------------------------------------------------------

def reweighing_table(df: DataFrame) -> DataFrame:
    """Weight per (group, label): p(a) p(y) / p(a, y), floored at 1e-3 and scaled to mean 1."""
    joint = stored(df.groupBy("grp", "y_true").agg(F.count(F.lit(1)).alias("n")))  # read four times, rows only once
    of_group = F.sum("n").over(Window.partitionBy("grp"))
    of_label = F.sum("n").over(Window.partitionBy("y_true"))
    total = joint.agg(F.sum("n").alias("n")).scalar()
    raw = joint.select(
        "grp",
        "y_true",
        "n",
        F.greatest(
            (of_group / total) * (of_label / total) / F.greatest(F.col("n") / total, F.lit(1e-9)), F.lit(1e-3)
        ).alias("raw"),
    )
    mean = raw.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("m")).scalar()
    return raw.select("grp", "y_true", "n", (F.col("raw") / mean).alias("weight"))


def with_reweighing(df: DataFrame, out: str = "weight") -> DataFrame:
    table = reweighing_table(df).select("grp", "y_true", F.col("weight").alias(out))
    return attach(df.drop(out), table, ["grp", "y_true"])


def label_prior(df: DataFrame, category: str, mapping: dict[str, str], levels: Sequence[str]) -> DataFrame:
    """Share of each level after mapping; uniform when nothing maps."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    counts = (
        df.select(lookup[F.col(category)].alias("level"))
        .filter(F.col("level").isin(list(levels)))
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.createDataFrame([(v,) for v in levels], "level string")
    joined = frame.join(F.broadcast(counts), "level", "left")  # at most len(levels) rows
    n = F.coalesce(F.col("n"), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return joined.select(
        "level",
        F.when(total > 0, F.try_divide(n.cast("double"), total.cast("double")))
        .otherwise(1.0 / len(levels))
        .alias("prior"),
    )
