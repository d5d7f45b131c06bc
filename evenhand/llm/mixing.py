"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / weight, with u from a digest of its id. Within a source documents
are taken in the order of the keys. A source whose target is t takes floor(t / size) whole epochs first; what is left
is a budget for one more partial epoch, which goes to the documents whose prefix of sizes stays within it.

The prefix sums need no sort of a source: keys fall into 256 x 256 ordered buckets of about equal mass. Sizes per
bucket (folded map-side) show in which bucket the budget runs out; only that bucket is cut again, and only the
documents of the last one, a 65,536th of the source, are ordered in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
DIGITS = 256

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the id."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``position`` of each source by code point, null last, without bringing the sources into one task."""
    at = scratch.table(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    base = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    tagged = at.withColumn("part", part).join(base, "part")
    return tagged.withColumn("position", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "base", "at")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``target`` of each source: its share of all sizes by weight, stopped at ``cap`` times its size.

    Sources above the cap stop there and the rest is shared by weight again, until none is above. Each round is one
    sum over the source table: the level (words per unit of weight) only rises, so a source once capped stays so.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    s = scratch.table(sources.withColumn("w", w))
    limit, level = F.col("source_size") * cap, None
    total = s.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("w") > limit
        row = s.agg(F.sum(F.when(above, limit).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("w")).first()
        new = (total - (row["held"] or 0)) / row["w"] if row["w"] else 0.0
        if new == level:
            break
        level = new
    share = F.lit(level) * F.col("w")
    return s.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share)).drop("w")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    quality: DataFrame | None = None, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 10, carry: bool = False,
) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, copies, taken``.

    With ``carry`` the document's own columns follow as a struct ``row``. ``size`` is a column of whole numbers (default: words of ``text``); ``quality`` may give ``id, weight``, positive
    weights of documents (others, and null, weigh 1). ``copies`` is how often the mix takes the document, at most
    ``cap``; ``taken = copies * size``. The document at which a budget runs out is taken if its middle lies within, so
    a source misses its target by at most half that document. Null sources are one source, last in order. Repeated
    rows of one id and size are interchangeable; ties of keys go by id, then size. Empty texts take nothing. An empty
    table gives no rows. The same input gives the same mix on any partitioning.
    """
    scratch = Scratch(docs.sparkSession)
    durable = scratch.table
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), (word_count("text") if size is None else size).alias("size"), *whole)
    if quality is None:
        base = base.withColumn("weight", F.lit(1.0))
    else:
        fit = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
        base = base.join(quality.groupBy("id").agg(F.max("weight").alias("weight")), "id", "left")
        base = base.withColumn("weight", F.when(fit, F.col("weight")).otherwise(1.0))
    base = base.withColumn("key", -F.log(uniform("id", seed)) / F.col("weight"))
    slot = F.least(F.floor((1 - F.exp(-F.col("key"))) * (DIGITS * DIGITS)), F.lit(DIGITS * DIGITS - 1)).cast("int")
    every = base.select("id", "source", "size", "key", slot.alias("slot"), *(["row"] if carry else []))
    base = durable(every.drop("row"))

    by = targets(numbered(base.groupBy("source").agg(F.sum("size").alias("source_size")), scratch), scratch, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    by = by.withColumn("epochs", epochs)
    by = durable(by.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).drop("position"))

    def match(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        same = right.withColumnRenamed("source", "source_r")
        return left.join(same, left["source"].eqNullSafe(same["source_r"]), how).drop("source_r")

    def last_bucket(rows: DataFrame, bucket: Column, known: DataFrame) -> DataFrame:
        """The first bucket of each source at whose end the budget is used up, and the sizes before it."""
        sums = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(W.partitionBy("source").orderBy("b"))
        ends = match(sums.withColumn("end", run), known).filter(F.col("before") + F.col("end") >= F.col("budget"))
        first = ends.groupBy("source").agg(F.min(F.struct("b", (F.col("before") + F.col("end") - F.col("n")).alias("before"))).alias("x"))
        return first.select("source", "x.b", "x.before")

    high, low = F.shiftright("slot", 8), F.col("slot").bitwiseAND(DIGITS - 1)
    need = by.filter("budget > 0").select("source", "budget", F.lit(0).cast("bigint").alias("before"))
    one = durable(last_bucket(base, high, need))
    inside = match(base, one.select("source", F.col("b").alias("b1"))).filter(high == F.col("b1")).drop("b1")
    inside = durable(inside)
    two = durable(last_bucket(inside, low, match(one.select("source", "before"), by.select("source", "budget"))))
    rest = match(inside, two.select("source", F.col("b").alias("b2"), "before")).filter(low == F.col("b2"))
    order = W.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = match(rest.withColumn("end", F.col("before") + F.sum("size").over(order)), by.select("source", "budget"))
    fits = F.count(F.when(F.col("end") - F.col("size") / 2 <= F.col("budget"), 1))
    more = rest.groupBy("source", "key", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "size").agg(fits.alias("fit"), F.count(F.lit(1)).alias("rows"))
    more = more.filter("fit > 0").groupBy("source").agg(F.max(F.struct("key", "id", "size", "fit", "rows")).alias("last"))
    more = more.select("source", F.struct("last.key", "last.id", "last.size").alias("edge"), "last.fit", "last.rows")

    cut = match(match(by, one.select("source", F.col("b").alias("b1")), "left"), two.select("source", F.col("b").alias("b2")), "left")
    cut = durable(match(cut, more, "left"))
    scratch.drop([base, cut])
    at = match(every if carry else base, cut)
    point = F.struct("key", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "size")
    stop = F.col("b1") * DIGITS + F.coalesce("b2", F.lit(DIGITS))
    extra = F.when(F.col("budget") <= 0, False).when(F.col("b1").isNull(), True).when(F.col("slot") < stop, True)
    extra = extra.when(F.col("slot") > stop, False).otherwise(F.coalesce(point <= F.col("edge"), F.lit(False)))
    if cut.filter("fit < rows").limit(1).count():  # a budget ends between repeated rows: only the first of them fit
        split = F.coalesce((F.col("slot") == stop) & (point == F.col("edge")) & (F.col("fit") < F.col("rows")), F.lit(False))
        nth = F.row_number().over(W.partitionBy("source").orderBy(F.to_json("row") if carry else "size"))
        some = at.filter(split).withColumn("extra", nth <= F.col("fit"))
        out = at.filter(~split).withColumn("extra", extra).unionByName(some)
    else:
        out = at.withColumn("extra", extra)
    out = out.withColumn("copies", F.col("epochs") + F.col("extra").cast("bigint"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("id", "source", "size", "source_size", "target", "copies", taken, *(["row"] if carry else []))


def label_weights(labels: DataFrame) -> DataFrame:
    """Weights from quality labels: 0.5 for poor documents up to 2 for good ones; a document's labels are averaged."""
    return labels.groupBy(F.col("doc_id").alias("id")).agg((F.lit(0.5) + F.lit(1.5) * F.avg("quality")).alias("weight"))
