"""Evaluation: retrieval metrics, classification metrics, agreement, repeat statistics, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(results: DataFrame, k: int) -> DataFrame:
    """(qid, precision, hit, reciprocal_rank, ndcg) of ranked results with a boolean `relevant` and the question's
    `n_expected`. Precision divides by k; the ideal gain counts min(n_expected, k) results."""
    hit = F.col("relevant").cast("int")
    # at most k rows a question
    gain = F.sum(F.when(F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.max("n_expected"), F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    return results.where(F.col("rank") <= k).groupBy("qid").agg(
        F.round(F.sum(hit) / k, 6).alias("precision"),
        F.max(hit).cast("long").alias("hit"),
        F.round(F.coalesce(F.max(F.when(F.col("relevant"), 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.max("n_expected") > 0, gain / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def first_gains(results: DataFrame, source: str) -> DataFrame:
    """Adds gain: 1 for a relevant result whose source no better-ranked relevant one of the question has, else 0."""
    order = Window.partitionBy("qid", "relevant", source).orderBy("rank")
    return results.withColumn("gain", F.when(F.col("relevant") & (F.row_number().over(order) == 1), 1).otherwise(0).cast("long"))


def confusion(rows: DataFrame, truth: Column, guess: Column, by: list[str]) -> DataFrame:
    """(by, n, tp, fp, fn, precision, recall, f1); ratios without cases are 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6)})


def agreement(rows: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """(by, n, agree, rate): how often two judges give the same verdict."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a.eqNullSafe(b)).alias("agree")).withColumn("rate", F.round(F.col("agree") / F.col("n"), 6))


#: Ranges of values that ranks are looked up in, in so many groups.
RANGES, GROUPS = 256, 16


def nearest_rank(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column a share): the value at index round((n - 1) * share), half to even, of the sorted values.

    Equal values are counted first. A sketch of each group gives the bounds of RANGES ranges; counts of the ranges tell
    which hold a wanted rank, and only their values are sorted, range by range. The bounds needn't be exact. One plan, and
    nothing runs before it does.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).alias("value"))
    step = RANGES // GROUPS
    sketch = known.groupBy(F.col("by").alias("_by")).agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)]).alias("bounds"))
    sketch = sketch.withColumn("coarse", F.transform(F.sequence(F.lit(1), F.lit(GROUPS - 1)), lambda k: F.element_at("bounds", k * step)))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("value")))
    counts = known.groupBy("by", "value").agg(F.count("*").alias("c")).join(sketch, F.col("by").eqNullSafe(F.col("_by"))).withColumn("_group", below("coarse"))
    counts = counts.withColumn("range", F.col("_group") * step + below(F.slice("bounds", F.col("_group") * step + 1, step))).select("by", "value", "c", "range")
    every = Window.partitionBy("by")
    upto = every.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    pieces = counts.groupBy("by", "range").agg(F.sum("c").alias("m")).withColumns({"end": F.sum("m").over(upto), "n": F.sum("m").over(every)})
    wanted = F.array(*(F.bround((F.col("n") - 1) * s).cast("long") for s in shares.values()))
    pieces = pieces.withColumn("wanted", wanted).where(F.exists("wanted", lambda i: (i >= F.col("end") - F.col("m")) & (i < F.col("end"))))
    inside = Window.partitionBy("by", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(pieces.withColumnsRenamed({"by": "_by", "range": "_range"}), F.col("by").eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_range")))
    found = found.withColumn("stop", F.col("end") - F.col("m") + F.sum("c").over(inside))
    at = lambda k: (F.col("wanted")[k] >= F.col("stop") - F.col("c")) & (F.col("wanted")[k] < F.col("stop"))
    return found.groupBy(F.col("by").alias(by)).agg(F.max("n").alias("n"), *(F.max(F.when(at(k), F.col("value"))).alias(name) for k, name in enumerate(shares)))
