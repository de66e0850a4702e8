"""Linear-time windows over series: prefix sums, rolling statistics, sliding dots, count windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions.exprs import clamp_std


def by():
    return Window.partitionBy("series_id")


def ordered():
    return by().orderBy("t")


def so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def ahead(w: int):
    return ordered().rowsBetween(0, w - 1)


def squared_step() -> Column:
    d = F.col("value") - F.lag("value").over(ordered())
    return F.coalesce(d * d, F.lit(0.0))


def prefix_sums(series: DataFrame) -> DataFrame:
    stepped = series.withColumn("step", squared_step())
    return stepped.select("series_id", "t", F.sum("value").over(so_far()).alias("csum"), F.sum(F.col("value") * F.col("value")).over(so_far()).alias("csumsq"), F.sum("step").over(so_far()).alias("dcsum"))


def subsequences(series: DataFrame, w: int) -> DataFrame:
    """One row per subsequence of w points starting at t: mu, sd (clamped), sq, ce (its squared steps, with the one entering it)."""
    a = ahead(w)
    rows = series.withColumn("step", squared_step()).select(
        "series_id", "t", F.count("*").over(a).alias("_n"), F.avg("value").over(a).alias("mu"), clamp_std(F.stddev_pop("value").over(a)).alias("sd"),
        F.sum(F.col("value") * F.col("value")).over(a).alias("sq"), (F.sum("step").over(a) + 1e-5).alias("ce"), F.min("value").over(a).alias("lo"), F.max("value").over(a).alias("hi"), F.collect_list("value").over(a).alias("window"),
    )
    return rows.where(F.col("_n") == w).drop("_n")


def distance_profile(series: DataFrame, w: int) -> DataFrame:
    """Every subsequence against the first one of its series."""
    from riftline.functions import exprs

    subs = subsequences(series, w)
    q = subs.where("t = 0").select("series_id", *[F.col(c).alias(f"q_{c}") for c in ("mu", "sd", "sq", "ce", "window")])
    dot = F.aggregate(F.zip_with("window", "q_window", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    out = subs.join(q, "series_id").withColumn("dot", dot)
    ed = exprs.euclidean(F.col("dot"), F.col("sq"), F.col("q_sq"))
    return out.select("series_id", "t", "dot", exprs.pearson(F.col("dot"), F.col("mu"), F.col("sd"), F.col("q_mu"), F.col("q_sd"), w).alias("pearson"), ed.alias("ed"), exprs.cid(ed, F.col("ce"), F.col("q_ce")).alias("cid"))


def count_windows(series: DataFrame, size: int) -> DataFrame:
    """Tumbling count windows; a last incomplete one does not fire."""
    out = series.groupBy("series_id", F.floor(F.col("t") / size).alias("window")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("t").alias("last_t"))
    return out.where(F.col("n") == size)


def gains(series: DataFrame, width: int) -> DataFrame:
    """Gain of splitting the 2 * width points that end at t in half, for the costs that frames express."""
    both, left, right = ordered().rowsBetween(1 - 2 * width, 0), ordered().rowsBetween(1 - 2 * width, -width), ordered().rowsBetween(1 - width, 0)
    var = lambda f: F.var_pop("value").over(f)
    rows = series.select("series_id", "t", F.count("*").over(both).alias("n"), var(both).alias("v"), var(left).alias("a"), var(right).alias("b")).where(F.col("n") == 2 * width)
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-12)))
    return rows.select("series_id", (F.col("t") - width + 1).alias("split"), (2 * F.col("v") - F.col("a") - F.col("b")).alias("l2"), (2 * log("v") - log("a") - log("b")).alias("normal"), F.when(F.col("v") > 0, 2 - (F.col("a") + F.col("b")) / F.col("v")).alias("mahalanobis"))


def page_hinkley(series: DataFrame, delta: float = 0.005) -> DataFrame:
    mean = series.withColumn("mean", F.avg("value").over(so_far()))
    cum = mean.withColumn("cum", F.sum(F.col("value") - F.col("mean") - delta).over(so_far()))
    return cum.select("series_id", "t", (F.col("cum") - F.min("cum").over(so_far())).alias("ph"))


def drift_statistics(series: DataFrame) -> DataFrame:
    """Running mean p, its deviation s, and the smallest p + s so far, of values scaled to [0, 1]."""
    scaled = series.select("series_id", "t", ((F.col("value") - F.min("value").over(by())) / F.greatest(F.max("value").over(by()) - F.min("value").over(by()), F.lit(1e-12))).alias("x"))
    p = scaled.withColumn("p", F.avg("x").over(so_far())).withColumn("s", F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(0.0)) / (F.col("t") + 1)))
    return p.select("series_id", "t", "p", "s", F.min(F.col("p") + F.col("s")).over(so_far()).alias("least"))


def hoeffding_bounds(series: DataFrame, confidence: float = 1e-3) -> DataFrame:
    scaled = drift_statistics(series)
    return scaled.select("series_id", "t", "p", F.sqrt(F.log(F.lit(1 / confidence)) / (2.0 * (F.col("t") + 1))).alias("bound"))
