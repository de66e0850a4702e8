"""Segmentation quality: segments, Covering, margin F-measure, delays; and the reports over score tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(cps: DataFrame, lengths: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, start, end) from distinct change points 0 < cp < n. lengths: (key, n)."""
    starts = lengths.select(key, F.lit(0).cast("long").alias("start")).union(cps.join(lengths, key).where("cp > 0 AND cp < n").select(key, F.col("cp").cast("long"))).distinct()
    next_start = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return starts.join(lengths, key).select(key, "start", F.coalesce(next_start, F.col("n")).alias("end"))


def _annotated(truth: DataFrame, annotators: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    """truth with a column annotator, and all (key, annotator): those given, which may have no change point, or those of truth."""
    if "annotator" not in truth.columns:
        truth = truth.withColumn("annotator", F.lit(0))
    return truth, (truth if annotators is None else annotators).select(key, "annotator").distinct()


def covering(truth: DataFrame, found: DataFrame, lengths: DataFrame, key: str = "series_id", annotators: DataFrame | None = None) -> DataFrame:
    """Mean over annotators of the share-weighted best Jaccard overlap. truth may have a column annotator. Only segments that overlap meet."""
    truth, who = _annotated(truth, annotators, key)
    each = lengths.join(who, key, "left").withColumn("annotator", F.coalesce("annotator", F.lit(0)))
    a = segments(truth.withColumn("_k", F.concat_ws("|", key, "annotator")).select("_k", "cp"), each.select(F.concat_ws("|", key, "annotator").alias("_k"), "n"), "_k")
    a = a.join(each.select(F.concat_ws("|", key, "annotator").alias("_k"), key, "annotator", "n"), "_k")
    b = segments(found, lengths, key).select(key, F.col("start").alias("s2"), F.col("end").alias("e2"))
    inter = F.least("end", "e2") - F.greatest("start", "s2")
    met = a.join(b, key).where((F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2")))
    best = met.withColumn("jac", inter / (F.greatest("end", "e2") - F.least("start", "s2"))).groupBy(key, "annotator", "n", "start", "end").agg(F.max("jac").alias("jac"))
    single = best.groupBy(key, "annotator").agg((F.sum((F.col("end") - F.col("start")) * F.col("jac")) / F.max("n")).alias("covering"))
    return single.groupBy(key).agg(F.avg("covering").alias("covering"))


def _matches(truth, found, margin):
    """Greedy nearest match in ascending order, each prediction used once; as a fold over arrays."""
    def step(acc, t):
        near = F.filter(acc["left"], lambda x: F.abs(x - t) <= margin)
        pick = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x - t).alias("d"), x.alias("x"))))["x"]
        return F.when(pick.isNull(), acc).otherwise(F.struct(F.filter(acc["left"], lambda x: x != pick).alias("left"), (acc["hits"] + 1).alias("hits")))

    return F.aggregate(truth, F.struct(found.alias("left"), F.lit(0).alias("hits")), step)["hits"]


def f_measure(truth: DataFrame, found: DataFrame, lengths: DataFrame, key: str = "series_id", share: float = 0.01, alpha: float = 0.5, annotators: DataFrame | None = None) -> DataFrame:
    """Margin F1: 0 counts on both sides; precision against the union of annotators, recall averaged over them, also over those without a change point."""
    truth, who = _annotated(truth, annotators, key)
    with_zero = lambda c: F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.coalesce(c, F.array().cast("array<bigint>")))))
    by_annotator = who.join(truth, [key, "annotator"], "left").groupBy(key, "annotator").agg(F.collect_set(F.col("cp").cast("long")).alias("cps"))
    gathered = by_annotator.groupBy(key).agg(F.collect_list("cps").alias("each"), F.array_distinct(F.flatten(F.collect_list("cps"))).alias("all"))
    preds = found.groupBy(key).agg(F.collect_set(F.col("cp").cast("long")).alias("found"))
    rows = lengths.join(gathered, key, "left").join(preds, key, "left").withColumn("margin", F.floor(F.col("n") * share))
    rows = rows.withColumn("found", with_zero(F.col("found"))).withColumn("all", with_zero(F.col("all")))
    rows = rows.withColumn("each", F.transform(F.coalesce("each", F.array(F.array().cast("array<bigint>"))), with_zero))
    precision = _matches(F.col("all"), F.col("found"), F.col("margin")) / F.size("found")
    recalls = F.transform("each", lambda t: _matches(t, F.col("found"), F.col("margin")) / F.size(t))
    recall = F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x) / F.size("each")
    return rows.select(key, precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.col("precision") * F.col("recall") / (alpha * F.col("recall") + (1 - alpha) * F.col("precision")))


def delays(truth: DataFrame, found: DataFrame, key: str = "series_id") -> DataFrame:
    """Points from each true change point to the first detection at or after it."""
    return truth.join(found.select(key, "detected_at"), key).where("detected_at >= cp").groupBy(key, "cp").agg((F.min("detected_at") - F.col("cp")).alias("delay"))


def summary(scores: DataFrame) -> DataFrame:
    """scores: (dataset, method, score)."""
    return scores.groupBy("method").agg(F.round(F.avg("score"), 3).alias("mean"), F.round(F.percentile("score", 0.5), 3).alias("median"), F.round(F.stddev_samp("score"), 3).alias("std"), F.count("*").alias("n"))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("score"))))


def rank_report(scores: DataFrame) -> DataFrame:
    return ranked(scores).groupBy("method").agg(F.round(F.avg("rank"), 4).alias("mean_rank"), F.count_if(F.col("rank") == 1).alias("wins"))


def pairwise(scores: DataFrame) -> DataFrame:
    a, b = scores.toDF(*[f"{c}_a" if c != "dataset" else c for c in scores.columns]), scores.toDF(*[f"{c}_b" if c != "dataset" else c for c in scores.columns])
    both = a.join(b, "dataset").where("method_a != method_b")
    x, y = F.col("score_a"), F.col("score_b")
    return both.groupBy("method_a", "method_b").agg(F.count_if(x > y).alias("wins"), F.count_if(x == y).alias("ties"), F.count_if(x < y).alias("losses"))


def nemenyi(k: int, p: float = 0.05) -> float:
    """Upper quantile of the range of k standard normals, divided by sqrt 2."""
    z = np.linspace(-9, 9, 4001)
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z[1] - z[0])
    lo, hi = 0.0, 18.0
    for _ in range(50):
        q = (lo + hi) / 2
        within = k * (density * np.maximum(below - np.interp(z - q, z, below, left=0.0), 0) ** (k - 1)).sum()
        lo, hi = (q, hi) if within < 1 - p else (lo, q)
    return hi / math.sqrt(2)


def critical_difference(scores: DataFrame) -> DataFrame:
    """One row; the number of methods is read first, to find its quantile."""
    k = scores.select("method").distinct().count()
    q = round(nemenyi(k), 3) if k > 1 else 0.0
    n = scores.agg(F.countDistinct("method").alias("k"), F.countDistinct("dataset").alias("n"))
    return n.select("k", "n", (q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))
