"""Classification profiles as cumulative sums of events, and change points from them.

With m the (k // 2 + 1)-th largest neighbour of a row, row i is predicted 1 at split s exactly if m >= s. So counts over all splits are cumulative
sums of at most three events a row: linear, and nothing but grouping and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.functions import exprs
from riftline.operators.matrix import last_blocks

GROUP = ["series_id", "block"]


def majority(knn: DataFrame, k: int) -> DataFrame:
    """(series_id, block, i, m)."""
    return knn.groupBy(*GROUP, "i").agg(F.sort_array(F.collect_list("j"), asc=False).alias("js")).select(*GROUP, "i", F.element_at("js", k // 2 + 1).alias("m"))


def confusion(m: DataFrame, w: int) -> DataFrame:
    """(series_id, block, split, n, tp, fp, fn, tn) for splits that leave 5 w rows on either side."""
    i, at = F.col("i"), F.col("m")
    event = lambda pos, tp, fp: F.struct(pos.alias("pos"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"))
    listed = F.array(event(F.greatest(i, at) + 1, 1, 0), F.when(at < i - w, event(at + 1, 0, 1)), F.when(at < i - w, event(i - w + 1, 0, -1)), event(i, 0, 0))
    flat = m.select(*GROUP, "i", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("e")).groupBy(*GROUP, F.col("e.pos").alias("split")).agg(F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.max("i").alias("i"))
    run = Window.partitionBy(*GROUP).orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    n = F.max("i").over(Window.partitionBy(*GROUP)) + 1  # not by a join, for which neighbours would be sought twice
    summed = flat.select(*GROUP, "split", F.sum("tp").over(run).alias("tp"), F.sum("fp").over(run).alias("fp"), n.alias("n"))
    out = summed.where((F.col("split") >= 5 * w) & (F.col("split") < F.col("n") - 5 * w))
    return out.select(*GROUP, "split", "n", "tp", "fp", (F.col("split") - F.col("tp")).alias("fn"), (F.col("n") - F.col("split") - w - F.col("fp")).alias("tn"))


def scored(conf: DataFrame, score: str = "f1") -> DataFrame:
    return conf.withColumn("score", exprs.SCORES[score](F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def smoothed(profile: DataFrame, d: int) -> DataFrame:
    """(2 score + share of defined splits) / 3."""
    share = F.count("score").over(Window.partitionBy(*GROUP)) / F.lit(d)
    return profile.withColumn("smooth", (2 * F.col("score") + share) / 3)


def owned(profile: DataFrame, series: DataFrame, d: int) -> DataFrame:
    """Each split of a series once, from the block in which it lies most central: the middle half of a block, and the ends of the first and the last."""
    block, split = F.col("block"), F.col("split")
    inner = ((block == 0) | (split >= d // 4)) & ((block == F.col("last")) | (split < d // 4 + d // 2))
    return profile.join(last_blocks(series, d), "series_id").where(inner).drop("last")


def best_split(profile: DataFrame) -> DataFrame:
    """The split of the highest score of each block, the first of equals."""
    top = profile.where("score IS NOT NULL").groupBy(*GROUP).agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("split")).alias("neg"), "n", "tp", "fp", "split")).alias("b"))
    return top.select(*GROUP, F.col("b.split").alias("split"), F.col("b.s").alias("score"), F.col("b.n").alias("n"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"))


def tested(best: DataFrame, w: int) -> DataFrame:
    return best.withColumn("z", exprs.rank_sum_z(F.col("tp"), F.col("fp"), F.col("split"), F.col("n") - F.col("split") - w))


def arcs(knn: DataFrame) -> DataFrame:
    """Arcs from each row to its nearest neighbour that pass over each position, and the ideal count for rows without structure."""
    one = knn.where("rank = 1").select(*GROUP, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i")
    ends = one.select(*GROUP, F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).alias("x")), F.struct(F.col("b").alias("pos"), F.lit(-1).alias("x")))).alias("e"))
    run = Window.partitionBy(*GROUP).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = ends.groupBy(*GROUP, F.col("e.pos").alias("pos")).agg(F.sum("e.x").alias("x")).withColumn("arcs", F.sum("x").over(run))
    n = knn.groupBy(*GROUP).agg((F.max("i") + 1).alias("n"))
    ideal = 2.0 * F.col("pos") * (F.col("n") - F.col("pos")) / F.col("n")
    return summed.join(n, GROUP).select(*GROUP, "pos", "arcs", F.when(ideal > 0, F.least(F.col("arcs") / ideal, F.lit(1.0))).otherwise(1.0).alias("cac"))


def interpolated(profile: DataFrame, value: str) -> DataFrame:
    """Nulls replaced by the line between their neighbours; at the ends by the nearest value."""
    back = Window.partitionBy(*GROUP).orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy(*GROUP).orderBy(F.desc("split")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that grows: one that shrinks is computed anew for each row
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("split").alias("p"), F.col(value).alias("v")))
    a, b = F.col("_a"), F.col("_b")
    line = F.when(a["p"] == b["p"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("split") - a["p"]) / (b["p"] - a["p"]))
    out = profile.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.last(known, True).over(fwd))
    return out.withColumn("filled", F.coalesce(line, a["v"], b["v"])).drop("_a", "_b")
