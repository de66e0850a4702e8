"""Kernels over blocks of a series. A block is a count window of ``d`` points, so a task holds a bounded part of a series, however long it is.

Within a block every subsequence is compared with every other, as blocked matrix products. Blocks are independent groups: parallelism is
series x blocks, and one shuffle on (series_id, block) brings a block's points together. Blocks of neighbours overlap by half, so that every
position lies at least d / 4 from the edges of one of them; blocks of whole-window statistics tumble.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

D, W, K = 10_000, 20, 3
#: Distances are compared in whole millionths, so that ties do not hang on the order of additions.
MICRO = 1e6
#: Rows whose distances are held at once: few, so that they stay in the cache of a core.
ROWS = 16


def blocks(series: DataFrame, d: int = D) -> DataFrame:
    """Each point in the blocks that hold it: block b has d points from b * d / 2 on. A later block of d / 2 points or fewer lies within the one before, and is none."""
    at = F.floor(F.col("t") / (d // 2)).cast("long")
    return series.withColumn("block", F.explode(F.when(at == 0, F.array(at)).otherwise(F.array(at - 1, at))))


def last_blocks(series: DataFrame, d: int = D) -> DataFrame:
    """(series_id, last): the number of the last block."""
    return series.groupBy("series_id").agg(F.greatest(F.lit(0), F.ceil(F.count("*") / (d // 2)) - 2).cast("long").alias("last"))


def tumbling(series: DataFrame, d: int = D) -> DataFrame:
    return series.withColumn("block", F.floor(F.col("t") / d).cast("long"))


def windows_of(x: np.ndarray, w: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, w)


def knn_arrays(x: np.ndarray, w: int, k: int, similarity: str = "pearson", radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, distances), each (rows, k), nearest first, ties to the smaller index; -1 and inf where there are fewer."""
    r = w // 2 if radius is None else radius
    win = windows_of(x, w)
    n = len(win)
    mu, sd = win.mean(1), win.std(1)
    sd = np.where(sd < 1e-3, 1.0, sd)
    sq = (win * win).sum(1)
    steps = np.r_[0.0, np.diff(x) ** 2]
    ce = windows_of(steps, w).sum(1) + 1e-5
    near, dist = np.full((n, k), -1), np.full((n, k), np.inf)
    z = (win - mu[:, None]) * (np.sqrt(2 * MICRO) / sd[:, None]) if similarity == "pearson" else win
    zt, held = np.ascontiguousarray(z.T), np.empty((ROWS, n))
    for a in range(0, n, ROWS):
        b = min(n, a + ROWS)
        d = np.matmul(z[a:b], zt, out=held[: b - a])
        if similarity == "pearson":
            np.subtract(2 * w * MICRO, d, out=d)
        else:
            d = (sq[a:b, None] + sq - 2 * d) * MICRO
            if similarity == "cid":
                d = d * np.maximum(ce[a:b, None], ce) / np.minimum(ce[a:b, None], ce)
        np.rint(d, out=d)
        for i in range(a, b):
            d[i - a, max(0, i - r) : i + r] = np.inf
        rows = np.arange(b - a)
        for rank in range(min(k, n)):
            c = d.argmin(1)  # the first of equals
            v = d[rows, c] / MICRO
            near[a:b, rank], dist[a:b, rank] = np.where(np.isfinite(v), c, -1), v
            d[rows, c] = np.inf
    return near, dist


def knn(series: DataFrame, w: int = W, k: int = K, similarity: str = "pearson", d: int = D) -> DataFrame:
    """(series_id, block, i, rank, j, dist) of exact nearest neighbours within a block, i and j counted from its start; blocks shorter than w have none."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy()
        if len(x) < w or (key[1] > 0 and len(x) <= d // 2):
            return pd.DataFrame({"series_id": pd.Series([], dtype=object), **{c: np.empty(0, int) for c in ("block", "i", "rank", "j")}, "dist": np.empty(0)})
        near, dist = knn_arrays(x, w, k, similarity)
        i, rank = np.nonzero(near >= 0)
        return pd.DataFrame({"series_id": key[0], "block": key[1], "i": i, "rank": rank + 1, "j": near[i, rank], "dist": dist[i, rank]})

    return blocks(series, d).groupBy("series_id", "block").applyInPandas(run, "series_id string, block long, i long, rank long, j long, dist double")


def per_block(series: DataFrame, function, schema: str, d: int = D) -> DataFrame:
    """function(values) -> columns, for each tumbling block."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(function(pdf.sort_values("t")["value"].to_numpy()))
        out.insert(0, "block", key[1])
        out.insert(0, "series_id", pd.Series([key[0]] * len(out), dtype=object))
        return out

    return tumbling(series, d).groupBy("series_id", "block").applyInPandas(run, f"series_id string, block long, {schema}")
