"""Column expressions: distances, scores, significance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: |z| from which the two-sided p-value is at most the key.
Z_OF_P = {0.05: 1.95996, 1e-10: 6.46695, 1e-50: 14.97948, 1e-60: 16.43934, 1e-100: 21.30595}


def clamp_std(std: Column) -> Column:
    return F.when(std < 1e-3, 1.0).otherwise(std)


def pearson(dot: Column, mu: Column, sd: Column, q_mu: Column, q_sd: Column, w: int) -> Column:
    return 2 * w * (1 - (dot - w * mu * q_mu) / (w * sd * q_sd))


def euclidean(dot: Column, sq: Column, q_sq: Column) -> Column:
    return sq + q_sq - 2 * dot


def cid(ed: Column, ce: Column, q_ce: Column) -> Column:
    return ed * F.greatest(ce, q_ce) / F.least(ce, q_ce)


def f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Macro F1 of both labels; null where it is undefined."""
    def one(a: Column, b: Column, c: Column) -> Column:
        ok = (a + b > 0) & (a + c > 0) & (a > 0)
        return F.when(ok, 2 * a / (2 * a + b + c))

    return (one(tp, fp, fn) + one(tn, fn, fp)) / 2


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    total = tp + fp + fn + tn
    return F.when(total > 0, (tp + tn) / total)


SCORES = {"f1": f1, "accuracy": accuracy}


def rank_sum_z(tp: Column, fp: Column, n1: Column, n2: Column) -> Column:
    """Wilcoxon rank-sum z of predicted labels left and right of a split, without tie correction."""
    n1, n2, x0, y0 = (c.cast("double") for c in (n1, n2, tp, fp))
    return 0.5 * ((n1 - x0) * y0 - x0 * (n2 - y0)) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
