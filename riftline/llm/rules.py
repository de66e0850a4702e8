"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Native: statistics are column expressions within the row, so texts never shuffle; estimates are grouped aggregates with
map-side partial sums, so a source with a third of the rows costs its tasks one row each.

The estimate of a group follows the deterministic MCD: two starting orders (the Mahalanobis distance from median and MAD, and
the largest coordinate distance), each taking the half-or-more subset of smallest distances, then concentration steps; the start
with the smaller determinant wins, and its scatter is scaled up where the median distance exceeds that of its chi-square (features that hardly vary have a floor, so a
median below it says nothing of the rest). A group too small
for an estimate of its own is judged by the pooled one of its language, and where that is too small as well, by that of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import WORD, table, written

#: Share of a group that an estimate rests on, and concentration steps.
SUBSET, STEPS = 0.75, 2
#: Groups below this size are judged by a pooled estimate.
LEAST_ROWS = 30
#: Chi-square with 5 degrees of freedom: median, and the quantile 0.999 beyond which a document is an outlier.
CHI2_MEDIAN, CHI2_CUT = 4.3515, 20.515
#: Transformed statistics with the standard deviation to which an estimate below it is raised.
FEATURES = {"f_length": 1.0, "f_word": 0.12, "f_symbols": 0.5, "f_lines": 0.7, "f_repeats": 0.7}
NAMES = tuple(FEATURES)
_P = len(NAMES)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the array, the first included."""

    def covered(places: Column) -> Column:
        each = F.transform(places, lambda v, k: F.when(k + 1 < F.size(places), F.least(F.lit(5), F.get(places, k + 1) - v)).otherwise(F.lit(5)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def slow(h: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(_let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"]))), covered)

    def found(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h))

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(5), F.size(h) - 4), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), x))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 6, _let(_let(hashed, windows), found)).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """All columns of docs but text, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. A null text has no word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")))
    out = docs.withColumn("_w", counted).withColumn("_lines", _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
    return out.select(
        *[c for c in docs.columns if c != "text"],
        F.col("_w.n_words"),
        F.col("_w.word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words"),
        ((F.col("_w.n_words") < 10) | (100 * F.col("_w.n_repeat_words") > 20 * F.col("_w.n_words"))).alias("base_failed"),
    )


def features(stats: DataFrame) -> DataFrame:
    per = lambda c: F.log1p(100.0 * F.col(c) / F.greatest("n_words", F.lit(1)))
    return stats.withColumns({
        "f_length": F.log1p(F.col("n_words").cast("double")),
        "f_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest("n_words", F.lit(1))),
        "f_symbols": F.log1p(100.0 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "f_lines": per("n_dup_lines"),
        "f_repeats": per("n_repeat_words"),
    })


def _distance(start: str) -> Column:
    """Squared Mahalanobis distance from the group's centre and whitening matrix of a start."""
    total = F.lit(0.0)
    for i in range(_P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"{start}.w{i}{j}") * (F.col(NAMES[j]) - F.col(f"{start}.m{j}"))
        total = total + y * y
    return total


def _estimates(inside: Column, start: str) -> list[Column]:
    """Aggregates of the rows inside: means, then products for the covariances."""
    x = [F.when(inside, F.col(c)) for c in NAMES]
    return [F.avg(x[i]).alias(f"{start}_m{i}") for i in range(_P)] + [F.covar_pop(x[i], x[j]).alias(f"{start}_c{i}{j}") for i in range(_P) for j in range(i + 1)]


def _whitened(groups: DataFrame, starts: tuple[str, ...]) -> DataFrame:
    """From means and covariances, the struct of each start: means m, the inverse w of the Cholesky factor, and logdet.

    What depends on the same columns is added in one projection for all starts, so the plan stays short.
    """
    floor = list(FEATURES.values())
    out = groups

    def factor(s: str, i: int, j: int) -> Column:
        c = F.coalesce(F.col(f"{s}_c{i}{j}"), F.lit(0.0))
        if i == j:
            c = F.greatest(c, F.lit(floor[i] ** 2))
        for k in range(j):
            c = c - F.col(f"_l{s}{i}{k}") * F.col(f"_l{s}{j}{k}")
        return F.sqrt(F.greatest(c, F.lit(1e-6))) if i == j else c / F.col(f"_l{s}{j}{j}")

    def inverse(s: str, i: int, j: int) -> Column:
        w = F.lit(1.0) if i == j else F.lit(0.0)
        for k in range(j, i):
            w = w - F.col(f"_l{s}{i}{k}") * F.col(f"_w{s}{k}{j}")
        return w / F.col(f"_l{s}{i}{i}")

    for j in range(_P):
        out = out.withColumns({f"_l{s}{j}{j}": factor(s, j, j) for s in starts})
        if j + 1 < _P:
            out = out.withColumns({f"_l{s}{i}{j}": factor(s, i, j) for s in starts for i in range(j + 1, _P)})
    for away in range(_P):
        out = out.withColumns({f"_w{s}{j + away}{j}": inverse(s, j + away, j) for s in starts for j in range(_P - away)})

    def made(s: str) -> Column:
        means = [F.coalesce(F.col(f"{s}_m{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(_P)]
        inverses = [F.col(f"_w{s}{i}{j}").alias(f"w{i}{j}") for i in range(_P) for j in range(i + 1)]
        logdet = sum((F.log(F.col(f"_l{s}{i}{i}")) for i in range(1, _P)), F.log(F.col(f"_l{s}00")))
        return F.struct(*means, *inverses, logdet.alias("logdet"))

    out = out.withColumns({s: made(s) for s in starts})
    return out.drop(*[c for c in out.columns if c.startswith(("_l", "_w", *(f"{s}_{x}" for s in starts for x in "mc")))])


def _matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal or null by; without any by, with each row of right."""
    keyed = right.toDF(*[f"k_{c}" if c in by else c for c in right.columns])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return left.join(F.broadcast(keyed), on, how).drop(*[f"k_{c}" for c in by])


def determinants(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: n, best (means and whitening), scale. rows: features, already without failed documents. Without any by, all rows are one group."""
    def joined(groups: DataFrame) -> DataFrame:
        return _matched(rows, groups, by)

    medians = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(f"med{i}") for i, c in enumerate(NAMES)])
    medians = written(medians, "medians")
    spread = joined(medians).groupBy(*by).agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"med{i}")), 0.5, 1000).alias(f"mad{i}") for i, c in enumerate(NAMES)])
    groups = written(_matched(medians, spread, by), "spread")
    z = [(F.col(c) - F.col(f"med{i}")) / F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(floor)) for i, (c, floor) in enumerate(FEATURES.items())]
    distances = {"a": sum((x * x for x in z[1:]), z[0] * z[0]), "b": F.greatest(*[F.abs(x) for x in z])}
    for _ in range(STEPS + 1):
        at = joined(groups)
        cuts = at.groupBy(*by).agg(*[F.percentile_approx(d, SUBSET, 1000).alias(f"cut_{s}") for s, d in distances.items()])
        groups = written(_matched(groups, cuts, by), "cuts")
        # The distance is a column of its own, so that it is computed once a row and not in every aggregate.
        near = joined(groups).withColumns({f"_in_{s}": d <= F.col(f"cut_{s}") for s, d in distances.items()})
        sums = near.groupBy(*by).agg(F.count("*").alias("n"), *[e for s in distances for e in _estimates(F.col(f"_in_{s}"), s)])
        groups = written(_whitened(sums, tuple(distances)), "steps")
        distances = {"a": _distance("a"), "b": _distance("b")}
    best = groups.select(*by, "n", F.when(F.col("b.logdet") < F.col("a.logdet"), F.col("b")).otherwise(F.col("a")).alias("best"))
    scale = joined(best).groupBy(*by).agg(F.greatest(F.percentile_approx(_distance("best"), 0.5, 1000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    return written(_matched(best, scale, by), "best")


def judges(rows: DataFrame, by: list[str]) -> DataFrame:
    """determinants(rows, by), but groups under LEAST_ROWS rows have the estimate of a shorter by; that of all rows serves at any size."""
    groups = determinants(rows, by)
    for k in reversed(range(len(by))):
        few = groups.where(F.col("n") < LEAST_ROWS).select(*by)
        if few.isEmpty():
            break
        pooled = determinants(_matched(rows, few.select(*by[:k]).distinct(), by[:k], "left_semi") if k else rows, by[:k])
        groups = written(groups.where(F.col("n") >= LEAST_ROWS).unionByName(_matched(few, pooled, by[:k])), "pooled")
    return groups


def robust_outliers(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """statistics(docs) plus distance and kept.

    ``kept`` is false if base_failed, or if the squared distance from the robust centre exceeds CHI2_CUT. The centre is the group's, for
    groups of fewer than LEAST_ROWS rows that pass the base rules that of its language, else of all rows. Null lang or source
    are groups of their own; one without any row that passes has a null distance. Repeated rows are judged alike; an empty table gives no rows.
    """
    by = list(by)
    rows = written(features(statistics(docs)), "statistics")
    judged = _matched(rows, judges(rows.where("NOT base_failed"), by), by, "left")
    out = judged.withColumn("distance", _distance("best") / F.col("scale")).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CHI2_CUT))
    return out.drop("n", "best", "scale", *NAMES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_outliers(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
