"""Registered queries over the driver's tables, and the same in SQL where SQL can express them.

Every query reads its whole tables. Doubles are rounded, so that engines that add in other orders agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.operators import evaluation, matrix, periods, profile, rolling
from riftline.sources.series import events, injected, table, to_series
from riftline.streaming import run

W, K, D = 20, 3, 10_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_E = "e AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value FROM events WHERE value IS NOT NULL)"
_INJ = _E.replace("e AS", "e0 AS", 1) + ", e AS (SELECT series_id, t, CASE WHEN t * 2 >= count(*) OVER (PARTITION BY series_id) THEN 0.2 * value + 50.0 * sin(2.0 * 3.141592653589793 * t / 20) ELSE value END AS value FROM e0)"
_STEP = "st AS (SELECT *, coalesce((value - lag(value) OVER (PARTITION BY series_id ORDER BY t)) ** 2, 0) AS step FROM e)"


def _subs(source: str = _E, w: int = W) -> str:
    f = f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    return f"""WITH {source}, {_STEP}, s0 AS (SELECT series_id, t, count(*) {f} AS n, avg(value) {f} AS mu, stddev_pop(value) {f} AS sd0, sum(value * value) {f} AS sq, sum(step) {f} + 1e-5 AS ce, min(value) {f} AS lo, max(value) {f} AS hi, list(value) {f} AS win FROM st),
s AS (SELECT * REPLACE (CASE WHEN sd0 < 1e-3 THEN 1.0 ELSE sd0 END AS sd0) FROM s0 WHERE n = {w})"""


# Sources and preparation


@query(f"WITH {_E} SELECT series_id, t::BIGINT AS t, value FROM e")
def series_from_events(spark, d):
    return events(spark, d)


@query(f"WITH {_E} SELECT series_id, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1")
def series_stats(spark, d):
    out = events(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rounded(out, "mean", "std")


@query("""WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, t::BIGINT AS cp, event_type AS label FROM x WHERE before <> event_type""")
def label_to_cps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("cp"), F.lag("event_type").over(w).alias("before"))
    return x.where("before <> event_type").select("user_id", "cp", F.col("event_type").alias("label"))


@query("""WITH x AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_type <> 'view'), y AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM x)
SELECT user_id, count(*) FILTER (before <> event_type) AS n_cps, max(t)::BIGINT + 1 AS n FROM y GROUP BY 1""")
def transient_labels_dropped(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").where("event_type <> 'view'").select("user_id", "event_type", F.row_number().over(w).cast("long").alias("r"), F.lag("event_type").over(w).alias("before"))
    return x.groupBy("user_id").agg(F.count_if(F.col("before") != F.col("event_type")).alias("n_cps"), F.max("r").alias("n"))


@query(f"WITH {_E} SELECT series_id, (t // 5)::BIGINT AS t, value FROM e WHERE t % 5 = 0")
def decimate(spark, d):
    return events(spark, d).where("t % 5 = 0").select("series_id", F.floor(F.col("t") / 5).alias("t"), "value")


_SENSORS = "l_quantity l_extendedprice l_discount".split()


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_returnflag || '_' || sensor AS series_id, v FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS extendedprice, l_discount::DOUBLE AS discount FROM lineitem) ON quantity, extendedprice, discount INTO NAME sensor VALUE v))
SELECT series_id, count(*) AS n, round(avg(v), 4) AS mean FROM u GROUP BY 1""")
def unpivot_sensors(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", *[F.col(c).cast("double").alias(c[2:]) for c in _SENSORS])
    long = x.unpivot("l_returnflag", [c[2:] for c in _SENSORS], "sensor", "v").withColumn("series_id", F.regexp_replace(F.concat_ws("_", "l_returnflag", "sensor"), " ", "_"))
    return rounded(long.groupBy("series_id").agg(F.count("v").alias("n"), F.avg("v").alias("mean")), "mean")


@query("""WITH u AS (SELECT o_orderstatus AS series_id, o_orderdate, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY o_orderdate) - 1)::BIGINT AS t, round(v, 2)::DOUBLE AS value FROM u""")
def daily_order_series(spark, d):
    daily = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    return rounded(to_series(daily, "o_orderstatus", ["o_orderdate"], "v"), "value", digits=2)


# Windows


@query(f"""WITH {_E}, {_STEP} SELECT series_id, t::BIGINT AS t, round(sum(value) OVER w, 3) AS csum, round(sum(value * value) OVER w, 4) AS csumsq, round(sum(step) OVER w, 4) AS dcsum FROM st WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
def prefix_sums(spark, d):
    out = rolling.prefix_sums(events(spark, d))
    return rounded(rounded(out, "csum", digits=3), "csumsq", "dcsum")


@query(_subs() + " SELECT series_id, t::BIGINT AS t, round(mu, 4) AS mu, round(sd0, 4) AS sd FROM s")
def rolling_mean_std(spark, d):
    return rounded(rolling.subsequences(events(spark, d), W).select("series_id", "t", "mu", "sd"), "mu", "sd")


@query(_subs() + " SELECT series_id, t::BIGINT AS t, lo, hi FROM s")
def rolling_min_max(spark, d):
    return rolling.subsequences(events(spark, d), W).select("series_id", "t", "lo", "hi")


@query(_subs() + " SELECT series_id, t::BIGINT AS t, round(ce, 3) AS ce FROM s")
def complexity_estimate(spark, d):
    return rounded(rolling.subsequences(events(spark, d), W).select("series_id", "t", "ce"), "ce", digits=3)


@query(f"WITH {_E} SELECT series_id, t::BIGINT AS t, round(avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS mean FROM e QUALIFY t >= 9")
def moving_mean(spark, d):
    w = rolling.ordered().rowsBetween(-9, 0)
    return rounded(events(spark, d).select("series_id", "t", F.avg("value").over(w).alias("mean")).where("t >= 9"), "mean")


_DOT = _subs() + ", p AS (SELECT s.*, q.mu AS qmu, q.sd0 AS qsd, q.sq AS qsq, q.ce AS qce, list_dot_product(s.win, q.win) AS dot FROM s JOIN s q ON q.series_id = s.series_id AND q.t = 0) "


@query(_DOT + "SELECT series_id, t::BIGINT AS t, round(dot, 4) AS dot FROM p")
def sliding_dot(spark, d):
    return rounded(rolling.distance_profile(events(spark, d), W).select("series_id", "t", "dot"), "dot")


@query(_DOT + f"SELECT series_id, t::BIGINT AS t, round(2 * {W} * (1 - (dot - {W} * mu * qmu) / ({W} * sd0 * qsd)), 4) + 0.0 AS dist FROM p")
def dist_pearson(spark, d):
    out = rolling.distance_profile(events(spark, d), W).select("series_id", "t", F.col("pearson").alias("dist"))
    return rounded(out, "dist").withColumn("dist", F.col("dist") + 0.0)


@query(_DOT + "SELECT series_id, t::BIGINT AS t, round(sq + qsq - 2 * dot, 4) + 0.0 AS dist FROM p")
def dist_ed(spark, d):
    return rounded(rolling.distance_profile(events(spark, d), W).select("series_id", "t", F.col("ed").alias("dist")), "dist").withColumn("dist", F.col("dist") + 0.0)


@query(_DOT + "SELECT series_id, t::BIGINT AS t, round((sq + qsq - 2 * dot) * greatest(ce, qce) / least(ce, qce), 1) + 0.0 AS dist FROM p")
def dist_cid(spark, d):
    return rounded(rolling.distance_profile(events(spark, d), W).select("series_id", "t", F.col("cid").alias("dist")), "dist", digits=1).withColumn("dist", F.col("dist") + 0.0)


@query(_DOT + f"SELECT series_id, count(*) FILTER (WHERE NOT (t >= -{W // 2} AND t < {W // 2})) AS allowed, count(*) AS n FROM p GROUP BY 1")
def exclusion_zone(spark, d):
    out = rolling.distance_profile(events(spark, d), W)
    zone = (F.col("t") >= -(W // 2)) & (F.col("t") < W // 2)
    return out.groupBy("series_id").agg(F.count_if(~zone).alias("allowed"), F.count("*").alias("n"))


@query(f"WITH {_E} SELECT series_id, (t // 10)::BIGINT AS \"window\", count(*) AS n, round(sum(value), 4) AS total, max(t)::BIGINT AS last_t FROM e GROUP BY 1, 2 HAVING count(*) = 10")
def count_window_tumbling(spark, d):
    return rounded(rolling.count_windows(events(spark, d), 10), "total")


# Nearest neighbours and profiles

_BLK = "b AS (SELECT series_id, t // 10000 AS block, t % 10000 AS t, value FROM e)"
_HALVES = "bl AS (SELECT series_id, t, value, unnest(CASE WHEN t >= 5000 THEN [t // 5000 - 1, t // 5000] ELSE [0] END) AS block FROM e), b AS (SELECT series_id, block, t - block * 5000 AS t, value FROM bl QUALIFY block = 0 OR count(*) OVER (PARTITION BY series_id, block) > 5000)"


def _knn_sql(source: str, kind: str = "pearson") -> str:
    f = f"OVER (PARTITION BY series_id, block ORDER BY t ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)"
    return f"""WITH {source}, {_HALVES}, s0 AS (SELECT series_id, block, t, value, count(*) {f} AS n, avg(value) {f} AS mu, stddev_pop(value) {f} AS sd, list(value) {f} AS win FROM b),
s AS (SELECT * REPLACE (CASE WHEN sd < 1e-3 THEN 1.0 ELSE sd END AS sd) FROM s0 WHERE n = {W}),
c AS (SELECT x.series_id, x.block, x.t AS i, y.t AS j, round(2 * {W} * (1 - (list_dot_product(x.win, y.win) - {W} * x.mu * y.mu) / ({W} * x.sd * y.sd)), 6) AS dist FROM s x JOIN s y ON x.series_id = y.series_id AND x.block = y.block AND NOT (y.t >= x.t - {W // 2} AND y.t < x.t + {W // 2})),
knn AS (SELECT *, row_number() OVER (PARTITION BY series_id, block, i ORDER BY dist, j) AS rank FROM c QUALIFY rank <= {K}),
m AS (SELECT series_id, block, i, list_sort(list(j), 'DESC')[2] AS m FROM knn GROUP BY ALL)"""


def _conf_sql(source: str) -> str:
    return _knn_sql(source) + f""", ev AS (SELECT series_id, block, greatest(i, m) + 1 AS pos, 1 AS tp, 0 AS fp FROM m UNION ALL SELECT series_id, block, m + 1, 0, 1 FROM m WHERE m < i - {W} UNION ALL SELECT series_id, block, i - {W} + 1, 0, -1 FROM m WHERE m < i - {W} UNION ALL SELECT series_id, block, i, 0, 0 FROM m),
g AS (SELECT series_id, block, pos AS split, sum(tp) AS tp, sum(fp) AS fp FROM ev GROUP BY ALL), nn AS (SELECT series_id, block, max(i) + 1 AS n FROM m GROUP BY ALL),
r AS (SELECT series_id, block, split, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp FROM g WINDOW w AS (PARTITION BY series_id, block ORDER BY split)),
conf AS (SELECT r.series_id, r.block::BIGINT AS block, split::BIGINT AS split, n::BIGINT AS n, tp::BIGINT AS tp, fp::BIGINT AS fp, (split - tp)::BIGINT AS fn, (n - split - {W} - fp)::BIGINT AS tn FROM r JOIN nn ON r.series_id = nn.series_id AND r.block = nn.block WHERE split >= {5 * W} AND split < n - {5 * W}),
f AS (SELECT *, CASE WHEN tp > 0 AND tn > 0 THEN (2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fn + fp)) / 2 END AS score, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc FROM conf),
lb AS (SELECT series_id, max(block) AS last FROM b GROUP BY 1),
own AS (SELECT f.* FROM f JOIN lb ON f.series_id = lb.series_id WHERE (f.block = 0 OR split >= 2500) AND (f.block = last OR split < 7500)),
best AS (SELECT * FROM own WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, block ORDER BY round(score, 9) DESC, split) = 1),
z AS (SELECT *, 0.5 * ((split - tp) * fp::DOUBLE - tp * (n - split - {W} - fp)::DOUBLE) / sqrt(split::DOUBLE * (n - split - {W}) * (n - {W} + 1) / 12) AS z FROM best)"""


def _conf(series):
    return profile.confusion(profile.majority(matrix.knn(series, W, K, d=D), K), W)


@query(_knn_sql(_E) + " SELECT series_id, block::BIGINT AS block, i::BIGINT AS i, rank, j::BIGINT AS j, dist FROM knn")
def knn_topk(spark, d):
    return matrix.knn(events(spark, d), W, K, d=D)


@query(_knn_sql(_E) + " SELECT series_id, block::BIGINT AS block, i::BIGINT AS i, m::BIGINT AS m FROM m")
def neighbour_majority(spark, d):
    return profile.majority(matrix.knn(events(spark, d), W, K, d=D), K)


@query(_conf_sql(_E) + " SELECT * FROM conf")
def label_profile_confusion(spark, d):
    return _conf(events(spark, d))


@query(_conf_sql(_E) + " SELECT series_id, block, split, round(score, 6) AS score FROM f")
def profile_f1(spark, d):
    return rounded(profile.scored(_conf(events(spark, d))).select("series_id", "block", "split", "score"), "score", digits=6)


@query(_conf_sql(_E) + " SELECT series_id, block, split, round(acc, 6) AS score FROM f")
def profile_accuracy(spark, d):
    return rounded(profile.scored(_conf(events(spark, d)), "accuracy").select("series_id", "block", "split", "score"), "score", digits=6)


@query(_conf_sql(_E) + " SELECT series_id, block, split, round((2 * score + count(score) OVER (PARTITION BY series_id, block) / 10000.0) / 3, 6) AS smooth FROM f")
def profile_smoothed(spark, d):
    return rounded(profile.smoothed(profile.scored(_conf(events(spark, d))), D).select("series_id", "block", "split", "smooth"), "smooth", digits=6)


def _best(series):
    """The best of the splits that each block owns, with its place in the series."""
    scored = profile.owned(profile.scored(_conf(series)), series, D)
    return profile.tested(profile.best_split(scored), W).withColumn("cp", F.col("block") * (D // 2) + F.col("split"))


@query(_conf_sql(_E) + " SELECT series_id, block, split, block * 5000 + split AS cp, round(score, 6) AS score, n, round(z, 4) AS z FROM z")
def best_split(spark, d):
    best = _best(events(spark, d)).select("series_id", "block", "split", "cp", "score", "n", "z")
    return rounded(rounded(best, "score", digits=6), "z")


@query(_conf_sql(_E) + f" SELECT series_id, block, split, round(0.5 * ((split - tp) * fp::DOUBLE - tp * (n - split - {W} - fp)::DOUBLE) / sqrt(split::DOUBLE * (n - split - {W}) * (n - {W} + 1) / 12), 4) + 0.0 AS z FROM conf")
def rank_sum_z(spark, d):
    out = profile.tested(_conf(events(spark, d)), W).select("series_id", "block", "split", "z")
    return rounded(out, "z").withColumn("z", F.col("z") + 0.0)


@query(_conf_sql(_INJ) + " SELECT series_id, block, split, block * 5000 + split AS cp, round(score, 6) AS score, abs(z) >= 14.97948 AS significant FROM z")
def significant_cp(spark, d):
    best = _best(injected(events(spark, d)))
    return rounded(best.select("series_id", "block", "split", "cp", "score", (F.abs("z") >= 14.97948).alias("significant")), "score", digits=6)


@query(_conf_sql(_E) + " SELECT series_id, block, split, round(greatest(score, acc), 6) AS merged FROM f")
def profile_merge_max(spark, d):
    conf = _conf(events(spark, d))
    both = profile.scored(conf).select("series_id", "block", "split", "score").union(profile.scored(conf, "accuracy").select("series_id", "block", "split", "score"))
    return rounded(both.groupBy("series_id", "block", "split").agg(F.max("score").alias("merged")), "merged", digits=6)


@query(_conf_sql(_E) + """, h AS (SELECT series_id, block, split, CASE WHEN split % 3 = 0 THEN acc END AS v FROM f),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN split END IGNORE NULLS) OVER w AS p, last_value(v IGNORE NULLS) OVER w AS pv, first_value(CASE WHEN v IS NOT NULL THEN split END IGNORE NULLS) OVER x AS q, first_value(v IGNORE NULLS) OVER x AS qv FROM h
WINDOW w AS (PARTITION BY series_id, block ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY series_id, block ORDER BY split ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, block, split, round(coalesce(CASE WHEN p = q THEN pv ELSE pv + (qv - pv) * (split - p) / (q - p) END, pv, qv), 5) AS filled FROM k""")
def profile_interpolate(spark, d):
    holes = profile.scored(_conf(events(spark, d)), "accuracy").withColumn("score", F.when(F.col("split") % 3 == 0, F.col("score")))
    return rounded(profile.interpolated(holes.select("series_id", "block", "split", "score"), "score").select("series_id", "block", "split", "filled"), "filled", digits=5)


@query(_knn_sql(_E) + """, o AS (SELECT series_id, block, least(i, j) AS pos, 1 AS x FROM knn WHERE rank = 1 UNION ALL SELECT series_id, block, greatest(i, j), -1 FROM knn WHERE rank = 1), g AS (SELECT series_id, block, pos, sum(x) AS x FROM o GROUP BY ALL)
SELECT series_id, block::BIGINT AS block, pos::BIGINT AS pos, (sum(x) OVER (PARTITION BY series_id, block ORDER BY pos))::BIGINT AS arcs FROM g""")
def floss_arc_counts(spark, d):
    return profile.arcs(matrix.knn(events(spark, d), W, K, d=D)).select("series_id", "block", "pos", "arcs")


# Period estimators


def _suss_grid(x):
    span = x.max() - x.min()
    y = (x - x.min()) / (span or 1.0)
    w = [v for v in (16, 32, 64, 128) if v < len(x)]
    return {"w": w, "score": [round(periods.suss_score(y, v), 6) for v in w]}


@query(f"""WITH {_E}, {_BLK}, n AS (SELECT *, (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) AS x FROM b WINDOW p AS (PARTITION BY series_id, block)), g AS (SELECT series_id, block, avg(x) AS gm, stddev_pop(x) AS gs, max(x) - min(x) AS gr FROM n GROUP BY ALL), """ + ", ".join(f"""r{w} AS (SELECT series_id, block, {w} AS w, t, count(*) OVER f AS c, avg(x) OVER f AS m, stddev_pop(x) OVER f AS s, max(x) OVER f - min(x) OVER f AS r FROM n WINDOW f AS (PARTITION BY series_id, block ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))""" for w in (16, 32, 64, 128)) + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM r{w}" for w in (16, 32, 64, 128)) + """)
SELECT a.series_id, a.block::BIGINT AS block, w::BIGINT AS w, round(avg(sqrt((m - gm) ** 2 + (s - gs) ** 2 + (r - gr) ** 2) / sqrt(w)), 6) AS score FROM a JOIN g ON a.series_id = g.series_id AND a.block = g.block WHERE c = w AND t >= 1 GROUP BY ALL""")
def suss_score_grid(spark, d):
    return matrix.per_block(events(spark, d), _suss_grid, "w long, score double")


def _period(name):
    def f(spark, d):
        return matrix.per_block(events(spark, d), lambda x: {"period": [periods.ESTIMATORS[name](x)]}, "period long")

    return f


for _name, _as in (("suss", "suss_window"), ("fft", "fft_period"), ("acf", "acf_period"), ("mwf", "mwf_period")):
    QUERIES[_as] = _period(_name)


@query(f"""WITH {_E}, {_BLK}, c AS (SELECT *, value - avg(value) OVER p AS x, sum(1) OVER p AS n FROM b WINDOW p AS (PARTITION BY series_id, block)), v AS (SELECT series_id, block, sum(x * x) AS v FROM c GROUP BY ALL)
SELECT a.series_id, a.block::BIGINT AS block, (b.t - a.t)::BIGINT AS lag, round(sum(a.x * b.x) / max(v), 6) + 0.0 AS acf FROM c a JOIN c b ON a.series_id = b.series_id AND a.block = b.block AND b.t BETWEEN a.t AND a.t + a.n // 2 JOIN v ON v.series_id = a.series_id AND v.block = a.block GROUP BY ALL""")
def acf_values(spark, d):
    """Lags 0 .. n / 2 of each block."""
    f = lambda x: {"lag": range(len(x) // 2 + 1), "acf": periods.autocorrelation(x, len(x) // 2).round(6) + 0.0}
    return matrix.per_block(events(spark, d), f, "lag long, acf double")


def _dft(x):
    f, _, size = periods.spectrum(x)
    return {"f": f, "magnitude": size.round(3)}


@query(f"""WITH {_E}, {_BLK}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id, block) AS n FROM b), fs AS (SELECT DISTINCT series_id, block, unnest(range(1, (n - 1) // 2 + 1)) AS f FROM (SELECT DISTINCT series_id, block, n FROM n))
SELECT n.series_id, n.block::BIGINT AS block, f::BIGINT AS f, round(sqrt(sum(value * cos(2 * pi() * ((f * t) % n) / n)) ** 2 + sum(value * sin(2 * pi() * ((f * t) % n) / n)) ** 2), 3) AS magnitude FROM n JOIN fs ON n.series_id = fs.series_id AND n.block = fs.block GROUP BY ALL""")
def dft_magnitude(spark, d):
    """All positive frequencies of each block."""
    return matrix.per_block(events(spark, d), _dft, "f long, magnitude double")


@query()
def mwf_residual(spark, d):
    def f(x):
        w, r = periods.mwf_residuals(x)
        return {"w": w, "residual": r.round(6)}

    return matrix.per_block(events(spark, d), f, "w long, residual double")


# Detectors

_G = f"WITH {_E}, g AS (SELECT series_id, t - 99 AS split, count(*) OVER a AS n, var_pop(value) OVER a AS v, var_pop(value) OVER l AS x, var_pop(value) OVER r AS y FROM e WINDOW a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), l AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 199 PRECEDING AND 100 PRECEDING), r AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT series_id, split::BIGINT AS split, "


def _gain(kind, digits):
    def f(spark, d):
        return rounded(rolling.gains(events(spark, d), 100).select("series_id", "split", F.col(kind).alias("gain")), "gain", digits=digits).withColumn("gain", F.col("gain") + 0.0)

    return f


for _kind, _sql, _digits in (("l2", "2 * v - x - y", 3), ("normal", "2 * ln(greatest(v, 1e-12)) - ln(greatest(x, 1e-12)) - ln(greatest(y, 1e-12))", 5), ("mahalanobis", "2 - (x + y) / v", 5)):
    QUERIES[f"window_gain_{_kind}"] = _gain(_kind, _digits)
    ORACLES[f"window_gain_{_kind}"] = _G + f"round({_sql}, {_digits}) + 0.0 AS gain FROM g WHERE n = 200"

_SO_FAR = "(PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"WITH {_E}, m AS (SELECT *, avg(value) OVER {_SO_FAR} AS mean FROM e), c AS (SELECT *, sum(value - mean - 0.005) OVER {_SO_FAR} AS cum FROM m) SELECT series_id, t::BIGINT AS t, round(cum - min(cum) OVER {_SO_FAR}, 3) AS ph FROM c")
def page_hinkley(spark, d):
    return rounded(rolling.page_hinkley(events(spark, d)), "ph", digits=3)


_DRIFT = f"WITH {_E}, x AS (SELECT series_id, t, (value - min(value) OVER p) / greatest(max(value) OVER p - min(value) OVER p, 1e-12) AS x FROM e WINDOW p AS (PARTITION BY series_id)), p AS (SELECT *, avg(x) OVER {_SO_FAR} AS p FROM x), s AS (SELECT *, sqrt(greatest(p * (1 - p), 0) / (t + 1)) AS s FROM p)"


@query(_DRIFT + f" SELECT series_id, t::BIGINT AS t, round(p, 6) AS p, round(s, 6) AS s, round(min(p + s) OVER {_SO_FAR}, 6) AS least FROM s")
def ddm_stats(spark, d):
    return rounded(rolling.drift_statistics(events(spark, d)), "p", "s", "least", digits=6)


@query(_DRIFT + " SELECT series_id, t::BIGINT AS t, round(p, 6) AS p, round(sqrt(ln(1000) / (2.0 * (t + 1))), 6) AS bound FROM s")
def hddm_bounds(spark, d):
    return rounded(rolling.hoeffding_bounds(events(spark, d)), "p", "bound", digits=6)


@query()
def ewma_pair(spark, d):
    """Two forgetting averages of each point; sequential, so a kernel."""

    def start(_):
        state = [0.0, 0.0]

        def update(t, v):
            state[0] += 0.04 * (v - state[0])
            state[1] += 0.01 * (v - state[1])
            return [(t, round(state[0], 6), round(state[1], 6))]

        return update, lambda: []

    return run.in_order(events(spark, d), start, "series_id string, t long, fast double, slow double")


@query(f"""WITH RECURSIVE {_E}, a AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM e WHERE value > 150), r AS (SELECT series_id, k, t, t AS last, true AS keep FROM a WHERE k = 1 UNION ALL
SELECT a.series_id, a.k, a.t, CASE WHEN a.t - r.last > 5 THEN a.t ELSE r.last END, a.t - r.last > 5 FROM r JOIN a ON a.series_id = r.series_id AND a.k = r.k + 1) SELECT series_id, t::BIGINT AS cp FROM r WHERE keep""")
def suppress_alarms(spark, d):
    def start(_):
        last = [None]

        def update(t, v):
            if v > 150 and (last[0] is None or t - last[0] > 5):
                last[0] = t
                return [(t,)]
            return []

        return update, lambda: []

    return run.in_order(events(spark, d), start, "series_id string, cp long")


for _name in run.DETECTORS:
    QUERIES[f"detector_{_name.lower()}"] = lambda spark, d, name=_name: run.detect(events(spark, d), name)


@query()
def segmenter_batch(spark, d):
    return run.segment(injected(events(spark, d)), window_size=W, sample_size=None)


@query()
def segmenter_resampled(spark, d):
    """The default test, on labels drawn with replacement."""
    return run.segment(injected(events(spark, d)), window_size=W)


@query()
def segmenter_profile(spark, d):
    """The merged profile that each series ends with."""
    return run.merged_profile(injected(events(spark, d)), window_size=W, sample_size=None)


@query()
def segmenter_stream(spark, d):
    return run.replay_events(spark, f"{d}/events.parquet", window_size=W, p_value=1e-4, sample_size=None)


# Evaluation and reports: truth is the injected change point of a series, detections are the points above a level that open a new hundred.

_TRUTH = f"{_E}, n AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1), truth AS (SELECT series_id, n // 2 AS cp FROM n UNION ALL SELECT series_id, n // 4 FROM n), found AS (SELECT series_id, min(t) AS cp FROM e WHERE value > 200 GROUP BY series_id, t // 250)"


def _truth(spark, d):
    e = events(spark, d)
    n = e.groupBy("series_id").agg(F.count("*").alias("n"))
    half = lambda k: n.select("series_id", F.floor(F.col("n") / k).alias("cp"))
    found = e.where("value > 200").groupBy("series_id", F.floor(F.col("t") / 250).alias("_b")).agg(F.min("t").alias("cp")).select("series_id", "cp")
    return half(2).union(half(4)), found, n


@query(f"WITH {_TRUTH}, s AS (SELECT series_id, 0 AS s FROM n UNION SELECT series_id, cp FROM found WHERE cp > 0) SELECT s.series_id, s::BIGINT AS start, coalesce(lead(s) OVER (PARTITION BY s.series_id ORDER BY s), n)::BIGINT AS \"end\" FROM s JOIN n ON s.series_id = n.series_id")
def segments_from_cps(spark, d):
    _, found, n = _truth(spark, d)
    return evaluation.segments(found, n)


@query(f"""WITH {_TRUTH}, a0 AS (SELECT series_id, 0 AS s FROM n UNION SELECT series_id, cp FROM truth), a AS (SELECT a0.series_id, s, n, coalesce(lead(s) OVER (PARTITION BY a0.series_id ORDER BY s), n) AS e FROM a0 JOIN n ON a0.series_id = n.series_id),
b0 AS (SELECT series_id, 0 AS s FROM n UNION SELECT series_id, cp FROM found WHERE cp > 0), b AS (SELECT b0.series_id, s, coalesce(lead(s) OVER (PARTITION BY b0.series_id ORDER BY s), n) AS e FROM b0 JOIN n ON b0.series_id = n.series_id),
j AS (SELECT a.series_id, a.n, a.s, a.e, max((least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / (greatest(a.e, b.e) - least(a.s, b.s))) AS jac FROM a JOIN b ON a.series_id = b.series_id AND b.s < a.e AND a.s < b.e GROUP BY ALL)
SELECT series_id, round(sum((e - s) * jac) / max(n), 6) AS covering FROM j GROUP BY 1""")
def covering(spark, d):
    return rounded(evaluation.covering(*_truth(spark, d)), "covering", digits=6)


@query()
def f_measure(spark, d):
    return rounded(evaluation.f_measure(*_truth(spark, d)), "precision", "recall", "f1", digits=6)


@query(f"WITH {_TRUTH} SELECT truth.series_id, truth.cp::BIGINT AS cp, (min(found.cp) - truth.cp)::BIGINT AS delay FROM truth JOIN found ON truth.series_id = found.series_id AND found.cp >= truth.cp GROUP BY truth.series_id, truth.cp")
def detection_delay(spark, d):
    truth, found, _ = _truth(spark, d)
    return evaluation.delays(truth, found.withColumn("detected_at", F.col("cp")))


_METHODS = {"a": 7, "b": 11, "c": 13, "d": 17}
_SCORES = "sc AS (" + " UNION ALL ".join(f"SELECT user_id::VARCHAR AS dataset, '{k}' AS method, round(avg((event_id * {p}) % 10) / 10, 1) AS score FROM events GROUP BY 1" for k, p in _METHODS.items()) + ")"


def _scores(spark, d):
    e = table(spark, d, "events")
    listed = F.array(*[F.struct(F.lit(k).alias("method"), F.lit(p).alias("p")) for k, p in _METHODS.items()])
    x = e.select(F.col("user_id").cast("string").alias("dataset"), "event_id", F.explode(listed).alias("m"))
    return x.groupBy("dataset", F.col("m.method").alias("method")).agg(F.round(F.avg((F.col("event_id") * F.col("m.p")) % 10) / 10, 1).alias("score"))


@query(f"WITH {_SCORES} SELECT method, round(avg(score), 3) AS mean, round(median(score), 3) AS median, round(stddev_samp(score), 3) AS std, count(*) AS n FROM sc GROUP BY 1")
def param_grid_scores(spark, d):
    return evaluation.summary(_scores(spark, d))


@query(f"WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) AS rank FROM sc) SELECT method, round(avg(rank), 4) AS mean_rank, count(*) FILTER (rank = 1) AS wins FROM r GROUP BY 1")
def method_rank_wins(spark, d):
    return evaluation.rank_report(_scores(spark, d))


@query(f"WITH {_SCORES} SELECT a.method AS method_a, b.method AS method_b, count(*) FILTER (a.score > b.score) AS wins, count(*) FILTER (a.score = b.score) AS ties, count(*) FILTER (a.score < b.score) AS losses FROM sc a JOIN sc b ON a.dataset = b.dataset AND a.method <> b.method GROUP BY 1, 2")
def pairwise_wtl(spark, d):
    return evaluation.pairwise(_scores(spark, d))


@query(f"WITH {_SCORES} SELECT count(DISTINCT method) AS k, count(DISTINCT dataset) AS n, round(2.569 * sqrt(4 * 5 / (6.0 * count(DISTINCT dataset))), 6) AS cd FROM sc")
def critical_difference(spark, d):
    return rounded(evaluation.critical_difference(_scores(spark, d)), "cd", digits=6)


@query(f"WITH {_SCORES} SELECT method, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1")
def boxplot_stats(spark, d):
    return _scores(spark, d).groupBy("method").agg(F.percentile("score", 0.25).alias("q1"), F.percentile("score", 0.75).alias("q3"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query("""WITH x AS (SELECT user_id, count(*)::DOUBLE AS n, sum(value) AS y FROM events GROUP BY 1), r AS (SELECT regr_slope(y, n) AS slope, regr_intercept(y, n) AS intercept FROM x)
SELECT round(max(slope), 4) AS slope, round(max(intercept), 3) AS intercept, round(avg(abs(1 - (slope * n + intercept) / y)), 5) AS deviation FROM x, r""")
def runtime_regression(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("y"))
    r = x.agg(F.regr_slope("y", "n").alias("slope"), F.regr_intercept("y", "n").alias("intercept"))
    out = x.join(F.broadcast(r)).agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.avg(F.abs(1 - (F.col("slope") * F.col("n") + F.col("intercept")) / F.col("y"))).alias("deviation"))  # r is one row
    return rounded(rounded(rounded(out, "slope"), "intercept", digits=3), "deviation", digits=5)


@query(f"WITH {_E}, n AS (SELECT series_id, max(t) // 2 AS c FROM e GROUP BY 1) SELECT e.series_id, t::BIGINT AS t, least(greatest(value / 100, 0), 1) AS clipped FROM e JOIN n ON e.series_id = n.series_id WHERE t BETWEEN c - 500 AND c + 500")
def clipped_cut(spark, d):
    e = events(spark, d)
    c = F.floor(F.max("t").over(Window.partitionBy("series_id")) / 2)
    return e.withColumn("_c", c).where(F.abs(F.col("t") - F.col("_c")) <= 500).select("series_id", "t", F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("clipped"))


@query(f"WITH {_E} SELECT series_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, series_id) AS place FROM e GROUP BY 1")
def ordered_by_length(spark, d):
    n = events(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "series_id")).cast("long"))
