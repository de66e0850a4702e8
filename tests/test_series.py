"""Kernels against naive definitions, golden metric values, batch against stream, and oracles on the smallest tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators import evaluation, matrix, periods, profile
from riftline.operators.detectors import DETECTORS
from riftline.operators.segmenter import Segmenter, rank_sum, split_counts
from riftline.streaming import run

SF = "/root/testdata/sf0.001"


def two_regimes(n=2000):
    """With a little noise: without any, neighbours of all periods tie, and the rule for ties decides."""
    t = np.arange(n)
    return 0.1 * np.random.RandomState(7).randn(n) + np.where(t < n // 2, np.sin(2 * np.pi * t / 20), np.sin(2 * np.pi * t / 50))


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_split_counts_are_the_confusion_of_majority_labels(k):
    rs, n, w = np.random.RandomState(k), 60, 4
    near = rs.randint(0, n, (n, k))
    tp, fp, fn, tn = split_counts(np.sort(near, axis=1)[:, k - 1 - k // 2], w)
    for s in range(n - w):
        pred = (near >= s).sum(1) > (near < s).sum(1)
        left, right = pred[:s], pred[s + w :]
        assert (tp[s], fn[s], fp[s], tn[s]) == ((~left).sum(), left.sum(), (~right).sum(), right.sum())


def test_rank_sum_thresholds():
    assert abs(rank_sum(50, 50, 0, 50)[0]) == pytest.approx(8.61727, abs=1e-4)
    assert abs(rank_sum(500, 500, 0, 500)[0]) == pytest.approx(27.37245, abs=1e-4)
    assert math.erfc(14.97948 / math.sqrt(2)) == pytest.approx(1e-50, rel=1e-3)


@pytest.mark.parametrize("similarity", ["pearson", "ed", "cid"])
def test_knn_against_all_pairs(similarity):
    x, w, k = np.random.RandomState(1).randn(80), 8, 3
    near, dist = matrix.knn_arrays(x, w, k, similarity)
    n = len(x) - w + 1
    steps = np.r_[0, np.diff(x) ** 2]
    for i in range(n):
        d = []
        for j in range(n):
            a, b = x[i : i + w], x[j : j + w]
            if similarity == "pearson":
                v = (((a - a.mean()) / a.std() - (b - b.mean()) / b.std()) ** 2).sum()
            else:
                v = ((a - b) ** 2).sum()
                if similarity == "cid":
                    p, q = steps[i : i + w].sum() + 1e-5, steps[j : j + w].sum() + 1e-5
                    v *= max(p, q) / min(p, q)
            d.append(math.inf if i - w // 2 <= j < i + w // 2 else round(v, 6))
        assert np.allclose(sorted(d)[:k], dist[i], atol=2e-6)


def test_segmenter_finds_the_regime():
    s = Segmenter(window_size=20)
    for v in two_regimes():
        s.update(v)
    assert [abs(c[0] - 1000) < 40 for c in s.change_points] == [True]
    noise = Segmenter(window_size=20)
    for v in np.random.RandomState(0).randn(1500):
        noise.update(v)
    assert noise.change_points == []


class Plain(Segmenter):
    """Distances by their definitions, for every point anew; neighbours and their reverse updates by sorting."""

    def _distances(self, i, lo, hi):
        y, w = self.x + self.shift, self.w
        cut = lambda j: y[j - self.base : j - self.base + w]
        q, out = cut(i), []
        for j in range(lo, hi):
            v = cut(j)
            if self.similarity == "pearson":
                out.append((((q - q.mean()) / max(q.std(), 1e-3) - (v - v.mean()) / max(v.std(), 1e-3)) ** 2).sum())
                continue
            e = ((q - v) ** 2).sum()
            if self.similarity == "cid":
                a, b = ((np.diff(y[max(t - self.base - 1, 0) : t - self.base + w]) ** 2).sum() + 1e-5 for t in (i, j))
                e *= max(a, b) / min(a, b)
            out.append(e)
        return np.array(out)

    def _reverse(self, i, lo, dist):
        for j in range(lo, i):
            cell = j - self.base
            if dist[j - lo] < self.dist[self.k - 2, cell]:
                rows = sorted([*zip(self.dist[:, cell], range(self.k), self.near[:, cell], strict=True), (dist[j - lo], self.k, i)])[: self.k]
                self.dist[:, cell], self.near[:, cell] = [r[0] for r in rows], [r[2] for r in rows]
                self._decide(np.array([cell]))


@pytest.mark.parametrize("similarity", ["pearson", "ed", "cid"])
def test_segmenter_equals_plain_kernel(similarity):
    """Over refreshed products, moved arrays, a window that slides, and values far from zero."""
    rs, n = np.random.RandomState(11), 1300
    t = np.arange(n)
    x = 1e4 + 0.2 * rs.randn(n) + np.sin(2 * np.pi * t / np.where(t % 700 < 350, 10, 23))
    config = {"d": 250, "window_size": 10, "similarity": similarity, "p_value": 1e-6, "sample_size": None}
    fast, plain = Segmenter(**config), Plain(**config)
    fast.REFRESH = 128
    for v in x:
        fast.update(v)
        plain.update(v)
    assert [c[0::3] for c in fast.change_points] == [c[0::3] for c in plain.change_points] and fast.change_points
    held = slice(fast.segment - fast.base, fast.n - fast.lag - fast.base)
    assert (fast.near[:, held] == plain.near[:, held]).all() and np.allclose(fast.dist[:, held], plain.dist[:, held], atol=1e-6)
    assert dict(fast.merged_profile()) == pytest.approx(dict(plain.merged_profile()))


def test_sample_of_100_cannot_pass():
    s = Segmenter(window_size=20, sample_size=100)
    for v in two_regimes():
        s.update(v)
    assert s.change_points == []


def test_estimators():
    x = np.sin(2 * np.pi * np.arange(2000) / 50)
    assert periods.fft_period(x) == 50 and periods.acf_period(x) == 50 and abs(periods.mwf_period(x) - 50) <= 2
    assert periods.suss(np.full(100, 5.0)) == periods.LEAST
    for n in (1, 5, 16, 100):
        short = np.random.RandomState(n).randn(n)
        assert all(f(short) >= periods.LEAST or f(short) > 0 for f in periods.ESTIMATORS.values())


@pytest.mark.parametrize("name", ["PageHinkley", "HDDM", "ADWIN", "BOCD", "ChangeFinder", "Window"])
def test_detectors_find_a_large_shift(name):
    rs = np.random.RandomState(3)
    x = np.r_[rs.randn(1500) * 0.1, 60 + rs.randn(1500) * 0.1]
    config = {"HDDM": {"drift_confidence": 1e-6}, "Window": {"cost_func": "l2"}}.get(name, {})
    d = DETECTORS[name](**config)
    for v in x:
        d.update(v)
    assert any(1480 <= c <= 1700 for c in d.change_points), d.change_points[:5]


def frames(spark, truth, found, n):
    return (
        spark.createDataFrame(truth or [], "series_id string, annotator int, cp long"),
        spark.createDataFrame([("s", c) for c in found], "series_id string, cp long"),
        spark.createDataFrame([("s", n)], "series_id string, n long"),
    )


GOLDEN = [({1: [10, 20], 2: [11, 20], 3: [10], 4: [0, 5]}, [10, 20], 1.0), ({1: [], 2: [10], 3: [50]}, [10], 10 / 11), ({1: [], 2: [10], 3: [50]}, [], 0.8)]


@pytest.mark.parametrize("truth,found,expected", GOLDEN)
def test_f_measure(spark, truth, found, expected):
    rows = [("s", a, c) for a, cps in truth.items() for c in cps]
    who = spark.createDataFrame([("s", a) for a in truth], "series_id string, annotator int")
    f1 = evaluation.f_measure(*frames(spark, rows, found, 500), annotators=who).first()["f1"]
    assert f1 == pytest.approx(expected)


def test_f_measure_without_change_points_is_one(spark):
    assert evaluation.f_measure(*frames(spark, [], [], 100)).first()["f1"] == 1.0


def test_covering_equals_its_set_definition(spark):
    n, truth, found = 45, [10, 20, 31], [9, 25]
    cut = lambda cps: [set(range(a, b)) for a, b in zip([0, *cps], [*cps, n], strict=True)]
    expected = sum(len(r) * max(len(r & s) / len(r | s) for s in cut(found)) for r in cut(truth)) / n
    got = evaluation.covering(*frames(spark, [("s", 0, c) for c in truth], found, n)).first()["covering"]
    assert got == pytest.approx(expected)


def test_stream_equals_batch_for_any_split(spark, tmp_path):
    x = two_regimes(1200)
    points = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, t long, value double")
    batch = run.segment(points, window_size=20).toPandas()
    assert len(batch) >= 1
    for parts in (1, 5):
        source = tmp_path / f"in{parts}"
        for i in range(parts):
            (points.where(f"t >= {i * 1200 // parts} AND t < {(i + 1) * 1200 // parts}").selectExpr("series_id", "t AS at", "value").coalesce(1).write.mode("append").parquet(str(source)))
        stream = spark.readStream.schema("series_id string, at long, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
        out = str(tmp_path / f"out{parts}")
        q = run.segment_stream(stream, window_size=20).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}.state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(out).toPandas()[["cp", "detected_at"]].values.tolist() == batch[["cp", "detected_at"]].values.tolist()


def test_split_at_the_edge_of_blocks(spark):
    """Blocks overlap: a change at a multiple of d lies in the middle of one, and each split belongs to one block."""
    points = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(two_regimes(2400))], "series_id string, t long, value double")
    d = 1200
    found = matrix.knn(points, 20, 3, d=d)
    assert sorted(r["block"] for r in found.select("block").distinct().collect()) == [0, 1, 2]
    conf = profile.owned(profile.confusion(profile.majority(found, 3), 20), points, d)
    splits = conf.select((F.col("block") * (d // 2) + F.col("split")).alias("cp")).toPandas()["cp"]
    assert splits.is_unique and splits.min() == 100 and splits.max() >= 2200
    best = profile.best_split(profile.scored(conf)).orderBy(F.desc("score")).first()
    assert best["block"] == 1 and abs(best["block"] * (d // 2) + best["split"] - 1200) < 40


def test_critical_difference_of_many_methods(spark):
    for k, q in ((2, 1.960), (10, 3.164), (14, 3.354)):
        assert evaluation.nemenyi(k) == pytest.approx(q, abs=2e-3)
    rows = spark.createDataFrame([(f"d{i}", f"m{j}", float(i * j % 7)) for i in range(5) for j in range(14)], "dataset string, method string, score double")
    assert evaluation.critical_difference(rows).first()["k"] == 14


def test_profile_by_events_equals_kernel(spark):
    x = two_regimes(600)
    points = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, t long, value double")
    m = profile.majority(matrix.knn(points, 20, 3), 3)
    conf = profile.confusion(m, 20).orderBy("split").toPandas()
    tp, fp, fn, tn = split_counts(m.orderBy("i").toPandas()["m"].to_numpy(), 20)
    at = conf["split"].to_numpy()
    assert (conf["tp"].to_numpy() == tp[at]).all() and (conf["tn"].to_numpy() == tn[at]).all()


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    from riftline.plans import catalogue

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ("series_from_events", "rolling_mean_std", "dist_pearson", "best_split", "significant_cp", "covering", "method_rank_wins", "suppress_alarms"):
        got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
        columns = sorted(got.columns)
        rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))  # noqa: B023, E731
        assert rows(got) == rows(want), name


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "best_split" in e.queries()


def test_holes_are_filled_in_frames_that_grow(spark):
    """Frames that end with the partition cost the square of a block."""
    rs = np.random.RandomState(3)
    want, rows = [], []
    for block, n in ((0, 1), (1, 40), (2, 9)):
        v = [float(x) if block < 2 and rs.rand() < 0.3 else None for x in rs.rand(n)]
        rows += [("a", block, 5 + i, v[i]) for i in range(n)]
        known = [i for i in range(n) if v[i] is not None]
        want += [(block, 5 + i, float(np.interp(i, known, [v[j] for j in known])) if known else None) for i in range(n)]
    out = profile.interpolated(spark.createDataFrame(rows, "series_id string, block long, split long, score double"), "score")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {(r["block"], r["split"]): r["filled"] for r in out.collect()}
    assert len(got) == len(want) and all(got[b, s] == (None if f is None else pytest.approx(f, abs=1e-12)) for b, s, f in want)
