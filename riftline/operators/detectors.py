"""Classical online detectors behind one protocol: update(x) returns an alarm position or None, and sets ``profile``.

Each follows its paper. Alarms closer than ``excl_factor`` points to the last one are suppressed. Positions count from 0.
"""

from __future__ import annotations

import math

import numpy as np


class Detector:
    def __init__(self, excl_factor: int = 5):
        self.excl_factor, self.n, self.profile = excl_factor, 0, 0.0
        self.change_points: list[int] = []

    def alarm(self, x: float) -> bool:
        raise NotImplementedError

    def update(self, x: float) -> int | None:
        self.n += 1
        if not self.alarm(float(x)):
            return None
        at = self.n - 1
        if self.change_points and abs(self.change_points[-1] - at) <= self.excl_factor:
            return None
        self.change_points.append(at)
        return at


class PageHinkley(Detector):
    """Page 1954."""

    def __init__(self, threshold: float = 50, min_instances: int = 100, delta: float = 0.005, **kw):
        super().__init__(**kw)
        self.threshold, self.least, self.delta = threshold, min_instances, delta
        self.reset()

    def reset(self):
        self.m, self.mean, self.sum, self.low = 0, 0.0, 0.0, math.inf

    def alarm(self, x):
        self.m += 1
        self.mean += (x - self.mean) / self.m
        self.sum += x - self.mean - self.delta
        self.low = min(self.low, self.sum)
        self.profile = self.sum - self.low
        if self.m >= self.least and self.profile > self.threshold:
            self.reset()
            return True
        return False


class DDM(Detector):
    """Gama et al. 2004, on the values themselves."""

    def __init__(self, out_control_level: float = 20, min_num_instances: int = 100, **kw):
        super().__init__(**kw)
        self.level, self.least = out_control_level, min_num_instances
        self.reset()

    def reset(self):
        self.m, self.p, self.best = 0, 0.0, (math.inf, 0.0, 0.0)

    def alarm(self, x):
        self.m += 1
        self.p += (x - self.p) / self.m
        s = math.sqrt(max(self.p * (1 - self.p), 0.0) / self.m)
        self.profile = self.p
        if self.m < self.least:
            return False
        if self.p + s <= self.best[0]:
            self.best = (self.p + s, self.p, s)
        if self.p + s > self.best[1] + self.level * self.best[2] and self.best[2] > 0:
            self.reset()
            return True
        return False


class HDDM(Detector):
    """Frias-Blanco et al. 2015, test of averages (A-test); values are scaled by the range seen."""

    def __init__(self, drift_confidence: float = 1e-60, **kw):
        super().__init__(**kw)
        self.log = math.log(1 / drift_confidence)
        self.reset()

    def reset(self):
        self.m, self.sum, self.low_n, self.low_sum, self.range = 0, 0.0, 0, 0.0, [math.inf, -math.inf]

    def alarm(self, x):
        self.range = [min(self.range[0], x), max(self.range[1], x)]
        self.m, self.sum = self.m + 1, self.sum + x
        span = max(self.range[1] - self.range[0], 1e-12)
        self.profile = self.sum / self.m
        bound = lambda n: span * math.sqrt(self.log / (2 * n))
        if not self.low_n or self.profile + bound(self.m) <= self.low_sum / self.low_n + bound(self.low_n):
            self.low_n, self.low_sum = self.m, self.sum
        n2 = self.m - self.low_n
        if n2:
            eps = span * math.sqrt(n2 / (2 * self.low_n * self.m) * self.log)
            if self.profile - self.low_sum / self.low_n >= eps:
                self.reset()
                return True
        return False


class ADWIN(Detector):
    """Bifet and Gavalda 2007: buckets of an exponential histogram; the window drops its older part where means differ."""

    def __init__(self, delta: float = 0.01, per_row: int = 5, every: int = 32, **kw):
        super().__init__(**kw)
        self.delta, self.per_row, self.every = delta, per_row, every
        self.rows: list[list[tuple[int, float, float]]] = [[]]  # newest first; (n, sum, squared deviations)

    def alarm(self, x):
        self.rows[0].insert(0, (1, x, 0.0))
        for i in range(len(self.rows)):
            if len(self.rows[i]) <= self.per_row:
                break
            (n1, s1, v1), (n2, s2, v2) = self.rows[i].pop(), self.rows[i].pop()
            if i + 1 == len(self.rows):
                self.rows.append([])
            self.rows[i + 1].insert(0, (n1 + n2, s1 + s2, v1 + v2 + n1 * n2 / (n1 + n2) * (s1 / n1 - s2 / n2) ** 2))
        if self.n % self.every:
            return False
        found = False
        while self._cut():
            found = True
        return found

    def _cut(self) -> bool:
        buckets = [b for row in self.rows for b in row]
        n, s = sum(b[0] for b in buckets), sum(b[1] for b in buckets)
        var = max(sum(b[2] + b[0] * (b[1] / b[0] - s / n) ** 2 for b in buckets) / n, 0.0)
        self.profile = var
        if n < 10:
            return False
        log, n1, s1 = math.log(2 * math.log(n) / self.delta), 0, 0.0
        for b in buckets[:-1]:
            n1, s1 = n1 + b[0], s1 + b[1]
            n0 = n - n1
            if min(n0, n1) < 5:
                continue
            inv = 1 / n0 + 1 / n1
            if abs((s - s1) / n0 - s1 / n1) > math.sqrt(2 * inv * var * log) + 2 / 3 * inv * log:
                while self.rows and not self.rows[-1]:
                    self.rows.pop()
                self.rows[-1].pop()
                return True
        return False


class BOCD(Detector):
    """Adams and MacKay 2007 with a normal-inverse-gamma prior; an alarm is a fall of the most likely run length by -threshold."""

    def __init__(self, threshold: float = -150, hazard: float = 1 / 100, longest: int = 2000, **kw):
        super().__init__(**kw)
        self.threshold, self.hazard, self.longest = threshold, hazard, longest
        self.log = np.zeros(1)
        self.mu, self.kappa, self.alpha, self.beta = (np.array([v]) for v in (0.0, 1.0, 1.0, 1.0))
        self.last = 0

    def alarm(self, x):
        scale = self.beta * (self.kappa + 1) / (self.alpha * self.kappa)
        lg = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in (self.alpha[0], self.alpha[-1])]) if len(self.alpha) < 3 else None
        gamma = lg[[0, -1]][: len(self.alpha)] if lg is not None else 0.5 * np.log(self.alpha) - 1 / (8 * self.alpha)
        like = gamma - 0.5 * np.log(2 * np.pi * self.alpha * scale) - (self.alpha + 0.5) * np.log1p((x - self.mu) ** 2 / (2 * self.alpha * scale))
        grown = self.log + like + math.log(1 - self.hazard)
        fresh = np.logaddexp.reduce(self.log + like) + math.log(self.hazard)
        log = np.r_[fresh, grown]
        self.log = log - np.logaddexp.reduce(log)
        add = lambda first, rest: np.r_[first, rest]
        self.beta = add(1.0, self.beta + self.kappa * (x - self.mu) ** 2 / (2 * (self.kappa + 1)))
        self.mu = add(0.0, (self.kappa * self.mu + x) / (self.kappa + 1))
        self.kappa, self.alpha = add(1.0, self.kappa + 1), add(1.0, self.alpha + 0.5)
        if len(self.log) > self.longest:
            self.log, self.mu, self.kappa, self.alpha, self.beta = (a[: self.longest] for a in (self.log, self.mu, self.kappa, self.alpha, self.beta))
        run = int(self.log.argmax())
        self.profile = float(run - self.last)
        self.last = run
        return self.profile <= self.threshold


class ChangeFinder(Detector):
    """Takeuchi and Yamanishi 2006: two sequentially discounting autoregressions, of values and of smoothed losses."""

    def __init__(self, threshold: float = 50, r: float = 0.01, smooth: int = 7, **kw):
        super().__init__(**kw)
        self.threshold, self.smooth, self.r = threshold, smooth, r
        self.stages = [{"mu": 0.0, "c0": 1.0, "c1": 0.0, "last": 0.0, "var": 1.0} for _ in range(2)]
        self.first, self.second = [], []

    def _loss(self, s: dict, x: float) -> float:
        """Minus the log density of x as foreseen before x, then discounted learning."""
        r = self.r
        guess = s["mu"] + (s["c1"] / s["c0"] if s["c0"] > 1e-12 else 0.0) * (s["last"] - s["mu"])
        loss = 0.5 * math.log(2 * math.pi * s["var"]) + (x - guess) ** 2 / (2 * s["var"])
        s["mu"] += r * (x - s["mu"])
        a, b = x - s["mu"], s["last"] - s["mu"]
        s["c0"], s["c1"] = (1 - r) * s["c0"] + r * a * a, (1 - r) * s["c1"] + r * a * b
        s["var"] = max((1 - r) * s["var"] + r * (x - guess) ** 2, 1e-12)
        s["last"] = x
        return loss

    def alarm(self, x):
        self.first = (self.first + [self._loss(self.stages[0], x)])[-self.smooth :]
        self.second = (self.second + [self._loss(self.stages[1], sum(self.first) / len(self.first))])[-self.smooth :]
        self.profile = sum(self.second) / len(self.second)
        return self.n > 2 * self.smooth and self.profile >= self.threshold


class NEWMA(Detector):
    """Keriven et al. 2020: distance of two forgetting averages of random features, against an adaptive quantile."""

    def __init__(self, window_size: int = 100, thresholding_quantile: float = 1.0, features: int = 16, **kw):
        super().__init__(**kw)
        rs = np.random.RandomState(2357)
        self.fast, self.slow, self.q = 4 / window_size, 1 / window_size, thresholding_quantile
        self.omega, self.phase = rs.randn(features) / 10, rs.rand(features) * 2 * np.pi
        self.a, self.b = np.zeros(features), np.zeros(features)
        self.history, self.least = [0.0] * (5 * window_size), window_size

    def alarm(self, x):
        z = np.cos(self.omega * x + self.phase) * math.sqrt(2 / len(self.omega))
        self.a += self.fast * (z - self.a)
        self.b += self.slow * (z - self.b)
        self.profile = float(np.linalg.norm(self.a - self.b))
        level = float(np.quantile(self.history, self.q))
        self.history = self.history[1:] + [self.profile]
        return self.q < 1.0 and self.n > self.least and self.profile > level


def cost(x: np.ndarray, kind: str) -> float:
    """Truong et al. 2020."""
    if kind == "l1":
        return float(np.abs(x - np.median(x)).sum())
    if kind == "normal":
        return len(x) * math.log(max(x.var(), 1e-12))
    if kind == "ar":
        if len(x) < 6:
            return 0.0
        lagged = np.c_[np.ones(len(x) - 4), *(x[4 - i : len(x) - i] for i in range(1, 5))]
        beta = np.linalg.lstsq(lagged, x[4:], rcond=None)[0]
        return float(((x[4:] - lagged @ beta) ** 2).sum())
    return float(((x - x.mean()) ** 2).sum())


class Window(Detector):
    def __init__(self, window_size: int = 20, cost_func: str = "ar", threshold: float = 0.2, **kw):
        super().__init__(**kw)
        self.width, self.kind, self.threshold = 5 * window_size, cost_func, threshold
        self.x: list[float] = []

    def update(self, x):
        self.n += 1
        self.x = (self.x + [float(x)])[-2 * self.width :]
        if len(self.x) < 2 * self.width:
            return None
        v = np.array(self.x)
        if self.kind == "rank":
            v = v.argsort(kind="stable").argsort(kind="stable") / len(v)
        if self.kind == "mahalanobis":
            v = v / max(v.std(), 1e-12)
        self.profile = (cost(v, self.kind) - cost(v[: self.width], self.kind) - cost(v[self.width :], self.kind)) / self.width
        at = self.n - self.width
        if not self.profile >= self.threshold or any(abs(c - at) <= self.width for c in self.change_points):
            return None
        self.change_points.append(at)
        return at


class FLOSS(Detector):
    """Gharghabi et al. 2017: few nearest-neighbour arcs pass over a boundary. Evaluated whenever a tenth of the buffer is new."""

    def __init__(self, window_size: int = 20, threshold: float = 0.45, buffer: int = 2000, **kw):
        super().__init__(**kw)
        self.w, self.threshold, self.size, self.x = max(3, window_size), threshold, buffer, []

    def update(self, x):
        self.n += 1
        self.x = (self.x + [float(x)])[-self.size :]
        if len(self.x) < 20 * self.w or self.n % max(1, self.size // 10):
            return None
        from riftline.operators.matrix import knn_arrays

        near = knn_arrays(np.array(self.x), self.w, 1)[0][:, 0]
        n, i = len(near), np.arange(len(near))
        lo, hi = np.minimum(i, near)[near >= 0], np.maximum(i, near)[near >= 0]
        arcs = np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n))
        cac = np.minimum(arcs / np.maximum(2.0 * i * (n - i) / n, 1e-12), 1.0)
        cac[: 5 * self.w] = cac[n - 5 * self.w :] = 1.0
        self.profile = float(cac.min())
        at = self.n - len(self.x) + int(cac.argmin())
        if self.profile > self.threshold or any(abs(c - at) <= self.excl_factor * self.w for c in self.change_points):
            return None
        self.change_points.append(at)
        return at


DETECTORS = {c.__name__: c for c in (PageHinkley, DDM, HDDM, ADWIN, BOCD, ChangeFinder, NEWMA, Window, FLOSS)}
