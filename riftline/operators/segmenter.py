"""The incremental segmenter, in absolute indices: k nearest neighbours of each new subsequence, a classification profile of the open segment, a rank-sum test."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from riftline.operators.matrix import windows_of
from riftline.operators.periods import ESTIMATORS


def f1_score(tp, fp, fn, tn):
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = 2 * tp / (2 * tp + fp + fn), 2 * tn / (2 * tn + fp + fn)
    return np.where((tp > 0) & (tn > 0), (a + b) / 2, -np.inf)


def accuracy_score(tp, fp, fn, tn):
    total = tp + fp + fn + tn
    return np.where(total > 0, (tp + tn) / np.maximum(total, 1), -np.inf)


SCORES: dict[str, Callable] = {"f1": f1_score, "accuracy": accuracy_score}


def split_counts(m: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
    """tp, fp, fn, tn of every split 0 .. n - 1 of rows with majority neighbours m."""
    n = len(m)
    i, s = np.arange(n), np.arange(n)
    tp = np.cumsum(np.bincount(np.maximum(i, m) + 1, minlength=n + 1))[:n]
    wide = m < i - w
    step = np.bincount(m[wide] + 1, minlength=n + 1)[: n + 1] - np.bincount(i[wide] - w + 1, minlength=n + 1)[: n + 1]
    fp = np.cumsum(step)[:n]
    return tp, fp, s - tp, n - s - w - fp


def rank_sum(zeros_left: int, n1: int, zeros_right: int, n2: int) -> tuple[float, float]:
    if min(n1, n2) < 1:
        return 0.0, 1.0
    z = 0.5 * ((n1 - zeros_left) * zeros_right - zeros_left * (n2 - zeros_right)) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return z, math.erfc(abs(z) / math.sqrt(2))


class Segmenter:
    """update(x) for each point; change_points holds (cp, score, p, detected_at), all counted from 0; merged_profile() the profile of the points held.

    window_size: a number, or the name of an estimator that sees the first n_prerun points. State is bounded by d; it can be pickled at any time.
    A point costs O(d): dot products follow from those of the subsequence before, and are computed anew every REFRESH points, so errors do not add up.
    """

    REFRESH = 1024

    def __init__(self, d: int = 10_000, n_prerun: int | None = None, window_size: int | str = "suss", k: int = 3, score: str = "f1", jump: int | None = 5, p_value: float = 1e-50, sample_size: int | None = 1000, similarity: str = "pearson", profile_mode: str = "global"):
        self.d, self.k, self.score, self.jump, self.p_value, self.sample_size, self.similarity, self.mode = d, k, score, jump, p_value, sample_size, similarity, profile_mode
        self.window_size = window_size
        self.n_prerun = 1 if isinstance(window_size, int) else (n_prerun or d)
        self.buffer: list[float] = []
        self.w = 0
        self.n = 0
        self.change_points: list[tuple[int, float, float, int]] = []

    def _start(self) -> None:
        width = self.window_size if isinstance(self.window_size, int) else ESTIMATORS[self.window_size](np.array(self.buffer))
        self.w = max(3, int(width))
        self.r = self.w // 2
        self.lag = self.w + self.r + self.k
        self.jump = self.jump or max(1, self.r)
        size = 2 * (self.d + 2 * self.lag)
        self.shift = self.buffer[0]  # points and means are held less this value
        self.x, self.mean, self.sd, self.ss, self.ce = (np.zeros(size) for _ in range(5))
        self.near, self.dist = np.full((self.k, size), -1, np.int64), np.full((self.k, size), np.inf)
        self.major = np.full(size, -1, np.int64)  # the neighbour that decides the majority of a row
        self.merged = np.full(size, np.nan, np.float32)
        self.base = 0  # absolute index of cell 0
        self.segment = 0
        self.dot, self.dot_of, self.dot_lo = np.empty(0), -2, 0

    def _make_room(self) -> None:
        if self.n - self.base >= len(self.x):
            keep = self.d + 2 * self.lag
            gone = self.n - keep - self.base
            for a, empty in ((self.x, 0), (self.mean, 0), (self.sd, 0), (self.ss, 0), (self.ce, 0), (self.near, -1), (self.dist, np.inf), (self.major, -1), (self.merged, np.nan)):
                a[..., :keep] = a[..., gone : gone + keep].copy()
                a[..., keep:] = empty
            self.base += gone

    def flush(self) -> None:
        """Start with what is there, when a series ends before n_prerun points."""
        if not self.w and self.buffer:
            self.n_prerun = len(self.buffer)
            self._replay()

    def _replay(self) -> None:
        self._start()
        held, self.buffer = self.buffer, []
        for v in held:
            self._point(v)

    def update(self, value: float) -> list[tuple[int, float, float, int]]:
        """The change points that this value brings."""
        before = len(self.change_points)
        if self.w:
            self._point(value)
        else:
            self.buffer.append(float(value))
            if len(self.buffer) >= self.n_prerun:
                self._replay()
        return self.change_points[before:]

    def merged_profile(self) -> list[tuple[int, float]]:
        """(split, score) of the splits scored among the points held, ascending."""
        if not self.w:
            return []
        at = np.flatnonzero(~np.isnan(self.merged))
        return list(zip((at + self.base).tolist(), self.merged[at].astype(float).tolist(), strict=True))

    def _recentre(self) -> None:
        """Hold the points less their mean, so that products of large values do not cancel."""
        held = self.n - self.base
        by = self.x[max(0, held - self.d) : held].mean()
        self.shift += by
        self.x[:held] -= by
        self.mean[: max(0, held - self.w + 1)] -= by
        self.dot_of = -2

    def _add(self, value: float) -> None:
        """Take the point in, with the statistics of the subsequence that it ends."""
        at, w = self.n - self.base, self.w
        self.x[at] = value - self.shift
        self.n += 1
        j = at - w + 1
        if j < 0:
            return
        v = self.x[j : at + 1]
        self.mean[j] = mean = v.sum() / w
        c = v - mean
        self.ss[j] = ss = c @ c
        sd = math.sqrt(ss / w)
        self.sd[j] = sd if sd >= 1e-3 else 1.0
        if self.similarity == "cid":
            self.ce[j] = (np.diff(self.x[max(j - 1, 0) : at + 1]) ** 2).sum() + 1e-5

    def _dots(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Products of subsequence i with lo .. hi - 1: each is that of both predecessors, less the points left, plus the points taken in."""
        w, b, x = self.w, self.base, self.x
        q = x[i - b : i - b + w]
        if self.dot_of == i - 1 and self.dot_lo <= lo < self.dot_lo + len(self.dot):
            first = max(lo, self.dot_lo + 1)
            dot = np.empty(hi - lo)
            rest = dot[first - lo :]
            np.multiply(x[first - b + w - 1 : hi - b + w - 1], q[-1], out=rest)
            rest -= x[first - b - 1 : hi - b - 1] * x[i - b - 1]
            rest += self.dot[first - 1 - self.dot_lo : hi - 1 - self.dot_lo]
            if first > lo:
                dot[0] = q @ x[lo - b : lo - b + w]
        else:
            dot = windows_of(x[lo - b : hi - b + w - 1], w) @ q
        self.dot, self.dot_of, self.dot_lo = dot, i, lo
        return dot

    def _distances(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Of subsequence i to subsequences lo .. hi - 1."""
        w, at, cells = self.w, i - self.base, slice(lo - self.base, hi - self.base)
        dot, mean = self._dots(i, lo, hi), self.mean[cells]
        if self.similarity == "pearson":
            out = mean * (-w * self.mean[at])
            out += dot
            out /= self.sd[cells]
            out *= -2 / self.sd[at]
            out += 2 * w
            return out
        square = lambda c: self.ss[c] + w * self.mean[c] ** 2
        out = square(cells) + square(at) - 2 * dot
        if self.similarity == "ed":
            return out
        ce, own = self.ce[cells], self.ce[at]
        return out * np.maximum(ce, own) / np.minimum(ce, own)

    def _point(self, value: float) -> None:
        self._make_room()
        self._add(value)
        if self.n % self.REFRESH == 0:
            self._recentre()
        if self.n < self.lag:
            return
        i = self.n - self.lag
        oldest = max(self.base, self.n - self.d)
        self.segment = max(self.segment, oldest)
        lo, hi = self.segment, self.n - self.w + 1
        if i < lo:
            return
        dist = self._distances(i, lo, hi)
        dist[max(0, i - self.r - lo) : i + self.r - lo] = np.inf
        row = i - self.base
        free = dist.copy()
        for rank in range(min(self.k, len(dist))):
            at = int(free.argmin())  # the first of equals
            if free[at] == np.inf:
                break
            self.near[rank, row], self.dist[rank, row] = at + lo, free[at]
            free[at] = np.inf
        self._decide(np.array([row]))
        self._reverse(i, lo, dist)
        n = i - self.segment
        if self.n >= 10 * self.w and n >= 10 * self.w and self.n % self.jump == 0:
            self._score(i)

    def _decide(self, rows: np.ndarray) -> None:
        self.major[rows] = np.sort(self.near[:, rows], axis=0)[self.k - 1 - self.k // 2]

    def _reverse(self, i: int, lo: int, dist: np.ndarray) -> None:
        """The new subsequence may be nearer to an older row than its neighbours of the first k - 1 ranks."""
        if self.k < 2:
            return
        a, b = lo - self.base, i - self.base
        for row in (np.flatnonzero(dist[: b - a] < self.dist[self.k - 2, a:b])).tolist():
            new, cell = dist[row], row + a
            rank = int(np.searchsorted(self.dist[: self.k - 1, cell], new, side="right"))
            for held, value in ((self.near, i), (self.dist, new)):
                held[rank + 1 :, cell] = held[rank:-1, cell].copy()
                held[rank, cell] = value
            self.major[cell] = sorted(self.near[:, cell].tolist())[self.k - 1 - self.k // 2]

    def _score(self, i: int) -> None:
        lo, w = self.segment, self.w
        n, offset = i - lo, 5 * w
        m = np.clip(self.major[lo - self.base : i - self.base] - lo, 0, n - 1)
        counts = split_counts(m, w)
        profile = np.full(n, -np.inf, np.float32)
        inside = slice(offset, n - offset)
        profile[inside] = SCORES[self.score](*(c[inside] for c in counts))
        finite = np.isfinite(profile)
        if not finite.any():
            return
        profile[finite] = (2 * profile[finite] + np.float32(finite.sum() / self.d)) / 3
        best = int(profile.argmax())
        cp = best + w
        if self.mode != "none":
            held = self.merged[lo - self.base : i - self.base]
            held[finite] = np.fmax(held[finite], profile[finite]) if self.mode == "global" else profile[finite]
        if cp < offset or n - cp < offset:
            return
        zeros_left, zeros_right, n1, n2 = int(counts[0][cp]), int(counts[1][cp]), cp, n - cp - w
        if self.sample_size:
            # Drawn with replacement from the labels on both sides, by a generator of its own with a fixed seed.
            rs = np.random.RandomState(2357)
            label = m >= cp
            x = rs.choice(label[:cp], int(self.sample_size * n1 / n))
            y = rs.choice(label[cp + w :], int(self.sample_size * n2 / n))
            zeros_left, n1, zeros_right, n2 = int((~x).sum()), len(x), int((~y).sum()), len(y)
        _, p = rank_sum(zeros_left, n1, zeros_right, n2)
        if p <= self.p_value:
            self.change_points.append((lo + cp, float(profile[best]), p, self.n - 1))
            self.segment = lo + cp
