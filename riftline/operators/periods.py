"""Period estimators: summary statistics, autocorrelation, spectrum, multi-window."""

from __future__ import annotations

import numpy as np

from riftline.operators.matrix import windows_of

LEAST, MOST = 10, 1000


def suss_score(x: np.ndarray, w: int) -> float:
    """Mean distance of rolling mean, deviation and range to those of the whole; the first complete window is left out."""
    win = windows_of(x, w)[1:]
    whole = np.array([x.mean(), x.std(), x.max() - x.min()])
    local = np.c_[win.mean(1), win.std(1), win.max(1) - win.min(1)]
    return float((np.sqrt(((local - whole) ** 2).sum(1)) / np.sqrt(w)).mean()) if len(win) else float("nan")


def suss(x: np.ndarray, threshold: float = 0.89) -> int:
    """Twice the narrowest window whose normalised score passes, found by doubling and then halving steps; bounded by the length."""
    span = x.max() - x.min() if len(x) else 0.0
    if span == 0 or len(x) <= 2 * LEAST:
        return LEAST
    x = (x - x.min()) / span
    low, high = suss_score(x, len(x) - 1), suss_score(x, 1)
    if not high > low:
        return LEAST
    passes = lambda w: 1 - (suss_score(x, w) - low) / (high - low) > threshold
    w = 16
    while w < len(x) and not passes(w):
        w *= 2
    a, b = max(LEAST, w // 2), min(w + 1, len(x) - 1)
    while a <= b:
        mid = (a + b) // 2
        if passes(mid):
            b = mid - 1
        else:
            a = mid + 1
    return 2 * a


def spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positive frequencies as (index, period, magnitude)."""
    f = np.arange(1, (len(x) - 1) // 2 + 1)
    return f, len(x) // np.maximum(f, 1), np.abs(np.fft.fft(x))[f] if len(f) else np.empty(0)


def fft_period(x: np.ndarray) -> int:
    f, period, size = spectrum(x)
    ok = (period >= LEAST) & (period < MOST)
    return int(period[ok][size[ok].argmax()]) if ok.any() else LEAST


def autocorrelation(x: np.ndarray, most: int) -> np.ndarray:
    """Lags 0 .. most."""
    c = x - x.mean()
    f = np.fft.rfft(c, 2 * len(c))
    full = np.fft.irfft(f * np.conj(f))[: most + 1]
    return full / full[0] if len(c) and full[0] > 0 else np.zeros(most + 1)


def acf_period(x: np.ndarray) -> int:
    a = autocorrelation(x, min(len(x) // 2, MOST))
    peak = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] > a[2:])) + 1
    peak = peak[(peak >= LEAST) & (peak < MOST)]
    return int(peak[a[peak].argmax()]) if len(peak) else LEAST


def mwf_residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = min(MOST, len(x))
    if most <= LEAST:
        return np.empty(0, int), np.empty(0)
    c = np.r_[0.0, np.cumsum(x)]
    length = len(x) - (most - 1) + 1
    out = []
    for w in range(LEAST, most):
        m = (c[w:] - c[:-w]) / w
        out.append(np.log(max(np.abs(m - m.mean())[:length].sum(), 1e-300)))
    return np.arange(LEAST, most), np.array(out)


def mwf_period(x: np.ndarray) -> int:
    w, r = mwf_residuals(x)
    low = np.flatnonzero((r[1:-1] < r[:-2]) & (r[1:-1] < r[2:])) + 1 if len(r) > 2 else np.empty(0, int)
    if not len(low):
        return LEAST
    return int(w[low[0]]) if len(low) < 3 else int(np.mean([w[low[i]] / (i + 1) for i in range(3)]))


ESTIMATORS = {"suss": suss, "fft": fft_period, "acf": acf_period, "mwf": mwf_period}
