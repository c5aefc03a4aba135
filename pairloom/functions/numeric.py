"""Distribution functions and regression tests that neither Spark nor the installed libraries offer."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


#: MacKinnon's response surface for a cointegrating regression of two series with a constant; fixed values.
_TAU_MAX, _TAU_MIN, _TAU_STAR = 0.92, -18.86, -2.62
_SMALL_P = (2.92, 1.5012, 0.039796)
_LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)


def mackinnon_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    terms = _SMALL_P if tau <= _TAU_STAR else _LARGE_P
    return NORMAL.cdf(sum(c * tau**i for i, c in enumerate(terms)))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, float(rest @ rest), rest


def adf_tau(u: np.ndarray) -> float:
    """Dickey-Fuller t of a mean-free series, without constant, lags chosen by Akaike's criterion."""
    n = len(u)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(u)
    columns = lambda lags, skip: np.column_stack([u[skip:-1], *[d[skip - i : len(d) - i] for i in range(1, lags + 1)]])
    best, lags = math.inf, 0
    for k in range(max(most, 0) + 1):
        y = d[most:]
        _, ssr, _ = _fit(columns(k, most), y)
        m = len(y)
        aic = m * (math.log(2 * math.pi * max(ssr, 1e-300) / m) + 1) + 2 * (k + 1)
        if aic < best:
            best, lags = aic, k
    x, y = columns(lags, lags), d[lags:]
    beta, ssr, _ = _fit(x, y)
    spare = len(y) - x.shape[1]
    if spare <= 0 or ssr <= 0:
        return 0.0
    cov = np.linalg.pinv(x.T @ x) * ssr / spare
    return float(beta[0] / math.sqrt(max(cov[0, 0], 1e-300)))


def engle_granger_p(y: np.ndarray, x: np.ndarray) -> float:
    """p-value of no cointegration of y on x with a constant."""
    _, ssr, rest = _fit(np.column_stack([np.ones(len(x)), x]), y)
    if ssr <= 1e-12 * max(1.0, float(y @ y)):
        return 0.0
    return mackinnon_p(adf_tau(rest))


def cointegration_p(p1: np.ndarray, p2: np.ndarray, least: int) -> float:
    """The smaller p of both directions on logarithms; 1 for short, non-positive or flat series."""
    ok = np.isfinite(p1) & np.isfinite(p2) & (p1 > 0) & (p2 > 0)
    a, b = p1[ok], p2[ok]
    if len(a) < least or a.std() < 0.01 * a.mean() or b.std() < 0.01 * b.mean():
        return 1.0
    a, b = np.log(a), np.log(b)
    return min(engle_granger_p(a, b), engle_granger_p(b, a))


def clean_correlation(p1: np.ndarray, p2: np.ndarray, least: int) -> float:
    """Correlation of returns without outliers beyond four deviations; 0 where too little is left."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r1, r2 = p1[1:] / p1[:-1] - 1, p2[1:] / p2[:-1] - 1
        on = np.isfinite(r1) & np.isfinite(r2)
        r1, r2 = r1[on], r2[on]
        if len(r1) < max(least, 2):
            return 0.0
        ok = (np.abs(r1 - r1.mean()) / r1.std() < 4) & (np.abs(r2 - r2.mean()) / r2.std() < 4)
        if ok.sum() >= 0.6 * len(r1) and ok.sum() >= 100:
            r1, r2 = r1[ok], r2[ok]
        c = float(np.corrcoef(r1, r2)[0, 1])
    return c if math.isfinite(c) else 0.0


def half_life(p1: np.ndarray, p2: np.ndarray) -> float:
    """Half-life of the log spread by its regression on the day before, within 1 to 999."""
    s = np.log(p1 + 1e-8) - np.log(p2 + 1e-8)
    y, x = s[1:], s[:-1]
    on = np.isfinite(x) & np.isfinite(y)
    x, y = x[on], y[on]
    if len(s) < 50 or len(x) < 2 or not x.var() > 0:
        return 999.0
    b = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    return min(999.0, max(1.0, -math.log(2) / math.log(b))) if 0 < b < 1 else 999.0


def kalman(lp1: np.ndarray, lp2: np.ndarray, delta: float = 1e-5, noise: float = 0.001) -> np.ndarray:
    """Residuals of a random-walk hedge ratio. The process noise uses the variance of the whole sample."""
    drift = delta / (1 - delta) * lp2.var()
    head = min(30, len(lp1))
    x, y = lp2[:head] - lp2[:head].mean(), lp1[:head] - lp1[:head].mean()
    beta, p = (float(x @ y / (x @ x)) if head >= 2 and x @ x > 0 else 1.0), 1.0
    out = np.empty(len(lp1))
    for t, (x_t, y_t) in enumerate(zip(lp2.tolist(), lp1.tolist(), strict=True)):
        ahead = p + drift
        scale = x_t * x_t * ahead + noise
        gain = ahead * x_t / scale if abs(scale) > 1e-12 else 0.0
        beta += gain * (y_t - x_t * beta)
        p = (1 - gain * x_t) * ahead
        out[t] = y_t - beta * x_t
    return out


def page_break(v: np.ndarray, threshold: float = 5.0, k: float = 0.5) -> bool:
    """Two-sided Page test of the standardised changes: a running sum less its running minimum, floored at 0."""
    if len(v) < 20:
        return False
    r = np.diff(v)
    sd = r.std(ddof=1)
    if not sd >= 1e-8:
        return False
    u = (r - r.mean()) / sd
    sums = np.cumsum([u - k, -u - k], axis=1)
    return bool((sums - np.minimum(0.0, np.minimum.accumulate(sums, axis=1))).max() > threshold)


def roughness(v: np.ndarray, lags: tuple[int, ...] = (1, 2, 4, 8, 16)) -> float:
    """Half the slope of log variance of increments on log lag, within 0 to 1; 0.5 where there is too little to fit."""
    if len(v) < 20:
        return 0.5
    points = [(math.log(k), math.log(var)) for k in lags if k < len(v) // 2 and (var := float((v[k:] - v[:-k]).var())) >= 1e-16]
    if len(points) < 3:
        return 0.5
    return min(1.0, max(0.0, float(np.polyfit(*zip(*points, strict=True), 1)[0]) / 2))
