"""Unsigned Stirling numbers of the first kind and the ratios that table samplers need.

A table of logarithms holds s(n, m) up to LIMIT, and beyond it for the BAND least and BAND
largest m of every n. What lies between comes from the saddle point of the rising factorial,
with a relative error below 2e-4 (tested), so that memory grows with the length of a document
and not with its square.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ZERO = -10000.0
LIMIT, BAND = 512, 32


def _psi(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of positive numbers, by recurrence up to 8 and the asymptotic series."""
    x = np.array(x, float)
    one, two = np.zeros_like(x), np.zeros_like(x)
    while (low := x < 8).any():
        one -= np.where(low, 1 / x, 0)
        two += np.where(low, 1 / x**2, 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    one += np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))
    two += 1 / x + 0.5 * y + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))
    return one, two


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 8).any():
        shift -= np.where(low, np.log(x), 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y / 1260)) / x


def saddle_log(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log s(n, m) for 1 < m < n by the saddle point x of Gamma(x + n) / Gamma(x) / x^m."""
    n, m = np.broadcast_arrays(np.asarray(n, float), np.asarray(m, float))
    y = np.log(m / np.log1p(n / m))
    for _ in range(40):  # Newton's steps for log of m = x (psi(x + n) - psi(x)), which grows with x
        x = np.exp(y)
        (p1, p2), (q1, q2) = _psi(x + n), _psi(x)
        step = np.clip((np.log(x * (p1 - q1)) - np.log(m)) / (1 + x * (p2 - q2) / (p1 - q1)), -2, 2)
        y = y - step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    x = np.exp(y)
    spread = m + x * x * (_psi(x + n)[1] - _psi(x)[1])
    return _log_gamma(x + n) - _log_gamma(x) - m * np.log(x) - 0.5 * np.log(2 * np.pi * spread)


class Stirling:
    """log s(n, m) and u, v, w for 0 <= m <= n; a table up to its size, the saddle point beyond."""

    def __init__(self, size: int = 64):
        self.logs = np.zeros((1, 1))
        self.low = self.high = np.zeros((0, BAND + 1))
        self.grow(size)

    def grow(self, size: int) -> None:
        size = min(max(size, len(self.logs) * 2), LIMIT)
        out = np.full((size + 2, size + 2), -np.inf)
        out[0, 0] = 0.0
        for n in range(size + 1):
            out[n + 1, 1 : n + 2] = out[n, : n + 1]
            if n:
                out[n + 1, : n + 1] = np.logaddexp(out[n + 1, : n + 1], out[n, : n + 1] + np.log(n))
        self.logs = out

    def _bands(self, n: int) -> None:
        """low[n, j] = log s(n, j) and high[n, j] = log s(n, n - j), for all n from 0 to at least this one."""
        have = len(self.low)
        if n < have:
            return
        size = max(n + 1, 2 * have, 1024)
        low, high = np.full((size, BAND + 1), -np.inf), np.full((size, BAND + 1), -np.inf)
        low[:have], high[:have] = self.low, self.high
        if not have:
            low[0, 0] = high[0, 0] = 0.0
        with np.errstate(divide="ignore"):
            steps = np.log(np.arange(size))
        for i in range(max(have, 1), size):
            low[i, 1:] = np.logaddexp(low[i - 1, :-1], low[i - 1, 1:] + steps[i - 1])
            high[i, 0] = 0.0
            high[i, 1:] = np.logaddexp(high[i - 1, 1:], high[i - 1, :-1] + steps[i - 1])
        self.low, self.high = low, high

    def _logs(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """log s(n, m) for 0 <= m <= n."""
        out = np.empty(len(n))
        known = n < len(self.logs)
        out[known] = self.logs[n[known], m[known]]
        if not known.all():
            self._bands(int(n.max()))
            least, most = ~known & (m <= BAND), ~known & (m > BAND) & (n - m <= BAND)
            out[least] = self.low[n[least], m[least]]
            out[most] = self.high[n[most], (n - m)[most]]
            rest = ~known & ~least & ~most
            out[rest] = saddle_log(n[rest], m[rest])
        return out

    def log(self, n: int, m: int) -> float:
        """log s(n, m); ZERO stands for no arrangement."""
        if not 0 <= m <= n or (m == 0 < n):
            return ZERO
        if n >= len(self.logs):
            self.grow(n)
        return float(self._logs(np.array([n]), np.array([m]))[0])

    def steps(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """s(n, m - 1) / s(n, m) for 1 <= m <= n."""
        n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
        if len(n) and n.max() >= len(self.logs) and len(self.logs) < LIMIT + 2:
            self.grow(LIMIT)
        # where one side is in a band and the other is not, both come from the saddle point
        out = np.exp(self._logs(n, m - 1) - self._logs(n, m))
        edge = (n >= len(self.logs)) & (((m == BAND + 1) & (n - m > BAND)) | ((n - m == BAND) & (m > BAND + 1)))
        if edge.any():
            out[edge] = np.exp(saddle_log(n[edge], m[edge] - 1) - saddle_log(n[edge], m[edge]))
        return out

    def ratios(self, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """u = s(n + 1, m) / s(n, m) and w = s(n + 1, m + 1) / s(n, m), for 1 <= m <= n, as arrays."""
        n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
        w = np.ones(len(n))
        below = m < n
        w[below] = 1 + n[below] / self.steps(n[below], m[below] + 1)
        return n + self.steps(n, m), w

    def u(self, n: int, m: int) -> float:
        """s(n+1, m) / s(n, m)"""
        return float("inf") if n < m else float(n + self.steps([n], [m])[0]) if n else 0.0

    def v(self, n: int, m: int) -> float:
        """s(n+1, m+1) / s(n+1, m)"""
        return 0.0 if n < m else float(1 / self.steps([n + 1], [m + 1])[0])

    def w(self, n: int, m: int) -> float:
        """s(n+1, m+1) / s(n, m)"""
        return 1.0 if n <= m else float(1 + n / self.steps([n], [m + 1])[0])


def stirling_table(spark: SparkSession, size: int) -> DataFrame:
    """n, m, log_s, u, v, w for 1 <= m <= n <= size."""
    s = Stirling(size + 2)
    rows = [(n, m, s.log(n, m), s.u(n, m), s.v(n, m), s.w(n, m)) for n in range(1, size + 1) for m in range(1, n + 1)]
    return spark.createDataFrame(rows, "n int, m int, log_s double, u double, v double, w double")
