"""Categorical samplers and the draws of hierarchical models, on NumPy generators."""

from __future__ import annotations

import numpy as np


def inverse_cdf(weights: np.ndarray, u: np.ndarray | float) -> np.ndarray:
    """First index whose cumulative weight reaches u times the total; rows of a matrix each."""
    cum = np.cumsum(weights, -1)
    if cum.ndim == 1:
        return np.searchsorted(cum, np.asarray(u) * cum[-1], "left")
    return (cum < np.asarray(u)[:, None] * cum[:, -1:]).sum(1)


class AliasTable:
    """Vose's tables: constant time per draw."""

    def __init__(self, weights: np.ndarray):
        p = np.asarray(weights, float) * len(weights) / np.sum(weights)
        self.share, self.alias = np.ones(len(p)), np.arange(len(p))
        small, large = [i for i, x in enumerate(p) if x < 1], [i for i, x in enumerate(p) if x >= 1]
        while small and large:
            i, j = small.pop(), large[-1]
            self.share[i], self.alias[i] = p[i], j
            p[j] -= 1 - p[i]
            if p[j] < 1:
                small.append(large.pop())

    def draw(self, u: np.ndarray) -> np.ndarray:
        x = np.asarray(u) * len(self.share)
        at = np.minimum(x.astype(int), len(self.share) - 1)
        return np.where(x - at < self.share[at], at, self.alias[at])


class AliasRows:
    """Alias tables of some rows of a matrix of weights; a draw costs the same however many columns there are."""

    def __init__(self, weights: np.ndarray, rows: np.ndarray):
        self.rows = np.unique(rows)
        tables = [AliasTable(weights[r]) for r in self.rows]
        self.share = np.array([t.share for t in tables]).reshape(len(tables), -1)
        self.alias = np.array([t.alias for t in tables]).reshape(len(tables), -1)

    def draw(self, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        r = np.searchsorted(self.rows, rows)
        x = u * self.share.shape[1]
        at = np.minimum(x.astype(np.int64), self.share.shape[1] - 1)
        return np.where(x - at < self.share[r, at], at, self.alias[r, at])


class SumTree:
    """A binary tree of sums: draws and single-weight updates in logarithmic time."""

    def __init__(self, weights):
        self.size = 1 << max(0, int(np.ceil(np.log2(max(1, len(weights))))))
        self.tree = np.zeros(2 * self.size)
        self.tree[self.size : self.size + len(weights)] = weights
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    def update(self, at: int, weight: float) -> None:
        at += self.size
        change = weight - self.tree[at]
        while at:
            self.tree[at] += change
            at //= 2

    def draw(self, u: float) -> int:
        rest, at = u * self.tree[1], 1
        while at < self.size:
            at *= 2
            if rest > self.tree[at]:
                rest -= self.tree[at]
                at += 1
        return at - self.size


def crp_tables(n: int, concentration: float, rng: np.random.Generator) -> int:
    """Number of occupied tables after n customers."""
    return int((rng.random(n) < concentration / (concentration + np.arange(n))).sum())


def root_sticks(tables: np.ndarray, gamma: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Dirichlet(tables, gamma): the topics' shares and what is left."""
    x = rng.gamma(np.concatenate([np.maximum(tables, 1e-12), [gamma]]))
    x /= x.sum()
    return x[:-1], float(x[-1])


def concentration(gamma: float, tables: int, topics: int, rng: np.random.Generator, rounds: int = 20) -> float:
    """Auxiliary-variable update under a Gamma(1, 1) prior; mean of the last half."""
    kept = []
    for i in range(rounds):
        eta = rng.beta(gamma + 1, max(tables, 1))
        rate = 1 - np.log(eta)
        odds = topics / (max(tables, 1) * rate)
        gamma = rng.gamma(topics + (rng.random() < odds / (1 + odds)), 1 / rate)
        if i >= rounds // 2:
            kept.append(gamma)
    return float(np.mean(kept))


def break_stick(left: float, gamma: float, rng: np.random.Generator) -> tuple[float, float]:
    """A new topic's share of what is left, and the new rest."""
    part = rng.beta(1, gamma) * left
    return float(part), float(left - part)
