"""A counter-based generator: uniforms as a pure function of (seed, iteration, a, b).

The same integer recurrence exists as a Spark column, in NumPy and as SQL text, so that
results do not depend on partitioning and can be checked by another engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
ROUNDS = (48271, 69621, 40692)
SEED, STEP, A, B, ADD = 7919, 104729, 1299709, 15485863, 12345


def uniform(seed: int, step: int, a: Column, b: Column) -> Column:
    x = (F.lit(seed * SEED + step * STEP + ADD).cast("long") + F.pmod(a.cast("long"), F.lit(P)) * A + F.pmod(b.cast("long"), F.lit(P)) * B) % P
    for c in ROUNDS:
        x = (x * x + F.lit(c) * x + ADD) % P
    return x / F.lit(float(P))


def uniform_np(seed: int, step: int, a, b) -> np.ndarray:
    x = (seed * SEED + step * STEP + ADD + np.asarray(a, np.int64) % P * A + np.asarray(b, np.int64) % P * B) % P
    for c in ROUNDS:
        x = (x * x + c * x + ADD) % P
    return x / float(P)


def uniform_sql(seed: int, step: int, a: str, b: str) -> str:
    x = f"(({seed * SEED + step * STEP + ADD} + ({a})::BIGINT % {P} * {A} + ({b})::BIGINT % {P} * {B}) % {P})"
    for c in ROUNDS:
        x = f"list_transform([{x}], lambda x: (x * x + {c} * x + {ADD}) % {P})[1]"
    return f"({x} / {float(P)})"
