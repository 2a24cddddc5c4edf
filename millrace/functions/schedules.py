"""Learning-rate schedules as expressions over a step column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(step: Column, base: float, warmup: int = 0) -> Column:
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(F.lit(base))


def cosine(step: Column, base: float, least: float, total: int, warmup: int = 0) -> Column:
    """Linear warm-up, then half a cosine from base down to least at the last step."""
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(least + (base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def linear(step: Column, base: float, least: float, total: int, warmup: int = 0) -> Column:
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(least + (base - least) * (1 - done))


def polynomial(step: Column, base: float, end: float, total: int, warmup: int = 0, power: float = 0.5) -> Column:
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, base * step / max(1, warmup)).when(step > total, F.lit(end)).otherwise((base - end) * F.pow(F.greatest(F.lit(0.0), 1 - done), F.lit(power)) + end)
