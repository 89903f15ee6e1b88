"""Utility, decay and tier scores as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-life in days by entry type; other types take DEFAULT_HALF_LIFE.
HALF_LIFE_DAYS = {"incident": 90.0, "pattern": 180.0, "convention": 9999.0, "hypothesis": 7.0, "workaround": 14.0}
DEFAULT_HALF_LIFE = 14.0
NO_DECAY_HALF_LIFE = 9999.0
FALLBACK_DAYS = 30

# Prune thresholds by protection tier; protected and permanent rows are exempt.
TIER_DISCOUNT = {"critical": 0.25, "high": 0.5, "normal": 1.0, "low": 1.5}
EXEMPT_TIERS = ["protected", "permanent"]

# Threshold of the reference encoder, the same for the calibrated encoder.
ANCHORS = [(-1.0, -1.0), (0.0, 0.495), (0.5, 0.745), (0.75, 0.89), (0.85, 0.89), (0.90, 0.945), (0.92, 0.955), (0.95, 0.98), (1.0, 1.0)]
LN2 = math.log(2.0)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between UTC dates, not negative."""
    day = 86_400_000_000
    return F.greatest(F.floor(F.unix_micros(later) / day) - F.floor(F.unix_micros(earlier) / day), F.lit(0)).cast("bigint")


def half_life(kind: Column, confidence: Column) -> Column:
    by_kind = F.create_map(*[x for k, v in HALF_LIFE_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return F.when((kind == "incident") & (confidence == "unverified"), F.lit(NO_DECAY_HALF_LIFE)).otherwise(F.coalesce(F.try_element_at(by_kind, kind), F.lit(DEFAULT_HALF_LIFE)))


def utility(days: Column, recurrence: Column, impact: Column, half_life_days: Column, access_count: Column, source: Column) -> Column:
    """impact * exp(-ln2 / half-life / recurrence^0.6 * days) plus boosts for access and human sources, in [0, 1]."""
    rate = F.lit(LN2) / F.greatest(half_life_days, F.lit(0.1)) / F.pow(F.greatest(recurrence, F.lit(1)).cast("double"), F.lit(0.6))
    boost = F.least(F.lit(0.15), F.lit(0.05) * F.log1p(F.greatest(access_count, F.lit(0)).cast("double")))
    return clamp01(impact * F.exp(-rate * days) + boost + F.when(source == "human", F.lit(0.1)).otherwise(F.lit(0.0)))


def recall_decay(impact: Column, recalls: Column, floor: float = 0.5) -> Column:
    return clamp01(impact * F.greatest(F.lit(floor), F.pow(F.lit(0.95), recalls.cast("double"))))


def linear_decay(impact: Column, days: Column) -> Column:
    return clamp01(impact * F.greatest(F.lit(0.3), F.lit(1.0) - days / F.lit(365.0) * F.lit(0.3)))


def recency(days: Column, half_life_days: float = 14.0) -> Column:
    return F.greatest(F.lit(1e-6), F.exp(-F.lit(LN2) * days / F.lit(half_life_days)))


def fractional_days(later: Column, earlier: Column) -> Column:
    return F.greatest((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0), F.lit(0.0))


def tier_composite(relevance: Column, days: Column, importance: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Weighted relevance, recency and importance; weights are rescaled to sum to 1."""
    total = sum(weights) or 1.0
    r, t, i = (w / total for w in weights)
    return F.lit(r) * relevance + F.lit(t) * F.exp(-F.lit(LN2) / 14.0 * days) + F.lit(i) * importance


def decayed_importance(importance: Column, step: float = 0.1) -> Column:
    return F.greatest(F.bround(importance - F.lit(step), 4), F.lit(0.0))


def boosted_importance(importance: Column, step: float = 0.05) -> Column:
    return F.least(importance + F.lit(step), F.lit(1.0))


def prune_action(tier: Column, status: Column, utility_: Column, age_days: Column) -> Column:
    """``cleanup``, ``delete``, ``prune`` or null."""
    m = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in TIER_DISCOUNT.items() for x in (F.lit(k), F.lit(v))]), tier), F.lit(1.0))
    return (
        F.when(tier.isin(EXEMPT_TIERS), F.lit(None).cast("string")).when(status.isin("resolved", "obsolete"), "cleanup")
        .when(utility_ < F.lit(0.05) * m, "delete").when((utility_ < F.lit(0.15) * m) & (age_days > 14), "prune")
    )


def piecewise_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, flat beyond the ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.round(F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out), 4)


def calibrated_threshold(threshold: Column) -> Column:
    """A threshold of the reference encoder on the scale of the calibrated one; beyond [-1, 1] as it stands."""
    return F.when(threshold.between(-1.0, 1.0), piecewise_linear(threshold, ANCHORS)).otherwise(threshold)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson 95 % interval of a share."""
    p = successes / n
    d = 1 + F.lit(z * z) / n
    mid = (p + F.lit(z * z) / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))
