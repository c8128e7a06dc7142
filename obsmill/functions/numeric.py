"""Money ranges, intervals and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = Z95) -> Column:
    """struct<estimate, low, high>; without trials (null, 0, 1). Trials may be an effective, fractional number."""
    p = F.try_divide(successes.cast("double"), trials.cast("double"))
    n = trials.cast("double")
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z / denominator * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = n > 0
    return F.struct(F.when(some, p).alias("estimate"), F.when(some, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0).alias("low"), F.when(some, F.least(F.lit(1.0), centre + half)).otherwise(1.0).alias("high"))


def kish(weight: Column) -> Column:
    """Effective number of rows with weights (an aggregate)."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def money(low: Column, high: Column) -> Column:
    """A range of whole rials; no upper end means open."""
    return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def add(a: Column, b: Column) -> Column:
    return money(a["low"] + b["low"], a["high"] + b["high"])


def scale(a: Column, n: Column) -> Column:
    return money(a["low"] * n, a["high"] * n)


def share(a: Column, n: Column) -> Column:
    """A part for each of n: the low end rounded down, the high end up."""
    return money(F.floor(a["low"] / n), F.ceil(a["high"] / n))


def kind(a: Column) -> Column:
    return F.when(a.isNull(), None).when(a["high"].isNull(), "open").when(a["low"] == a["high"], "exact").otherwise("range")


def rate_card(is_holiday: Column, base: Column, weekend: Column, holiday: Column) -> Column:
    """What a night costs by the card: ordinary nights the base or weekend price, holidays their own, unknown days any."""
    ordinary = F.array_compact(F.array(base, weekend))
    unknown = F.array_compact(F.array(holiday, base, weekend))
    known = F.when(is_holiday.isNull(), unknown).when(is_holiday, F.array_compact(F.array(holiday))).otherwise(ordinary)
    complete = F.when(is_holiday.isNull(), holiday.isNotNull() & base.isNotNull()).when(is_holiday, holiday.isNotNull()).otherwise(F.size(ordinary) > 0)
    return F.when(complete, money(F.array_min(known), F.array_max(known))).otherwise(money(F.lit(0), F.lit(None)))


def diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def ratio(larger_over_smaller: bool, a: Column, b: Column) -> Column:
    """Of two positive numbers, 4 places; null when either is unknown or 0."""
    low, high = F.least(a, b), F.greatest(a, b)
    some = a.isNotNull() & b.isNotNull() & (a != 0) & (b != 0)
    return F.when(some, F.round(F.try_divide(high, low) if larger_over_smaller else F.try_divide(low, high), 4))


def shrink(mean: Column, count: Column, prior: Column, weight: float = 5.0) -> Column:
    """Bayesian average of a rating with a prior worth ``weight`` ratings."""
    return (prior * weight + mean * count) / (count + weight)


def backoff(attempt: Column, base: float, most: float, retry_after: Column | None = None) -> Column:
    wait = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))
    return wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after, F.lit(0.0)))


def call_cost(input_tokens: Column, cached_tokens: Column, output_tokens: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Cost of a call priced by the million tokens, cached input apart."""
    return ((input_tokens - cached_tokens) * price_in + cached_tokens * price_cached + output_tokens * price_out) / 1_000_000
