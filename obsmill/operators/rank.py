"""Search: eligibility with reasons, scores, diversity, facets, histogram."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CONFIRMED = ("listed", "measured", "photo", "described")


@dataclass(frozen=True)
class Wants:
    nights: int = 1
    guests: int | None = None
    bedrooms_min: int | None = None
    budget: int | None = None
    basis: str = "unknown"  # per_night, whole_stay, unknown
    features: tuple[str, ...] = ()
    max_drive: float | None = None


def checked(candidates: DataFrame, wants: Wants, basis: str) -> DataFrame:
    """Adds reason (the first that excludes, or null) and cautions.

    candidates: id, bookable, max_capacity, bedrooms, low, high (null low: no price; null high: open),
    rating, drive_low, drive_high, contradicted, features map<string, string>.
    """
    c, none = F.col, F.lit(None)
    reasons, cautions = [(~c("bookable"), "not_bookable")], []
    if wants.guests is not None:
        reasons.append((c("max_capacity") < wants.guests, "too_small"))
        cautions.append((c("max_capacity").isNull(), "capacity_unknown"))
    if wants.bedrooms_min is not None:
        reasons.append((c("bedrooms") < wants.bedrooms_min, "few_bedrooms"))
        cautions.append((c("bedrooms").isNull(), "bedrooms_unknown"))
    cautions.append((c("low").isNull(), "price_unknown"))
    if wants.budget is not None:
        budget = wants.budget * wants.nights if basis == "per_night" else wants.budget
        reasons.append((c("low") > budget, "over_budget"))
        cautions.append((c("low").isNotNull() & (c("high").isNull() | (c("high") > budget)), "may_exceed_budget"))
    if wants.max_drive is not None:
        reasons.append((c("drive_low") > wants.max_drive, "too_far"))
        cautions += [(c("drive_low").isNull(), "drive_unknown"), ((c("drive_low") <= wants.max_drive) & (c("drive_high") > wants.max_drive), "may_exceed_drive")]
    told = lambda f: F.coalesce(F.element_at("features", f), F.lit("unknown"))
    any_of = lambda state: F.lit(False) if not wants.features else _any([told(f) == state for f in wants.features])
    reasons.append((any_of("denied"), "feature_denied"))
    cautions += [(any_of("unknown"), "feature_unconfirmed"), (any_of("described"), "feature_only_described"), (F.coalesce(c("contradicted"), F.lit(0)) > 0, "claim_contradicted")]
    reason = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in reasons))
    kept = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in cautions))))
    out = candidates.withColumn("reason", reason)
    return out.withColumn("cautions", F.when(c("reason").isNull(), kept).otherwise(none.cast("array<string>")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def ranked(candidates: DataFrame, wants: Wants) -> DataFrame:
    """Eligible candidates with confirmed, score, rank: confirmed features, then score, then id."""
    basis = "whole_stay" if wants.basis == "unknown" else wants.basis
    kept = checked(candidates, wants, basis).where("reason IS NULL")
    per = F.col("low").cast("double") / (wants.guests or 1) / wants.nights
    spread = kept.withColumn("price", per)
    ends = spread.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    spread = spread.join(F.broadcast(ends))  # one row
    close = F.when(F.col("price").isNull(), 0.0).when(F.col("lo") == F.col("hi"), 1.0).otherwise((F.col("hi") - F.col("price")) / (F.col("hi") - F.col("lo")))
    stars = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("rating") - 1) / 4)), F.lit(0.0))
    confirmed = sum((F.when(F.element_at("features", f).isin(*CONFIRMED), 1).otherwise(0) for f in wants.features), F.lit(0))
    scored = spread.withColumn("confirmed", confirmed).withColumn("score", 0.6 * close + 0.4 * stars)
    order = W.orderBy(F.desc("confirmed"), F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).drop("lo", "hi", "reason")


def budget_readings(candidates: DataFrame, wants: Wants) -> DataFrame:
    """How many candidates each reading of the budget keeps, and whether the readings differ."""
    both = [checked(candidates, wants, basis).select("id", F.lit(basis).alias("basis"), F.col("reason").isNull().alias("kept")) for basis in ("per_night", "whole_stay")]
    each = both[0].unionByName(both[1])
    differ = each.groupBy("id").agg(F.count_distinct("kept").alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("differ"))
    return each.groupBy("basis").agg(F.count_if("kept").alias("kept")).join(F.broadcast(differ))


def exclusions(candidates: DataFrame, wants: Wants) -> DataFrame:
    basis = "whole_stay" if wants.basis == "unknown" else wants.basis
    return checked(candidates, wants, basis).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def drive_coverage(candidates: DataFrame, wants: Wants, hours: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """Results at each drive limit in hours; candidates without a drive time don't count."""
    free = checked(candidates, replace(wants, max_drive=None), wants.basis).where("reason IS NULL AND drive_low IS NOT NULL")
    limits = F.explode(F.array(*(F.lit(h) for h in hours))).alias("hours")
    return free.select("drive_low", limits).groupBy("hours").agg(F.count_if(F.col("drive_low") <= F.col("hours") * 60).alias("n"))


def one_per(df: DataFrame, key: str) -> DataFrame:
    """The best-ranked row of each key."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy("rank"))).where("__k = 1").drop("__k")


@dataclass(frozen=True)
class Filters:
    price_min: float | None = None
    price_max: float | None = None
    per_night: bool = False
    bedrooms_min: int | None = None
    capacity_min: int | None = None
    features: tuple[str, ...] = ()
    property_types: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    multi_platform: bool = False
    instant: bool = False
    rating_min: float | None = None
    coast_max_m: float | None = None
    extra: tuple = field(default=())


def price(f: Filters) -> Column:
    return F.col("total") / F.greatest(F.lit(1), F.col("nights")) if f.per_night else F.col("total").cast("double")


def passes(f: Filters) -> Column:
    """A facet row passes all that is asked; what is unknown fails; lists are alternatives, features all-of."""
    c = F.col
    asked = [
        (f.price_min is not None, lambda: price(f) >= f.price_min), (f.price_max is not None, lambda: price(f) <= f.price_max),
        (f.bedrooms_min is not None, lambda: c("bedrooms") >= f.bedrooms_min), (f.capacity_min is not None, lambda: c("max_capacity") >= f.capacity_min),
        (bool(f.features), lambda: F.size(F.array_except(F.array(*map(F.lit, f.features)), "features")) == 0),
        (bool(f.property_types), lambda: c("property_type").isin(*f.property_types)), (bool(f.platforms), lambda: c("platform").isin(*f.platforms)),
        (f.multi_platform, lambda: c("multi_platform")), (f.instant, lambda: c("instant")),
        (f.rating_min is not None, lambda: c("rating") >= f.rating_min), (f.coast_max_m is not None, lambda: c("coast_low_m") <= f.coast_max_m),
    ]
    out = F.lit(True)
    for on, condition in asked:
        if on:
            out = out & F.coalesce(condition(), F.lit(False))
    return out


def histogram(rows: DataFrame, f: Filters, bins: int = 24) -> DataFrame:
    """Prices of the rows that all other filters leave: (bin, low, n). The top 2 % fall into the last bin."""
    unit = 100_000 if f.per_night else 500_000
    p = rows.where(passes(replace(f, price_min=None, price_max=None))).select(price(f).alias("p")).where("p IS NOT NULL")
    # the 98 % price by index: counted first, then one row taken
    n = p.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "bin int, low double, n bigint")
    at = min(n - 1, int(n * 0.98))
    low, top = p.agg(F.min("p"), F.expr(f"percentile_disc({(at + 1) / n}) WITHIN GROUP (ORDER BY p)")).first()
    first = low // unit * unit
    last = max(first + unit, -(-top // unit) * unit)
    step = (last - first) / bins
    counted = p.groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("p") - first) / step))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(first) + F.col("id") * step).alias("low"))
    return every.join(counted, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"))
