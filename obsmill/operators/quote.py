"""Quotes for stays from calendar observations, with their uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.functions.numeric import kind, money, rate_card
from obsmill.operators.observe import latest

BLOCKING = ("unavailable", "booked", "blocked")




def quote_stays(listings: DataFrame, observations: DataFrame, requests: DataFrame, order: list[Column], direct: DataFrame | None = None) -> DataFrame:
    """One row for each listing and request: status, total, kind, caveats, oldest, newest.

    listings: listing, base_capacity, extra_capacity, min_nights, fees_known, base, weekend, holiday,
    extra_base, extra_weekend, extra_holiday. observations: listing, night, availability, price,
    extra_price, min_nights, is_holiday, observed_at. requests: request, check_in, check_out, guests
    (a small table: a few scenarios). direct: listing, request, total, observed_at.

    Outcomes in this order: a direct quote no older than the newest used observation; too many
    guests; a night taken; fewer nights than the check-in night (else the listing) asks; a night
    missing or of unknown state; bookable.
    """
    asked = requests.withColumn("nights", F.datediff("check_out", "check_in"))
    wanted = asked.select("request", "check_in", F.explode(F.sequence("check_in", F.date_sub("check_out", 1))).alias("night"))
    # one shuffle by listing serves the newest nights, the join with listings and the sums
    newest = latest(observations.repartition("listing"), ["listing", "night"], order)
    used = newest.join(F.broadcast(wanted), "night")  # requests are scenarios, a handful of rows
    card = listings.select("listing", "base", "weekend", "holiday", "extra_base", "extra_weekend", "extra_holiday", "base_capacity")
    used = used.join(card, "listing").join(F.broadcast(asked.select("request", "guests")), "request")
    extra_guests = F.greatest(F.lit(0), F.col("guests") - F.col("base_capacity"))
    price = F.when(F.col("price").isNotNull(), money(F.col("price"), F.col("price"))).otherwise(rate_card(F.col("is_holiday"), F.col("base"), F.col("weekend"), F.col("holiday")))
    no_extra = F.coalesce(extra_guests, F.lit(0)) == 0
    extra = (
        F.when(no_extra, money(F.lit(0), F.lit(0)))
        .when(F.col("extra_price").isNotNull(), money(F.col("extra_price"), F.col("extra_price")))
        .otherwise(rate_card(F.col("is_holiday"), F.col("extra_base"), F.col("extra_weekend"), F.col("extra_holiday")))
    )
    charged = used.select("listing", "request", "night", "check_in", "availability", "observed_at", "min_nights", "price", "extra_price", price.alias("p"), extra.alias("x"), F.coalesce(extra_guests, F.lit(0)).alias("k"), no_extra.alias("no_extra"))
    flags = {
        "night_price_from_rate_card": F.col("price").isNull() & F.col("p.high").isNotNull(),
        "night_price_unknown": F.col("price").isNull() & F.col("p.high").isNull(),
        "extra_guest_price_from_rate_card": ~F.col("no_extra") & F.col("extra_price").isNull() & F.col("x.high").isNotNull(),
        "extra_guest_price_unknown": ~F.col("no_extra") & F.col("extra_price").isNull() & F.col("x.high").isNull(),
    }
    per = charged.groupBy("listing", "request").agg(
        F.count("*").alias("seen"),
        F.bool_or(F.col("availability").isin(*BLOCKING)).alias("taken"),
        F.bool_and(F.coalesce(F.col("availability") == "available", F.lit(False))).alias("free"),
        F.max(F.when(F.col("night") == F.col("check_in"), F.col("min_nights"))).alias("night_min"),
        F.sum(F.col("p.low") + F.col("x.low") * F.col("k")).alias("low"),
        F.sum(F.col("p.high") + F.col("x.high") * F.col("k")).alias("high_sum"),
        F.count(F.col("p.high") + F.col("x.high") * F.col("k")).alias("high_n"),
        F.min("observed_at").alias("oldest"),
        F.max("observed_at").alias("newest"),
        *(F.bool_or(c).alias(f"c_{name}") for name, c in flags.items()),
    )
    grid = listings.crossJoin(F.broadcast(asked)).join(per, ["listing", "request"], "left")  # scenarios again
    if direct is not None:
        grid = grid.join(direct.select("listing", "request", F.col("total").alias("d_total"), F.col("observed_at").alias("d_at")), ["listing", "request"], "left")
    else:
        grid = grid.withColumn("d_total", F.lit(None).cast("bigint")).withColumn("d_at", F.lit(None).cast("timestamp_ntz"))
    by_direct = F.col("d_total").isNotNull() & (F.col("newest").isNull() | (F.col("d_at") >= F.col("newest")))
    most = F.col("base_capacity") + F.coalesce("extra_capacity", F.lit(0))
    least = F.coalesce("night_min", "min_nights")
    status = (
        F.when(by_direct, "bookable")
        .when(F.coalesce(F.col("guests") > most, F.lit(False)), "too_many_guests")
        .when(F.coalesce("taken", F.lit(False)), "unavailable")
        .when(F.coalesce(F.col("nights") < least, F.lit(False)), "below_min_nights")
        .when((F.coalesce("seen", F.lit(0)) < F.col("nights")) | ~F.coalesce("free", F.lit(False)), "unknown")
        .otherwise("bookable")
    )
    out = grid.withColumn("status", status).withColumn("by_direct", by_direct)
    closed = (F.col("high_n") == F.col("seen")) & F.col("base_capacity").isNotNull() & F.col("fees_known")
    total = F.when(F.col("status") != "bookable", None).when(F.col("by_direct"), money(F.col("d_total"), F.col("d_total"))).otherwise(money(F.col("low"), F.when(closed, F.col("high_sum"))))
    priced = (F.col("status") == "bookable") & ~F.col("by_direct")
    names = {**{n: F.col(f"c_{n}") for n in flags}, "capacity_unknown": F.col("base_capacity").isNull(), "fees_unknown": ~F.col("fees_known")}
    caveats = F.when(priced, F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in names.items()))))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("total", total).select("listing", "request", "status", "total", kind(F.col("total")).alias("kind"), caveats.alias("caveats"), F.when(F.col("by_direct"), F.col("d_at")).otherwise(F.col("oldest")).alias("oldest"), F.when(F.col("by_direct"), F.col("d_at")).otherwise(F.col("newest")).alias("newest"))


def price_gaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Of two sides' bookable quotes (keys, platform, low): ratio and the cheaper platform, null on a tie."""
    a, b = left.select(*keys, F.col("platform").alias("pa"), F.col("low").alias("la")), right.select(*keys, F.col("platform").alias("pb"), F.col("low").alias("lb"))
    both = a.join(b, keys).where("la > 0 AND lb > 0")
    return both.select(*keys, F.expr("CASE WHEN la < lb THEN pa WHEN lb < la THEN pb END").alias("cheaper"), (F.greatest("la", "lb") / F.least("la", "lb")).alias("ratio"))


def gap_summary(gaps: DataFrame, *keys: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Pairs, interpolated median and index p90 of the ratios (4 places), and extra aggregates, by the keys."""
    spec = W.partitionBy(*keys)
    ranked = gaps.withColumn("__n", F.count("*").over(spec)).withColumn("__rn", F.row_number().over(spec.orderBy("ratio")))
    at = F.least(F.col("__n") - 1, F.floor(F.lit(0.9) * F.col("__n")))
    return ranked.groupBy(*keys).agg(F.count("*").alias("pairs"), F.round(F.percentile("ratio", 0.5), 4).alias("median_ratio"), F.round(F.max(F.when(F.col("__rn") - 1 == at, F.col("ratio"))), 4).alias("p90_ratio"), *extra)


def compare_nights(a: DataFrame, b: DataFrame, keys: list[str], max_gap_s: float) -> DataFrame:
    """Newest nights of two calendars close in time and of known state, and whether one side hides the other's free night."""
    x, y = (df.select(*keys, "night", F.col("availability").alias(f"v{n}"), F.col("observed_at").alias(f"t{n}")) for df, n in ((a, 1), (b, 2)))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    near = x.join(y, [*keys, "night"]).where(F.abs(seconds(F.col("t1")) - seconds(F.col("t2"))) <= max_gap_s).where("v1 <> 'unknown' AND v2 <> 'unknown'")
    taken = ", ".join(f"'{t}'" for t in BLOCKING)
    return near.select(*keys, "night", F.expr(f"(v1 = 'available' AND v2 IN ({taken})) OR (v2 = 'available' AND v1 IN ({taken}))").alias("hidden"))


def corrected_overlap(predicted: Column, precision: Column, recall: Column, cap: Column) -> Column:
    """struct<estimate, low, high> of real pairs from predicted ones; precision and recall as (estimate, low, high)."""
    est = F.least(F.try_divide(predicted * precision["estimate"], recall["estimate"]), cap)
    low = F.least(F.try_divide(predicted * precision["low"], recall["high"]), cap)
    high = F.least(F.coalesce(F.when(recall["low"] > 0, F.try_divide(predicted * precision["high"], recall["low"])), cap.cast("double")), cap)
    return F.when((recall["estimate"] > 0) & (recall["high"] > 0), F.struct(est.alias("estimate"), low.alias("low"), high.alias("high")))
