"""Jalali calendar as a day dimension, holidays, and date expressions.

A Jalali year begins at the March equinox; within 1178 to 1633 the leap years are those whose
remainder by the 33-year cycle is one of eight, which gives every new year's day by counting.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Remainders by 33 of leap years, and a known new year's day.
LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)
ANCHOR_YEAR, ANCHOR = 1400, date(2021, 3, 21)
FIRST_YEAR, LAST_YEAR = 1178, 1632


def is_leap(year: int) -> bool:
    if not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError(f"Jalali year {year} is outside {FIRST_YEAR} to {LAST_YEAR}")
    return year % 33 in LEAP_REMAINDERS


def new_year(year: int) -> date:
    """Gregorian day of 1 Farvardin."""
    step = range(ANCHOR_YEAR, year) if year >= ANCHOR_YEAR else range(year, ANCHOR_YEAR)
    days = sum(366 if is_leap(y) else 365 for y in step)
    return ANCHOR + timedelta(days=days if year >= ANCHOR_YEAR else -days)


def month_length(year: int, month: int) -> int:
    if not 1 <= month <= 12:
        raise ValueError(f"no month {month}")
    return 31 if month <= 6 else 30 if month < 12 or is_leap(year) else 29


def to_gregorian(year: int, month: int, day: int) -> date:
    if not 1 <= day <= month_length(year, month):
        raise ValueError(f"no day {day} in {year}/{month}")
    return new_year(year) + timedelta(days=sum(month_length(year, m) for m in range(1, month)) + day - 1)


def jalali_days(spark: SparkSession, first: int = 1350, last: int = 1450) -> DataFrame:
    """One row a day: day, jy, jm, jd, weekday (0 Monday); 366 rows a year at most, so it may be broadcast."""
    years = spark.createDataFrame([(y, new_year(y), 366 if is_leap(y) else 365) for y in range(first, last + 1)], "jy int, start date, days int")
    days = years.select("jy", "start", F.explode(F.sequence(F.lit(0), F.col("days") - 1)).alias("k"))
    month = F.when(F.col("k") < 186, F.floor(F.col("k") / 31) + 1).otherwise(F.floor((F.col("k") - 186) / 30) + 7).cast("int")
    in_month = F.when(F.col("k") < 186, F.col("k") % 31 + 1).otherwise((F.col("k") - 186) % 30 + 1).cast("int")
    day = F.expr("date_add(start, k)")
    return days.select(day.alias("day"), "jy", month.alias("jm"), in_month.alias("jd"), F.weekday(day).alias("weekday"))


def with_jalali(df: DataFrame, day_col: str, first: int = 1350, last: int = 1450) -> DataFrame:
    """Adds jalali struct<jy, jm, jd>; null outside the dimension."""
    dim = jalali_days(df.sparkSession, first, last).select(F.col("day").alias("__day"), F.struct("jy", "jm", "jd").alias("jalali"))
    return df.join(F.broadcast(dim), F.col(day_col) == F.col("__day"), "left").drop("__day")


def iran_today(ts: Column) -> Column:
    """The calendar day at +03:30."""
    return (ts + F.expr("INTERVAL '03:30' HOUR TO MINUTE")).cast("date")


def days_off(days: DataFrame, fixed: list[tuple[int, int, str]], observed: DataFrame) -> DataFrame:
    """Holidays of a day dimension: Fridays, fixed Jalali days and observed days, as (day, kind, name)."""
    spark = days.sparkSession
    named = spark.createDataFrame(fixed, "jm int, jd int, name string")
    weekly = days.where("weekday = 4").select("day", F.lit("weekly").alias("kind"), F.lit(None).cast("string").alias("name"))
    on_fixed = days.join(F.broadcast(named), ["jm", "jd"]).select("day", F.lit("fixed").alias("kind"), "name")
    seen = days.join(observed.select("day"), "day", "left_semi").select("day", F.lit("observed").alias("kind"), F.lit(None).cast("string").alias("name"))
    return weekly.unionByName(on_fixed).unionByName(seen)


def runs(df: DataFrame, day_col: str, *keys: str) -> DataFrame:
    """Runs of consecutive days: first, last, days, by the keys."""
    spec = W.partitionBy(*keys).orderBy(day_col)
    marked = df.select(*keys, day_col).distinct().withColumn("__g", F.date_sub(F.col(day_col), F.row_number().over(spec)))
    return marked.groupBy(*keys, "__g").agg(F.min(day_col).alias("first"), F.max(day_col).alias("last"), F.count("*").alias("days")).drop("__g")


def nights(check_in: Column, check_out: Column) -> Column:
    """The nights of a half-open stay."""
    return F.sequence(check_in, F.date_sub(check_out, 1))


def stays_overlap(in1: Column, out1: Column, in2: Column, out2: Column) -> Column:
    return (in1 < out2) & (in2 < out1)


THURSDAY, FRIDAY = 3, 4


def weekend(today: Column, weeks_ahead: int = 0, n: int | None = None) -> Column:
    """struct<check_in, check_out, partial>: Thursday and Friday nights; on a Friday this weekend's last night is left."""
    friday = F.weekday(today) == FRIDAY
    thursday = F.when(friday, F.date_sub(today, 1)).otherwise(F.date_add(today, (F.lit(THURSDAY) - F.weekday(today) + 7) % 7))
    partial = friday & F.lit(weeks_ahead == 0)
    start = F.when(partial, today).otherwise(F.date_add(thursday, 7 * weeks_ahead))
    length = F.lit(n) if n else F.when(partial, 1).otherwise(2)
    return F.struct(start.alias("check_in"), F.date_add(start, length).alias("check_out"), partial.alias("partial"))


def next_weekday(today: Column, weekday: int, weeks_ahead: int = 0) -> Column:
    return F.date_add(today, (F.lit(weekday) - F.weekday(today) + 7) % 7 + 7 * weeks_ahead)


def resolve(kind: str, today: date, *, month: int = 0, day: int = 0, year: int | None = None, days: int = 0, weeks_ahead: int = 0, weekday: int = 0, n: int | None = None, off: tuple[date, ...] = (), official: tuple[date, ...] = ()) -> dict:
    """One date expression for one search: check-in, check-out, whether any stay inside will do, caveats.

    kind: relative, weekday, weekend, jalali_day, jalali_month, nowruz, next_holiday. off and official
    are the days off and those that are more than a weekly holiday.
    """
    caveats: set[str] = set()
    stay = lambda start, k: (start, start + timedelta(days=k))
    this_year = next(y for y in range(today.year - 622, today.year - 619) if new_year(y) <= today < new_year(y + 1))
    flexible = kind in ("jalali_month", "nowruz")
    if kind == "relative":
        window = stay(today + timedelta(days=days), n or 1)
    elif kind == "weekday":
        window = stay(today + timedelta(days=(weekday - today.weekday()) % 7 + 7 * weeks_ahead), n or 1)
    elif kind == "weekend":
        if today.weekday() == FRIDAY and not weeks_ahead:
            caveats.add("partial_weekend")
            window = stay(today, n or 1)
        else:
            thursday = today - timedelta(days=1) if today.weekday() == FRIDAY else today + timedelta(days=(THURSDAY - today.weekday()) % 7)
            window = stay(thursday + timedelta(weeks=weeks_ahead), n or 2)
    elif kind == "jalali_day":
        start = to_gregorian(year or this_year, month, day)
        if start < today and year is None:
            caveats.add("next_year")
            start = to_gregorian(this_year + 1, month, day)
        window = stay(start, n or 1)
    elif flexible:
        span = (lambda y: (new_year(y), new_year(y) + timedelta(days=13))) if kind == "nowruz" else (lambda y: (s := to_gregorian(y, month, 1), s + timedelta(days=month_length(y, month))))
        window = span(year or this_year)
        if window[1] <= today + timedelta(days=1) and year is None:
            window = span(this_year + 1)
            if kind == "jalali_month":
                caveats.add("next_year")
        window = (max(window[0], today), window[1])
    elif kind == "next_holiday":
        free = set(off) | set(official)
        first = min((d for d in official if d >= today), default=None)
        if first is None:
            raise ValueError("no official holiday is known")
        last = first
        while first - timedelta(days=1) in free and first > today:
            first -= timedelta(days=1)
        while last + timedelta(days=1) in free:
            last += timedelta(days=1)
        start = max(first - timedelta(days=1), today)
        window = stay(start, n) if n else (start, last + timedelta(days=1))
    else:
        raise ValueError(f"no expression {kind}")
    if window[1] <= today or window[0] < today:
        raise ValueError("the dates are in the past")
    return {"check_in": window[0], "check_out": window[1], "flexible": flexible, "caveats": sorted(caveats)}
