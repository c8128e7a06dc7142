"""Numbers, money and ranges for Persian readers, as column expressions; ranges widen outwards to round steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsmill.functions.text import ZWNJ, persian_digits

# Separators and steps in minutes and metres.
THOUSANDS, DECIMAL = "٬", "٫"
MINUTES, METRES, FAR_METRES, KILOMETRE = 5, 50, 100, 1000


def integer(n: Column) -> Column:
    return persian_digits(F.replace(F.format_number(n.cast("bigint"), 0), F.lit(","), F.lit(THOUSANDS)))


def decimal(x: Column, places: int = 1) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.format_number(x, places), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return persian_digits(F.translate(plain, ",.", THOUSANDS + DECIMAL))


def toman(low_rial: Column, high_rial: Column) -> Column:
    low, high = integer(F.floor(low_rial / 10)), integer(F.floor(high_rial / 10))
    unit = F.lit(" تومان")
    return F.when(high_rial.isNull(), F.concat(F.lit(f"دست{ZWNJ}کم "), low, unit)).when(low_rial == high_rial, F.concat(low, unit)).otherwise(F.concat(low, F.lit(" تا "), high, unit))


def hours(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60), minutes % 60
    hour, minute = F.concat(integer(h), F.lit(" ساعت")), F.concat(integer(m), F.lit(" دقیقه"))
    return F.when((h > 0) & (m > 0), F.concat(hour, F.lit(" و "), minute)).when(h > 0, hour).otherwise(minute)


def minutes_range(low_s: Column, high_s: Column) -> Column:
    low = (F.floor(low_s / 60 / MINUTES) * MINUTES).cast("int")
    high = (F.ceil(high_s / 60 / MINUTES) * MINUTES).cast("int")
    return F.when(low == high, F.concat(F.lit("حدود "), hours(low))).otherwise(F.concat(hours(low), F.lit(" تا "), hours(high)))


def metres_range(low: Column, high: Column) -> Column:
    near = F.concat(integer(F.floor(low / METRES) * METRES), F.lit(" تا "), integer(F.ceil(high / METRES) * METRES), F.lit(" متر"))
    km = lambda steps: decimal(steps * FAR_METRES / KILOMETRE)
    return F.when(high < KILOMETRE, near).otherwise(F.concat(km(F.floor(low / FAR_METRES)), F.lit(" تا "), km(F.ceil(high / FAR_METRES)), F.lit(" کیلومتر")))
