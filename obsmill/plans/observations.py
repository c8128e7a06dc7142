"""Observations, crawl statistics, spending, quotes and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.functions import numeric, text
from obsmill.operators import evaluate, observe, quote
from obsmill.plans.surrogate import as_text, frame, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = as_text(sql, *dates)
        return f

    return add


def newest_order():
    return [F.col("observed_at").desc(), *(F.col(f"tie{k}").asc() for k in (1, 2, 3, 4))]


_LATEST = "SELECT * FROM observation QUALIFY row_number() OVER (PARTITION BY listing, night ORDER BY observed_at DESC, tie1, tie2, tie3, tie4) = 1"
_KEPT = "listing, night, observed_at, availability, price, is_holiday"


@query(f"{with_views('observation')} SELECT {_KEPT} FROM ({_LATEST})", dates=("night",))
def latest_observation(spark, sf):
    return observe.latest(frame(spark, sf, "observation"), ["listing", "night"], newest_order()).select(*_KEPT.split(", "))


@query(f"{with_views('snapshot')} SELECT DISTINCT ON (request_key) request_key, id, status, fetched_at FROM snapshot ORDER BY request_key, fetched_at DESC, id")
def latest_per_request(spark, sf):
    return observe.latest_by(frame(spark, sf, "snapshot"), ["request_key"], "fetched_at", "id", ["id", "status", "fetched_at"])


@query(f"{with_views('snapshot')} SELECT id, kind, fetched_at FROM snapshot WHERE kind IN ('click', 'view') AND run_id = 1")
def snapshots_of_kinds(spark, sf):
    return frame(spark, sf, "snapshot").where("kind IN ('click', 'view') AND run_id = 1").select("id", "kind", "fetched_at")


@query(f"{with_views('listing')} SELECT platform, listing, villa, rating FROM listing WHERE platform = 'a'")
def listings_of_platform(spark, sf):
    return frame(spark, sf, "listing").where("platform = 'a'").select("platform", "listing", "villa", "rating")


@query(f"{with_views('listing')} SELECT platform, listing, villa, bedrooms FROM listing WHERE platform = 'b' AND listing = 4321")
def listing_lookup(spark, sf):
    return frame(spark, sf, "listing").where("platform = 'b' AND listing = 4321").select("platform", "listing", "villa", "bedrooms")


@query(f"""{with_views('listing', 'observation')} SELECT o.listing, count(*) AS n, array_to_string(list_sort(list_distinct(list(CAST(o.night AS VARCHAR)))), ',') AS nights
FROM observation o JOIN listing l USING (listing) WHERE platform = 'a' AND night >= DATE '2024-01-02' AND night < DATE '2024-01-05' GROUP BY o.listing""")
def calendars_in_range(spark, sf):
    o = frame(spark, sf, "observation").where("night >= DATE '2024-01-02' AND night < DATE '2024-01-05'")
    nights = F.array_join(F.array_sort(F.collect_set(F.col("night").cast("string"))), ",")
    return o.join(frame(spark, sf, "listing").where("platform = 'a'").select("listing"), "listing").groupBy("listing").agg(F.count("*").alias("n"), nights.alias("nights"))


@query(f"""{with_views('observation')}, stored AS (SELECT * FROM ({_LATEST.replace('FROM observation', "FROM observation WHERE tie1 % 2 = 0")})),
both_sides AS (SELECT *, 0 AS new FROM stored UNION ALL SELECT *, 1 FROM observation WHERE tie1 % 2 = 1)
SELECT {_KEPT} FROM both_sides QUALIFY row_number() OVER (PARTITION BY listing, night ORDER BY observed_at DESC, new DESC, tie1, tie2, tie3, tie4) = 1""", dates=("night",))
def upsert_newest_wins(spark, sf):
    o = frame(spark, sf, "observation")
    stored = observe.latest(o.where("tie1 % 2 = 0"), ["listing", "night"], newest_order())
    return observe.upsert_newest(stored, o.where("tie1 % 2 = 1"), ["listing", "night"], "observed_at", newest_order()[1:]).select(*_KEPT.split(", "))


@query(f"""{with_views('observation')} SELECT DISTINCT listing, night FROM observation n WHERE tie2 % 2 = 1
AND NOT EXISTS (SELECT 1 FROM observation s WHERE s.tie2 % 2 = 0 AND s.listing = n.listing AND s.night = n.night)""", dates=("night",))
def append_dedupe(spark, sf):
    o = frame(spark, sf, "observation")
    return observe.append_new(o.where("tie2 % 2 = 0"), o.where("tie2 % 2 = 1"), ["listing", "night"]).select("listing", "night")


@query(f"""{with_views('listing')} SELECT platform, listing, rating FROM listing WHERE platform <> 'a' UNION ALL SELECT platform, listing, CAST(5 AS DOUBLE) FROM listing WHERE platform = 'a' AND listing % 10 = 0""")
def replace_partition_rows(spark, sf):
    rows = frame(spark, sf, "listing").select("platform", "listing", "rating")
    return observe.replace_where(rows, rows.where("platform = 'a' AND listing % 10 = 0").withColumn("rating", F.lit(5.0)), "platform", "a")


@query(f"""{with_views('listing', 'observation')}, seen AS ({_LATEST}), per AS (SELECT listing, count(*) AS nights, min(observed_at) AS first, max(observed_at) AS last FROM seen GROUP BY listing)
SELECT platform, count(*) AS listings, count(per.listing) AS seen, count(*) FILTER (WHERE nights = 7) AS complete, min(first) FILTER (WHERE nights = 7) AS first, max(last) FILTER (WHERE nights = 7) AS last,
CAST(count(*) FILTER (WHERE nights = 7) AS DOUBLE) / count(*) AS share FROM listing LEFT JOIN per USING (listing) GROUP BY platform""")
def coverage_report(spark, sf):
    seen = observe.latest(frame(spark, sf, "observation"), ["listing", "night"], newest_order())
    per = seen.groupBy("listing").agg(F.count("*").alias("nights"), F.min("observed_at").alias("f"), F.max("observed_at").alias("l")).withColumn("known", F.lit(True))
    all_seven = F.col("nights") == 7
    return (
        frame(spark, sf, "listing").select("platform", "listing").join(per, "listing", "left").groupBy("platform")
        .agg(F.count("*").alias("listings"), F.count("known").alias("seen"), F.count_if(all_seven).alias("complete"), F.min(F.when(all_seven, F.col("f"))).alias("first"), F.max(F.when(all_seven, F.col("l"))).alias("last"))
        .withColumn("share", F.col("complete") / F.col("listings"))
    )


@query(f"""{with_views('observation')} SELECT night, count(DISTINCT listing) FILTER (WHERE is_holiday IS NOT NULL) AS reporters, count(DISTINCT listing) FILTER (WHERE is_holiday) AS holiday, max(observed_at) AS last FROM observation GROUP BY night""", dates=("night",))
def holiday_flags(spark, sf):
    return frame(spark, sf, "observation").groupBy("night").agg(F.count_distinct(F.when(F.col("is_holiday").isNotNull(), F.col("listing"))).alias("reporters"), F.count_distinct(F.when(F.col("is_holiday"), F.col("listing"))).alias("holiday"), F.max("observed_at").alias("last"))


@query(f"""{with_views('observation')}, f AS (SELECT night, count(DISTINCT listing) FILTER (WHERE is_holiday IS NOT NULL) AS r, count(DISTINCT listing) FILTER (WHERE is_holiday) AS h FROM observation WHERE tie1 % 3 < 2 AND NOT (night = DATE '2024-01-03' AND tie1 % 3 = 1) GROUP BY night)
SELECT night FROM f WHERE r >= 20 AND h >= 0.9 * r""", dates=("night",))
def observed_holidays(spark, sf):
    o = frame(spark, sf, "observation").where("tie1 % 3 < 2 AND NOT (night = DATE '2024-01-03' AND tie1 % 3 = 1)")
    f = o.groupBy("night").agg(F.count_distinct(F.when(F.col("is_holiday").isNotNull(), F.col("listing"))).alias("r"), F.count_distinct(F.when(F.col("is_holiday"), F.col("listing"))).alias("h"))
    return f.where("r >= 20 AND h >= 0.9 * r").select("night")


@query(f"""{with_views('snapshot')}, s AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM snapshot),
g AS (SELECT *, date_diff('microsecond', lag(fetched_at) OVER (PARTITION BY run_id, host ORDER BY fetched_at), fetched_at) / 1e6 AS gap FROM s),
b AS (SELECT host, sum(size) AS stored FROM (SELECT DISTINCT host, blob, size FROM s) GROUP BY host)
SELECT host, count(*) AS responses, min(fetched_at) AS first, max(fetched_at) AS last, round(min(gap) FILTER (WHERE gap < 7200), 6) AS min_gap, round(quantile_cont(gap, 0.5) FILTER (WHERE gap < 7200), 6) AS median_gap, CAST(max(stored) AS BIGINT) AS stored
FROM g JOIN b USING (host) GROUP BY host""")
def host_traffic(spark, sf):
    s = frame(spark, sf, "snapshot").withColumn("host", text.host(F.col("url")))
    return observe.host_traffic(s, "run_id", "host", "fetched_at", "blob", "size", 7200.0).withColumn("min_gap", F.round("min_gap", 6)).withColumn("median_gap", F.round("median_gap", 6))


@query(f"{with_views('snapshot')} SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, status, count(*) AS n FROM snapshot GROUP BY 1, 2")
def status_by_host(spark, sf):
    return frame(spark, sf, "snapshot").groupBy(text.host(F.col("url")).alias("host"), "status").agg(F.count("*").alias("n"))


@query(f"{with_views('snapshot')} SELECT run_id, kind, status, coalesce(nullif(blob, 'b7'), '') AS reason, count(*) AS n FROM snapshot GROUP BY ALL")
def frontier_progress(spark, sf):
    return frame(spark, sf, "snapshot").groupBy("run_id", "kind", "status", F.expr("coalesce(nullif(blob, 'b7'), '')").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{with_views('snapshot')}, newest AS (SELECT * FROM snapshot QUALIFY row_number() OVER (PARTITION BY request_key ORDER BY fetched_at DESC, id) = 1),
b AS (SELECT kind, sum(size) AS stored FROM (SELECT DISTINCT kind, blob, size FROM snapshot) GROUP BY kind)
SELECT kind, status, count(*) AS requests, CAST(max(stored) AS BIGINT) AS stored FROM newest JOIN b USING (kind) GROUP BY kind, status""")
def response_totals(spark, sf):
    s = frame(spark, sf, "snapshot")
    newest = observe.latest(s, ["request_key"], [F.col("fetched_at").desc(), F.col("id")])
    b = s.select("kind", "blob", "size").distinct().groupBy("kind").agg(F.sum("size").alias("stored"))
    return newest.join(b, "kind").groupBy("kind", "status").agg(F.count("*").alias("requests"), F.max("stored").alias("stored"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def run_summary(spark, sf):
    e = frame(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(50)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"{with_views('call')} SELECT task, model, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'cached') AS cached, count(*) FILTER (WHERE status = 'error') AS failed, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(coalesce(sum(micros) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS micros FROM call GROUP BY task, model")
def llm_spend(spark, sf):
    on = lambda s: F.count_if(F.col("status") == s)
    return frame(spark, sf, "call").groupBy("task", "model").agg(on("ok").alias("ok"), on("cached").alias("cached"), on("error").alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("micros"))), F.lit(0)).alias("micros"))


@query(f"{with_views('call')} SELECT id, round(((input_tokens - cached_tokens) * 0.3 + cached_tokens * 0.03 + output_tokens * 1.2) / 1000000, 12) AS cost FROM call")
def call_costs(spark, sf):
    c = F.col
    return frame(spark, sf, "call").select("id", F.round(numeric.call_cost(c("input_tokens"), c("cached_tokens"), c("output_tokens"), F.lit(0.3), F.lit(0.03), F.lit(1.2)), 12).alias("cost"))


@query(f"""{with_views('call')}, k AS (SELECT task, model, sha256(concat_ws(':', task, model, CAST(input_tokens AS VARCHAR))) AS key, micros FROM call WHERE status <> 'error'),
seen AS (SELECT DISTINCT sha256(concat_ws(':', task, model, CAST(input_tokens AS VARCHAR))) AS key FROM call WHERE status = 'cached'),
one AS (SELECT task, model, key, max(micros) AS micros FROM k GROUP BY ALL)
SELECT task, model, count(*) AS planned, count(seen.key) AS hits, CAST(coalesce(sum(micros) FILTER (WHERE seen.key IS NULL), 0) AS BIGINT) AS worst FROM one LEFT JOIN seen USING (key) GROUP BY task, model""")
def dry_run_cost(spark, sf):
    c = frame(spark, sf, "call").withColumn("key", text.sha(F.col("task"), F.col("model"), F.col("input_tokens")))
    hit = c.where("status = 'cached'").select("key", F.lit(1).alias("hit")).distinct()
    one = c.where("status <> 'error'").groupBy("task", "model", "key").agg(F.max("micros").alias("micros"))
    return one.join(hit, "key", "left").groupBy("task", "model").agg(F.count("*").alias("planned"), F.count("hit").alias("hits"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("micros"))), F.lit(0)).alias("worst"))


@query(f"{with_views('call')} SELECT id, job, CAST(sum(micros) OVER (PARTITION BY job ORDER BY called_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent, sum(micros) OVER (PARTITION BY job ORDER BY called_at, id ROWS UNBOUNDED PRECEDING) <= 5000000 AS allowed FROM call")
def running_budget(spark, sf):
    return evaluate.running_budget(frame(spark, sf, "call").withColumn("cost", F.col("micros")), 5_000_000, ["called_at", "id"]).select("id", "job", "spent", "allowed")


@query(f"{with_views('listing')} SELECT villa, count(*) AS n, count(DISTINCT platform) AS platforms FROM listing GROUP BY villa HAVING count(DISTINCT platform) > 1")
def multi_member_groups(spark, sf):
    return frame(spark, sf, "listing").groupBy("villa").agg(F.count("*").alias("n"), F.count_distinct("platform").alias("platforms")).where("platforms > 1")


# ---------------------------------------------------------------- quotes

_REQUESTS = "VALUES ('r1', DATE '2024-01-02', DATE '2024-01-04', 3), ('r2', DATE '2024-01-03', DATE '2024-01-04', 5), ('r3', DATE '2024-01-04', DATE '2024-01-07', 2)"
_QUOTE_SQL = f"""{with_views('listing', 'observation')}, req(request, check_in, check_out, guests) AS ({_REQUESTS}),
newest AS ({_LATEST}),
used AS (
  SELECT r.request, r.check_in, r.guests, n.*, l.base_capacity, greatest(0, r.guests - l.base_capacity) AS xg,
    l.base, l.weekend, l.holiday, l.extra_base, l.extra_weekend, l.extra_holiday
  FROM newest n JOIN req r ON n.night >= r.check_in AND n.night < r.check_out JOIN listing l USING (listing)
), priced AS (
  SELECT *, coalesce(xg, 0) AS k, coalesce(xg, 0) = 0 AS none_extra,
    CASE WHEN price IS NOT NULL THEN true WHEN is_holiday IS NULL THEN holiday IS NOT NULL AND base IS NOT NULL WHEN is_holiday THEN holiday IS NOT NULL ELSE base IS NOT NULL OR weekend IS NOT NULL END AS p_ok,
    CASE WHEN is_holiday IS NULL THEN list_filter([holiday, base, weekend], lambda x: x IS NOT NULL) WHEN is_holiday THEN [holiday] ELSE list_filter([base, weekend], lambda x: x IS NOT NULL) END AS p_list,
    CASE WHEN coalesce(xg, 0) = 0 OR extra_price IS NOT NULL THEN true WHEN is_holiday IS NULL THEN extra_holiday IS NOT NULL AND extra_base IS NOT NULL WHEN is_holiday THEN extra_holiday IS NOT NULL ELSE extra_base IS NOT NULL OR extra_weekend IS NOT NULL END AS x_ok,
    CASE WHEN is_holiday IS NULL THEN list_filter([extra_holiday, extra_base, extra_weekend], lambda x: x IS NOT NULL) WHEN is_holiday THEN [extra_holiday] ELSE list_filter([extra_base, extra_weekend], lambda x: x IS NOT NULL) END AS x_list
  FROM used
), ends AS (
  SELECT *, coalesce(price, CASE WHEN p_ok THEN list_min(p_list) ELSE 0 END) AS p_lo, coalesce(price, CASE WHEN p_ok THEN list_max(p_list) END) AS p_hi,
    CASE WHEN none_extra THEN 0 ELSE coalesce(extra_price, CASE WHEN x_ok THEN list_min(x_list) ELSE 0 END) END AS x_lo,
    CASE WHEN none_extra THEN 0 ELSE coalesce(extra_price, CASE WHEN x_ok THEN list_max(x_list) END) END AS x_hi
  FROM priced
), per AS (
  SELECT listing, request, count(*) AS seen, bool_or(availability IN ('unavailable', 'booked', 'blocked')) AS taken, bool_and(availability = 'available') AS free,
    max(min_nights) FILTER (WHERE night = check_in) AS night_min, sum(p_lo + x_lo * k) AS low, sum(p_hi + x_hi * k) AS high, count(p_hi + x_hi * k) AS closed,
    bool_or(price IS NULL AND p_ok) AS c1, bool_or(price IS NULL AND NOT p_ok) AS c2, bool_or(NOT none_extra AND extra_price IS NULL AND x_ok) AS c3, bool_or(NOT none_extra AND extra_price IS NULL AND NOT x_ok) AS c4,
    min(observed_at) AS oldest
  FROM ends GROUP BY listing, request
), states AS (
  SELECT l.platform, l.listing, r.request, per.*  EXCLUDE (listing, request), l.base_capacity, l.fees_known, date_diff('day', r.check_in, r.check_out) AS nights,
    CASE WHEN r.guests > l.base_capacity + coalesce(l.extra_capacity, 0) THEN 'too_many_guests' WHEN taken THEN 'unavailable'
      WHEN date_diff('day', r.check_in, r.check_out) < coalesce(night_min, l.min_nights) THEN 'below_min_nights'
      WHEN coalesce(seen, 0) < date_diff('day', r.check_in, r.check_out) OR NOT coalesce(free, false) THEN 'unknown' ELSE 'bookable' END AS status
  FROM listing l CROSS JOIN req r LEFT JOIN per ON per.listing = l.listing AND per.request = r.request
), quoted AS (
  SELECT *, CASE WHEN status = 'bookable' THEN CAST(low AS BIGINT) END AS total_low,
    CASE WHEN status = 'bookable' AND closed = seen AND base_capacity IS NOT NULL AND fees_known THEN CAST(high AS BIGINT) END AS total_high,
    CASE WHEN status = 'bookable' THEN array_to_string(list_sort(list_filter([CASE WHEN c1 THEN 'night_price_from_rate_card' END, CASE WHEN c2 THEN 'night_price_unknown' END, CASE WHEN c3 THEN 'extra_guest_price_from_rate_card' END, CASE WHEN c4 THEN 'extra_guest_price_unknown' END, CASE WHEN base_capacity IS NULL THEN 'capacity_unknown' END, CASE WHEN NOT fees_known THEN 'fees_unknown' END], lambda x: x IS NOT NULL)), ',') ELSE '' END AS caveats
  FROM states
), q AS (SELECT *, CASE WHEN status <> 'bookable' THEN NULL WHEN total_high IS NULL THEN 'open' WHEN total_low = total_high THEN 'exact' ELSE 'range' END AS kind FROM quoted)"""


def quotes(spark, sf):
    requests = spark.sql(f"SELECT * FROM ({_REQUESTS}) AS t(request, check_in, check_out, guests)")
    got = quote.quote_stays(frame(spark, sf, "listing"), frame(spark, sf, "observation"), requests, newest_order())
    return got.join(frame(spark, sf, "listing").select("listing", "platform", "villa"), "listing")


@query(f"{_QUOTE_SQL} SELECT listing, request, status, total_low, total_high, kind, caveats, oldest FROM q")
def quote_stay(spark, sf):
    return quotes(spark, sf).select("listing", "request", "status", F.col("total.low").alias("total_low"), F.col("total.high").alias("total_high"), "kind", F.array_join("caveats", ",").alias("caveats"), "oldest")


@query(f"{_QUOTE_SQL} SELECT platform, request, status, coalesce(kind, '') AS kind, count(*) AS n, count(*) FILTER (WHERE oldest < TIMESTAMP '1999-01-01') AS stale FROM q GROUP BY ALL")
def offer_distribution(spark, sf):
    return quotes(spark, sf).groupBy("platform", "request", "status", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("oldest") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("stale"))


_PAIRS = """, bookable AS (SELECT q.listing, platform, request, total_low AS low, villa FROM q JOIN listing USING (listing, platform) WHERE status = 'bookable'),
side AS (SELECT platform, villa, request, min(low) AS low FROM bookable GROUP BY ALL),
gap AS (SELECT a.villa, a.request, CASE WHEN a.low < b.low THEN a.platform WHEN b.low < a.low THEN b.platform END AS cheaper, CAST(greatest(a.low, b.low) AS DOUBLE) / least(a.low, b.low) AS ratio
  FROM side a JOIN side b ON a.villa = b.villa AND a.request = b.request AND a.platform = 'a' AND b.platform = 'b' WHERE a.low > 0 AND b.low > 0)"""


def _gaps(spark, sf):
    side = quotes(spark, sf).where("status = 'bookable'").groupBy("platform", "villa", "request").agg(F.min("total.low").alias("low"))
    return quote.price_gaps(side.where("platform = 'a'"), side.where("platform = 'b'"), ["villa", "request"])


@query(f"{_QUOTE_SQL}{_PAIRS} SELECT villa, request, cheaper, round(ratio, 9) AS ratio FROM gap")
def price_gap(spark, sf):
    return _gaps(spark, sf).withColumn("ratio", F.round("ratio", 9))


@query(f"""{_QUOTE_SQL}{_PAIRS} SELECT request, count(*) AS pairs, round(quantile_cont(ratio, 0.5), 4) AS median_ratio,
round(list_sort(list(ratio))[CAST(least(count(*) - 1, floor(0.9::DOUBLE * count(*))) AS BIGINT) + 1], 4) AS p90_ratio, count(*) FILTER (WHERE cheaper = 'a') AS a_cheaper FROM gap GROUP BY request""")
def gap_summary(spark, sf):
    return quote.gap_summary(_gaps(spark, sf), "request", extra=(F.count_if(F.col("cheaper") == "a").alias("a_cheaper"),))


@query(f"{_QUOTE_SQL}{_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (WHERE n > 1) AS flips FROM (SELECT villa, count(DISTINCT cheaper) AS n FROM gap GROUP BY villa)")
def cheaper_flips(spark, sf):
    return _gaps(spark, sf).groupBy("villa").agg(F.count_distinct("cheaper").alias("n")).agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("flips"))


@query(f"{with_views('listing')} SELECT listing, CASE WHEN is_h IS NULL THEN CASE WHEN holiday IS NOT NULL AND base IS NOT NULL THEN least(holiday, base, coalesce(weekend, base)) ELSE 0 END WHEN is_h THEN coalesce(holiday, 0) ELSE coalesce(least(base, weekend), 0) END AS low, CASE WHEN is_h IS NULL THEN CASE WHEN holiday IS NOT NULL AND base IS NOT NULL THEN greatest(holiday, base, coalesce(weekend, base)) END WHEN is_h THEN holiday ELSE greatest(base, weekend) END AS high FROM (SELECT *, CASE listing % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_h FROM listing)")
def rate_card_range(spark, sf):
    c = F.col
    flag = F.expr("CASE listing % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    return frame(spark, sf, "listing").select("listing", numeric.rate_card(flag, c("base"), c("weekend"), c("holiday")).alias("r")).select("listing", "r.low", "r.high")


@query(f"{with_views('listing')} SELECT listing, seen_at < TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR AS stale, CASE WHEN base_capacity IS NULL THEN NULL ELSE base_capacity + coalesce(extra_capacity, 0) END AS most, base_capacity + coalesce(extra_capacity, 0) >= 4 AS allows FROM listing")
def offer_staleness(spark, sf):
    most = F.col("base_capacity") + F.coalesce("extra_capacity", F.lit(0))
    return frame(spark, sf, "listing").select("listing", F.expr("seen_at < TIMESTAMP_NTZ '1998-06-01' - INTERVAL 24 HOUR").alias("stale"), most.alias("most"), (most >= 4).alias("allows"))


@query(f"{with_views('observation')} SELECT listing, CAST(sum(coalesce(price, 0)) AS BIGINT) AS low, CASE WHEN count(price) = count(*) THEN CAST(sum(price) AS BIGINT) END AS high FROM observation GROUP BY listing")
def money_range_total(spark, sf):
    o = frame(spark, sf, "observation").select("listing", numeric.money(F.coalesce("price", F.lit(0)), F.col("price")).alias("m"))
    return o.groupBy("listing").agg(F.sum("m.low").alias("low"), F.expr("CASE WHEN count(m.high) = count(*) THEN sum(m.high) END").alias("high"))


@query(f"{with_views('listing')} SELECT listing, CAST(floor(base / 7.0) AS BIGINT) AS low, CAST(ceil(weekend / 7.0) AS BIGINT) AS high FROM listing WHERE base IS NOT NULL")
def per_person_share(spark, sf):
    got = frame(spark, sf, "listing").where("base IS NOT NULL").select("listing", numeric.share(numeric.money(F.col("base"), F.col("weekend")), F.lit(7)).alias("m"))
    return got.select("listing", "m.low", "m.high")


_SIDES = f"""{with_views('listing', 'observation')}, o AS (SELECT l.platform, l.villa, night, availability, observed_at, o.listing, tie1, tie2, tie3, tie4 FROM observation o JOIN listing l ON o.listing = l.listing),
n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY villa, platform, night ORDER BY observed_at DESC, listing, tie1, tie2, tie3, tie4) = 1)"""


def _sides(spark, sf):
    o = frame(spark, sf, "observation").join(frame(spark, sf, "listing").select("listing", "platform", "villa"), "listing")
    order = [F.col("observed_at").desc(), F.col("listing"), *newest_order()[1:]]
    return observe.latest(o, ["villa", "platform", "night"], order)


@query(f"""{_SIDES} SELECT a.villa, a.night, (a.availability = 'available' AND b.availability = 'booked') OR (b.availability = 'available' AND a.availability = 'booked') AS hidden
FROM n a JOIN n b ON a.villa = b.villa AND a.night = b.night AND a.platform = 'a' AND b.platform = 'b'
WHERE abs(date_diff('second', a.observed_at, b.observed_at)) <= 200 * 86400 AND a.availability <> 'unknown' AND b.availability <> 'unknown'""", dates=("night",))
def hidden_nights(spark, sf):
    n = _sides(spark, sf)
    return quote.compare_nights(n.where("platform = 'a'"), n.where("platform = 'b'"), ["villa"], 200 * 86400.0)


@query(f"{_SIDES} SELECT coalesce(a.villa, b.villa) AS villa, coalesce(a.night, b.night) AS night, a.availability AS on_a, b.availability AS on_b FROM (SELECT * FROM n WHERE platform = 'a') a FULL JOIN (SELECT * FROM n WHERE platform = 'b') b ON a.villa = b.villa AND a.night = b.night", dates=("night",))
def merged_calendar(spark, sf):
    n = _sides(spark, sf)
    a, b = (n.where(f"platform = '{p}'").select("villa", "night", F.col("availability").alias(f"on_{p}")) for p in "ab")
    return a.join(b, ["villa", "night"], "full")


@query(f"{with_views('listing')} SELECT villa, count(DISTINCT base_capacity) > 1 AS capacity, count(DISTINCT min_nights) > 1 AS min_nights, max(base) > 1.15 * min(base) AS base FROM listing GROUP BY villa HAVING count(DISTINCT platform) > 1")
def field_conflicts(spark, sf):
    per = frame(spark, sf, "listing").groupBy("villa").agg((F.count_distinct("base_capacity") > 1).alias("capacity"), (F.count_distinct("min_nights") > 1).alias("min_nights"), (F.max("base") > 1.15 * F.min("base")).alias("base"), F.count_distinct("platform").alias("p"))
    return per.where("p > 1").drop("p")


@query(f"""{with_views('listing')}, p AS (SELECT platform, sum(rating * rating_count) / sum(rating_count) AS prior FROM listing GROUP BY platform)
SELECT listing, round((5 * prior + rating * rating_count) / (rating_count + 5), 6) AS rating FROM listing JOIN p USING (platform)""")
def bayes_rating(spark, sf):
    rows = frame(spark, sf, "listing")
    prior = rows.groupBy("platform").agg((F.sum(F.col("rating") * F.col("rating_count")) / F.sum("rating_count")).alias("prior"))
    return rows.join(prior, "platform").select("listing", F.round(numeric.shrink(F.col("rating"), F.col("rating_count"), F.col("prior")), 6).alias("rating"))


@query(f"{with_views('listing')} SELECT villa, round(sum(rating * rating_count) / nullif(sum(rating_count), 0), 2) AS rating, CAST(sum(rating_count) AS BIGINT) AS n FROM listing GROUP BY villa")
def combined_rating(spark, sf):
    return frame(spark, sf, "listing").groupBy("villa").agg(F.round(F.try_divide(F.sum(F.col("rating") * F.col("rating_count")), F.sum("rating_count")), 2).alias("rating"), F.sum("rating_count").alias("n"))


@query(f"""{with_views('listing')} SELECT listing, villa, total, count(*) OVER (PARTITION BY villa, total) = 1 AND total = min(total) OVER (PARTITION BY villa) AS cheaper, row_number() OVER (PARTITION BY villa ORDER BY total NULLS LAST, platform, listing) AS place FROM (SELECT *, base AS total FROM listing)""")
def booking_rows(spark, sf):
    rows = frame(spark, sf, "listing").withColumn("total", F.col("base"))
    same, villa = W.partitionBy("villa", "total"), W.partitionBy("villa")
    return rows.select("listing", "villa", "total", ((F.count("*").over(same) == 1) & (F.col("total") == F.min("total").over(villa))).alias("cheaper"), F.row_number().over(villa.orderBy(F.col("total").asc_nulls_last(), "platform", "listing")).alias("place"))


@query(f"""{with_views('snapshot')}, m AS (SELECT *, sum(CASE WHEN status = 429 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY fetched_at ROWS UNBOUNDED PRECEDING) AS g FROM snapshot)
SELECT run_id, min(fetched_at) AS first, max(fetched_at) AS last, count(*) AS length FROM m WHERE status = 429 GROUP BY run_id, g HAVING count(*) >= 3""")
def refusal_streaks(spark, sf):
    return observe.streaks(frame(spark, sf, "snapshot"), ["run_id"], ["fetched_at"], F.col("status") == 429).where("length >= 3")


@query(f"""{with_views('snapshot')} SELECT id, CASE WHEN status = 200 THEN 'done' WHEN status = 404 THEN 'skipped' WHEN id % 7 >= 5 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN status = 429 THEN least(3600.0::DOUBLE, 120 * power(2.0, id % 7)) END AS wait FROM snapshot""")
def frontier_states(spark, sf):
    s = frame(spark, sf, "snapshot")
    state = observe.frontier_after(F.col("status"), F.col("id") % 7, F.col("status") == 200, F.col("status") == 404)
    return s.select("id", state.alias("state"), F.when(F.col("status") == 429, numeric.backoff(F.col("id") % 7, 120, 3600)).alias("wait"))


@query(f"""{with_views('snapshot')}, f AS (SELECT id, CASE WHEN status = 429 THEN 'pending' WHEN status = 404 THEN 'in_progress' ELSE 'done' END AS status, fetched_at AS next_attempt_at, fetched_at AS claimed_at FROM snapshot)
SELECT id, status FROM f WHERE (status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-01-15') OR (status = 'in_progress' AND claimed_at < TIMESTAMP '2024-01-15' - INTERVAL 10 MINUTE)""")
def frontier_due(spark, sf):
    f = frame(spark, sf, "snapshot").select("id", F.expr("CASE WHEN status = 429 THEN 'pending' WHEN status = 404 THEN 'in_progress' ELSE 'done' END").alias("status"), F.col("fetched_at").alias("next_attempt_at"), F.col("fetched_at").alias("claimed_at"))
    return observe.frontier_due(f, F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("id", "status")


@query(f"""{with_views('listing')}, e AS (SELECT platform, count(*) AS predicted FROM listing WHERE villa % 10 = 0 GROUP BY platform)
SELECT platform, round(least(predicted * 0.9 / 0.6, 100), 6) AS estimate, round(least(predicted * 0.8 / 0.7, 100), 6) AS low, round(least(predicted * 0.95 / 0.5, 100), 6) AS high FROM e""")
def corrected_overlap(spark, sf):
    e = frame(spark, sf, "listing").where("villa % 10 = 0").groupBy("platform").agg(F.count("*").alias("predicted"))
    triple = lambda a, b, c: F.struct(F.lit(a).alias("estimate"), F.lit(b).alias("low"), F.lit(c).alias("high"))
    got = e.select("platform", quote.corrected_overlap(F.col("predicted"), triple(0.9, 0.8, 0.95), triple(0.6, 0.5, 0.7), F.lit(100)).alias("o"))
    return got.select("platform", *(F.round(f"o.{c}", 6).alias(c) for c in ("estimate", "low", "high")))
