"""Text, dates, sources, streams, and relational forms beyond the listing domain."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.functions import calendar, numbers, numeric, text
from obsmill.operators import match
from obsmill.plans.surrogate import as_text, frame, with_views
from obsmill.sources import readers
from obsmill.streaming import streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = as_text(sql, *dates)
        return f

    return add


# ---------------------------------------------------------------- text

_MESSY = "concat('  ', p_name, '‌ كي ', CASE p_partkey % 3 WHEN 0 THEN '٤٥۶' WHEN 1 THEN 'ـ' ELSE '‌‌' END, p_type, ' \n\n ', p_brand, '‌')"


@query(f"""WITH m AS (SELECT p_partkey AS id, {_MESSY} AS t FROM part), a AS (SELECT id, translate(t, 'كي٤٥۶', 'کی456') AS t FROM m), b AS (SELECT id, regexp_replace(regexp_replace(replace(t, 'ـ', ''), '‌+', '‌', 'g'), '[ \\t]+', ' ', 'g') AS t FROM a),
c AS (SELECT id, regexp_replace(t, '[ ‌]* [ ‌]*', ' ', 'g') AS t FROM b) SELECT id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(trim(x), '^‌|‌$', '', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM c""")
def normalize_text(spark, sf):
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.normalize(F.expr(_MESSY)).alias("t"))


@query("""WITH t AS (SELECT p_partkey AS id, regexp_replace(p_name, '\\s+', '', 'g') AS s, regexp_replace(p_type, '\\s+', '', 'g') AS u FROM part), g AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(s) - 1, 1)), lambda i: substr(s, i, 3))) AS a, list_distinct(list_transform(range(1, greatest(len(u) - 1, 1)), lambda i: substr(lower(u), i, 3))) AS b FROM t)
SELECT id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) ELSE 0 END, 9) AS similarity FROM g""")
def trigram_jaccard(spark, sf):
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(text.jaccard(text.trigrams(F.col("p_name")), text.trigrams(F.lower("p_type"))), 9).alias("similarity"))


@query("SELECT doc_id, length(substr(text, 5, 20)) > 0 AND contains(text, substr(text, 5, 20)) AS said, contains(text, 'token') AS token, contains(' ' || text || ' ', ' the ') AS mentions FROM documents")
def span_check(spark, sf):
    t = F.col("text")
    return frame(spark, sf, "documents").select("doc_id", text.verbatim(t, F.substring(t, 5, 20)).alias("said"), text.verbatim(t, F.lit("token")).alias("token"), text.mentions(t, F.lit("the")).alias("mentions"))


@query("SELECT p_partkey AS id, 'Size ' || p_size || ' of ' || p_brand AS t, 2 AS n FROM part")
def slot_render(spark, sf):
    template = F.lit("Size {F1} of {F2}")
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.render(template, F.array(F.lit("F1"), F.lit("F2")), F.array(F.col("p_size").cast("string"), "p_brand")).alias("t"), F.size(text.slots(template)).alias("n"))


@query("SELECT o_orderkey, sha256(o_orderkey || ':' || o_custkey || ':' || o_orderpriority) AS key FROM orders")
def cache_key(spark, sf):
    return frame(spark, sf, "orders").select("o_orderkey", text.sha(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")).alias("key"))


_AMOUNTS = ("۱۲٫۵ میلیون تومان", "5 میلیون و 500 هزار", "1,500,000 ریال", "دو میلیون", "3 هزار و 2 میلیون", "700", "2 نفر 500 هزار", "1.5 میلیارد ریال")
_RIALS = (125000000, 55000000, 1500000, None, None, 7000, None, 1500000000)


@query(f"SELECT p_partkey AS id, CAST(CASE p_partkey % 8 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_RIALS) if v is not None)} END AS BIGINT) AS rial FROM part")
def parse_money(spark, sf):
    t = F.element_at(F.array(*map(F.lit, _AMOUNTS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), numbers.parse_money(t).alias("rial"))


_TOLD = ("چهار نفر", "دو میلیون و پانصد هزار", "۲ تا ۳ میلیون", "پنج شنبه", "دو ساعت و نیم", "بیست و پنج", "دو سه نفر", "چهارنفره")
_MENTIONED = ("4", "2500000", "2 3000000 2000000", "", "2 2.5 0.5", "25", "2 3", "4")


@query(f"SELECT p_partkey AS id, CASE p_partkey % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in enumerate(_MENTIONED))} END AS said FROM part")
def number_mentions(spark, sf):
    t = F.element_at(F.array(*map(F.lit, _TOLD)), (F.col("p_partkey") % 8 + 1).cast("int"))
    got = frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), numbers.number_mentions(t).alias("n"))
    plain = F.transform("n", lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return got.select("id", F.array_join(plain, " ").alias("said"))


_HEADS = "WITH n AS (SELECT s_suppkey, 'nation ' || n_name || ' - ' || r_name AS place, n_regionkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"{_HEADS} SELECT s_suppkey AS id, CASE WHEN n_nationkey % 4 <> 0 THEN 'nation_' || n_nationkey ELSE 'region_' || n_regionkey END AS slug FROM n")
def place_resolution(spark, sf):
    """Names in parts of an address; a locality beats its city, the last of several wins."""
    n, r = frame(spark, sf, "nation"), frame(spark, sf, "region")
    named = frame(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    asked = named.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation "), "n_name", F.lit(" - "), "r_name").alias("place"))
    known = n.where("n_nationkey % 4 <> 0").select(text.place_key(F.col("n_name"), ("nation ",)).alias("key"), F.concat(F.lit("nation_"), "n_nationkey").alias("slug"), F.lit(1).alias("local"))
    known = known.unionByName(r.select(text.place_key(F.col("r_name")).alias("key"), F.concat(F.lit("region_"), "r_regionkey").alias("slug"), F.lit(0).alias("local")))
    parts = asked.select("id", F.posexplode(F.split("place", r"\s*-\s*")).alias("at", "part")).withColumn("key", text.place_key(F.col("part"), ("nation ",)))
    return parts.join(F.broadcast(known), "key").groupBy("id").agg(F.max_by("slug", F.struct("local", "at")).alias("slug"))  # the gazetteer is a config file


@query(f"{_HEADS} SELECT s_suppkey AS id FROM n WHERE n_regionkey = 2 OR n_nationkey = 7")
def parent_filter(spark, sf):
    """Suppliers whose nation is wanted, or is a child of a wanted region."""
    wanted = frame(spark, sf, "nation").where("n_regionkey = 2 OR n_nationkey = 7").select("n_nationkey")
    return frame(spark, sf, "supplier").join(wanted, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("id"))


# ---------------------------------------------------------------- dates

@query("SELECT o_orderkey AS id, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT), INTERVAL 1 DAY)) AS DATE) AS night FROM orders", dates=("night",))
def night_expansion(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return frame(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.explode(calendar.nights(d, F.date_add(d, (F.col("o_orderkey") % 4 + 1).cast("int")))).alias("night"))


@query("WITH d AS (SELECT DISTINCT o_custkey % 30 AS k, CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT k, day, day - CAST(row_number() OVER (PARTITION BY k ORDER BY day) AS INT) AS i FROM d) SELECT k, min(day) AS first, max(day) AS last, count(*) AS days FROM g GROUP BY k, i", dates=("first", "last"))
def date_islands(spark, sf):
    o = frame(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("k"), F.col("o_orderdate").cast("date").alias("day"))
    return calendar.runs(o, "day", "k")


@query("""WITH y(jy, leap) AS (SELECT y, y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) FROM range(1370, 1386) t(y)), s AS (SELECT jy, leap, DATE '2021-03-21' - CAST(coalesce((SELECT sum(CASE WHEN z % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 366 ELSE 365 END) FROM range(1370, 1400) u(z) WHERE z >= jy), 0) AS INT) AS start FROM y),
o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders), j AS (SELECT id, jy, CAST(day - start AS INT) AS k FROM o JOIN s ON day >= start AND day < start + CASE WHEN leap THEN 366 ELSE 365 END)
SELECT id, CAST(jy AS INT) AS jy, CAST(CASE WHEN k < 186 THEN k // 31 + 1 ELSE (k - 186) // 30 + 7 END AS INT) AS jm, CAST(CASE WHEN k < 186 THEN k % 31 + 1 ELSE (k - 186) % 30 + 1 END AS INT) AS jd FROM j""")
def jalali_dim(spark, sf):
    o = frame(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    return calendar.with_jalali(o, "day", 1370, 1385).select("id", "jalali.jy", "jalali.jm", "jalali.jd")


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, isodow(o_orderdate) - 1 AS w FROM orders) SELECT id, CASE WHEN w = 4 THEN d ELSE d + CAST((3 - w + 7) % 7 AS INT) END AS check_in, w = 4 AS partial, d + CAST((5 - w + 7) % 7 AS INT) AS saturday FROM o""", dates=("check_in", "saturday"))
def weekend_resolver(spark, sf):
    d = F.col("o_orderdate").cast("date")
    got = frame(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), calendar.weekend(d).alias("w"), calendar.next_weekday(d, 5).alias("saturday"))
    return got.select("id", F.col("w.check_in").alias("check_in"), F.col("w.partial").alias("partial"), "saturday")


@query("SELECT event_id AS id, CAST(ts + INTERVAL '3 hours 30 minutes' AS DATE) AS day FROM events", dates=("day",))
def iran_day(spark, sf):
    return frame(spark, sf, "events").select(F.col("event_id").alias("id"), calendar.iran_today(F.col("ts")).alias("day"))


@query("SELECT CAST(g AS DATE) AS day, 'weekly' AS kind FROM generate_series(DATE '2023-03-21', DATE '2024-03-19', INTERVAL 1 DAY) t(g) WHERE isodow(g) = 5 UNION ALL VALUES (DATE '2023-03-21', 'fixed'), (DATE '2023-04-02', 'fixed'), (DATE '2023-06-15', 'observed')", dates=("day",))
def holiday_calendar(spark, sf):
    days = calendar.jalali_days(spark, 1402, 1402)
    observed = spark.createDataFrame([(date(2023, 6, 15),)], "day date")
    return calendar.days_off(days, [(1, 1, "new year"), (1, 13, "nature day")], observed).select("day", "kind")


# ---------------------------------------------------------------- sources

@query("SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)")
def html_links(spark, sf):
    got = frame(spark, sf, "pages").select("page_id", readers.links(F.col("html")).alias("l"))
    return got.select("page_id", F.size("l").cast("bigint").alias("n"), F.array_join("l", " ").alias("links"))


@query("SELECT page_id, 'n' || page_id AS name, page_id % 5 AS rooms FROM pages")
def html_objects(spark, sf):
    """Objects that a page's scripts push, escaped, read back as typed rows."""
    chunk = F.to_json(F.array(F.lit(1).cast("string"), F.concat(F.lit("x:"), F.to_json(F.struct(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"), (F.col("page_id") % 5).alias("rooms"))))))
    page = F.concat("html", F.lit("<script>self.__next_f.push("), chunk, F.lit(")</script>"))
    objects = frame(spark, sf, "pages").select("page_id", F.explode(readers.page_objects(page)).alias("o"))
    return objects.select("page_id", F.from_json("o", "name string, rooms bigint").alias("r")).select("page_id", "r.name", "r.rooms")


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS distinct_pages FROM pages GROUP BY 1")
def page_discovery(spark, sf):
    clean = F.regexp_replace("url", "[?#].*$", "")
    return frame(spark, sf, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(clean).alias("distinct_pages"))


@query("SELECT conv_id, string_agg(substr(text, 1, 500), '|' ORDER BY turn DESC) AS recent, count(*) AS n FROM (SELECT * FROM conversations WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY conv_id")
def reviews_recent(spark, sf):
    c = frame(spark, sf, "conversations").where("text <> ''").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 2")
    cut = F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, 500).alias("t")))), lambda x: x["t"])
    return c.groupBy("conv_id").agg(F.array_join(cut, "|").alias("recent"), F.count("*").alias("n"))


@query(f"{with_views('photo')} SELECT owner, count(*) AS photos, min(photo) AS first FROM photo GROUP BY owner")
def photo_first(spark, sf):
    return frame(spark, sf, "photo").groupBy("owner").agg(F.count("*").alias("photos"), F.min_by("photo", F.struct("owner", "photo")).alias("first"))


_NEAR_KEPT = "len(list_filter(kept, lambda q: len(list_filter(list_zip(q, h.v), lambda p: (p[1] > 0) <> (p[2] > 0))) <= 26)) > 0"


@query(f"""{with_views('photo', recursive=True)}, h AS (SELECT photo, owner, v, row_number() OVER (PARTITION BY owner ORDER BY photo) AS k FROM photo),
fold AS (SELECT owner, k, photo, true AS stays, [v] AS kept FROM h WHERE k = 1 UNION ALL
  SELECT h.owner, h.k, h.photo, NOT ({_NEAR_KEPT}), CASE WHEN {_NEAR_KEPT} THEN kept ELSE list_append(kept, h.v) END FROM fold JOIN h ON h.owner = fold.owner AND h.k = fold.k + 1)
SELECT owner, photo FROM fold WHERE stays""")
def gallery_dedupe(spark, sf):
    """Photos of an owner in order, without those close to one kept before."""
    from obsmill.plans.matching import _hashes

    p = frame(spark, sf, "photo").join(_hashes(spark, sf), F.col("photo") == F.col("id")).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("photo", "h"))).alias("all"))
    keep = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: match.hamming(k["h"], x["h"]) <= 26), acc).otherwise(F.concat(acc, F.array(x))))
    return p.select("owner", F.explode(keep).alias("k")).select("owner", "k.photo")


# ---------------------------------------------------------------- streams (batch equivalents as oracles)

def _closed(delay: str) -> str:
    return f"e <= (SELECT max(ts) FROM events) - INTERVAL {delay}"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS e FROM events) WHERE {_closed('10 MINUTE')} GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    got = streams.replay(streams.windowed(streams.events(spark, sf), "1 hour"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"WITH w AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS s, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE + INTERVAL 1 HOUR AS e FROM events, range(2) t(k)) SELECT s AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE {_closed('10 MINUTE')} GROUP BY 1, 2")
def stream_sliding(spark, sf):
    got = streams.replay(streams.windowed(streams.events(spark, sf), "1 hour", "30 minutes"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM i GROUP BY user_id, k) SELECT user_id, start, n FROM s WHERE {_closed('10 MINUTE')}""")
def stream_session(spark, sf):
    got = streams.replay(streams.sessions(streams.events(spark, sf)))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedupe(spark, sf):
    e = streams.events(spark, sf)
    return streams.replay(streams.first_of(e.union(e), ["event_id"])).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_newest_wins(spark, sf):
    e = streams.events(spark, sf).select("user_id", "ts", "event_id")
    got = streams.replay(streams.newest_wins(e, "user_id"), "complete")
    return got.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click' GROUP BY 1")
def stream_static_join(spark, sf):
    e = streams.events(spark, sf).where("event_type = 'click'")
    joined = e.join(frame(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", F.col("c_mktsegment").alias("segment"))
    return streams.replay(joined).groupBy("segment").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT user_id AS request, ts, CASE WHEN value >= 60 THEN 'ok' WHEN value < 2 THEN 'gone' ELSE 'error' END AS o FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ts) AS k FROM o), f AS (SELECT request, min(k) FILTER (WHERE o <> 'error') AS first FROM n GROUP BY request), c AS (SELECT request, max(k) AS total FROM n GROUP BY request)
SELECT request, CASE WHEN coalesce(first, 999999) <= 5 THEN (SELECT CASE WHEN o = 'ok' THEN 'done' ELSE 'skipped' END FROM n WHERE n.request = f.request AND k = first) WHEN total >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(least(coalesce(first - 1, total), total, 5) AS INT) AS attempts FROM f JOIN c USING (request)""")
def stream_frontier(spark, sf):
    e = streams.events(spark, sf).select(F.col("user_id").alias("request"), "ts", F.col("event_id").alias("event"), F.expr("CASE WHEN value >= 60 THEN 'ok' WHEN value < 2 THEN 'gone' ELSE 'error' END").alias("outcome"))
    return streams.latest(streams.replay(streams.frontier(e))).select("request", "status", "attempts")


# ---------------------------------------------------------------- relational forms

@query("SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS n, round(sum(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_balance(spark, sf):
    s = frame(spark, sf, "supplier").join(frame(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(frame(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("balance")).select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "balance")


@query("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(spark, sf):
    c = frame(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_orders(spark, sf):
    return spark.sql("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", orders=frame(spark, sf, "orders"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def intersect_keys(spark, sf):
    return frame(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey").intersect(frame(spark, sf, "orders").where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_keys(spark, sf):
    return frame(spark, sf, "customer").select("c_custkey").exceptAll(frame(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct())


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def anti_join_customers(spark, sf):
    return frame(spark, sf, "customer").join(frame(spark, sf, "orders").where("o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_view(spark, sf):
    """The last view before each purchase: one shuffle and sort by user, no join."""
    e = frame(spark, sf, "events").where("event_type IN ('purchase', 'view')")
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True)
    spec = W.partitionBy("user_id").orderBy("ts", F.desc(F.col("event_type") == "view")).rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("before", seen.over(spec)).where("event_type = 'purchase'").select("event_id", "before")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    rows = frame(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS moving FROM lineitem")
def moving_sum(spark, sf):
    spec = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").rowsBetween(-3, 0)
    return frame(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(F.sum("l_quantity").over(spec), 4).alias("moving"))


@query("SELECT p_type, CAST(sum(p_size) FILTER (WHERE p_brand = 'Brand#1') AS BIGINT) AS b1, CAST(sum(p_size) FILTER (WHERE p_brand = 'Brand#2') AS BIGINT) AS b2 FROM part GROUP BY p_type")
def pivot_brand(spark, sf):
    return frame(spark, sf, "part").groupBy("p_type").pivot("p_brand", ["Brand#1", "Brand#2"]).sum("p_size").toDF("p_type", "b1", "b2")


@query("SELECT s_suppkey, t.o_orderkey FROM supplier, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = s_suppkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def lateral_top(spark, sf):
    top = frame(spark, sf, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 2")
    return frame(spark, sf, "supplier").join(top, F.col("o_custkey") == F.col("s_suppkey")).select("s_suppkey", "o_orderkey")


@query("SELECT o_orderkey, coalesce(least(3600.0::DOUBLE, 120 * power(2.0, o_orderkey % 8)), 0) AS wait, round(0.5 + (o_orderkey % 3 - 1) * (o_orderkey % 10) / 20.0, 6) AS vlm FROM orders")
def scalar_rules(spark, sf):
    k = F.col("o_orderkey")
    return frame(spark, sf, "orders").select("o_orderkey", numeric.backoff(k % 8, 120, 3600).alias("wait"), F.round(0.5 + (k % 3 - 1) * (k % 10) / 20.0, 6).alias("vlm"))
