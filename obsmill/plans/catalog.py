"""Catalogue projections, photos, coverage reports, display text and verification."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.functions import display, geo, text
from obsmill.operators import match
from obsmill.plans.surrogate import as_text, frame, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = as_text(sql, *dates)
        return f

    return add


@query("SELECT p_partkey AS id, lower(trim(p_name)) AS title, length(p_name) >= 10 AS long_enough, 'observed' AS method FROM part")
def listing_projection(spark, sf):
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(text.normalize(F.col("p_name"))).alias("title"), (F.length("p_name") >= 10).alias("long_enough"), F.lit("observed").alias("method"))


_CODES = "(VALUES ('Brand#1', 'pool'), ('Brand#2', 'parking'), ('Brand#3', 'pool')) AS m(code, feature)"


@query(f"SELECT p_size AS listing, feature, bool_or(p_partkey % 3 = 0) AS present FROM part JOIN {_CODES} ON code = p_brand GROUP BY ALL")
def amenity_features(spark, sf):
    """Amenity codes to features; yes wins where codes disagree. The code table is a config file."""
    codes = spark.createDataFrame([("Brand#1", "pool"), ("Brand#2", "parking"), ("Brand#3", "pool")], "code string, feature string")
    return frame(spark, sf, "part").join(F.broadcast(codes), F.col("code") == F.col("p_brand")).groupBy(F.col("p_size").alias("listing"), "feature").agg(F.bool_or(F.col("p_partkey") % 3 == 0).alias("present"))


@query("SELECT o_custkey AS owner, list_sort(list(o_orderkey))[k + 1] AS photo, CAST(k AS INT) AS position FROM orders, range(3) t(k) GROUP BY o_custkey, k HAVING count(*) > k")
def photo_positions(spark, sf):
    """The first three photos of each listing, with their positions."""
    photos = frame(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("photos"))
    return photos.select("owner", F.posexplode(F.slice("photos", 1, 3)).alias("position", "photo"))


@query("SELECT o_custkey % 500 AS hash, arg_min(o_orderkey, o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1")
def first_url_of_hash(spark, sf):
    return frame(spark, sf, "orders").groupBy((F.col("o_custkey") % 500).alias("hash")).agg(F.min_by("o_orderkey", F.struct("o_orderkey")).alias("first"), F.count("*").alias("n"))


@query(f"{with_views('photo')} SELECT photo, owner FROM photo WHERE owner IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 1) AND photo % 2 = 0")
def photos_of_listings(spark, sf):
    wanted = frame(spark, sf, "customer").where("c_custkey % 9 = 1").select(F.col("c_custkey").alias("owner"))
    return frame(spark, sf, "photo").where("photo % 2 = 0").join(wanted, "owner", "left_semi").select("photo", "owner")


@query(f"{with_views('photo')}, t(tag, threshold) AS (VALUES ('pool', 0.1::DOUBLE), ('sea', 0.05)), s AS (SELECT photo, owner, tag, CAST(v[CASE tag WHEN 'pool' THEN 1 ELSE 2 END] AS DOUBLE) AS score FROM photo, t) SELECT DISTINCT owner, s.tag FROM s JOIN t USING (tag) WHERE score >= threshold")
def photo_features_seen(spark, sf):
    """Features that a listing's photos show at their stored thresholds."""
    t = spark.createDataFrame([("pool", 0.1), ("sea", 0.05)], "tag string, threshold double")
    scores = frame(spark, sf, "photo").select("owner", F.explode(F.array(F.struct(F.lit("pool").alias("tag"), F.col("v")[0].cast("double").alias("score")), F.struct(F.lit("sea").alias("tag"), F.col("v")[1].cast("double").alias("score")))).alias("s")).select("owner", "s.tag", "s.score")
    return scores.join(F.broadcast(t), "tag").where("score >= threshold").select("owner", "tag").distinct()


@query(f"""{with_views('photo')} SELECT owner % 3 AS platform, count(*) AS selected, count(*) FILTER (WHERE photo % 4 = 0) AS downloaded, count(*) FILTER (WHERE photo % 4 = 1) AS failed, round(CAST(count(*) FILTER (WHERE photo % 4 < 3) AS DOUBLE) / count(*), 9) AS coverage FROM photo GROUP BY 1""")
def photo_coverage(spark, sf):
    at = lambda k: F.count_if(F.col("photo") % 4 == k)
    return frame(spark, sf, "photo").groupBy((F.col("owner") % 3).alias("platform")).agg(F.count("*").alias("selected"), at(0).alias("downloaded"), at(1).alias("failed"), F.round(F.count_if(F.col("photo") % 4 < 3) / F.count("*"), 9).alias("coverage"))


@query(f"{with_views('listing')} SELECT platform, count(*) AS listings, count(base) AS priced, count(*) FILTER (WHERE base_capacity IS NULL) AS no_capacity, count(DISTINCT villa) AS villas, CAST(sum(rating_count) AS BIGINT) AS ratings FROM listing GROUP BY platform")
def inventory(spark, sf):
    return frame(spark, sf, "listing").groupBy("platform").agg(F.count("*").alias("listings"), F.count("base").alias("priced"), F.count_if(F.col("base_capacity").isNull()).alias("no_capacity"), F.count_distinct("villa").alias("villas"), F.sum("rating_count").alias("ratings"))


@query(f"{with_views('snapshot')}, h AS (SELECT run_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n FROM snapshot GROUP BY ALL) SELECT run_id, max(n) * 3.5::DOUBLE AS seconds FROM h GROUP BY run_id")
def capture_estimate(spark, sf):
    """The busiest host times the pacing."""
    h = frame(spark, sf, "snapshot").groupBy("run_id", text.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return h.groupBy("run_id").agg((F.max("n") * 3.5).alias("seconds"))


@query("SELECT lang AS queue, count(*) AS cases, count(l.doc_id) AS done, count(*) FILTER (WHERE toxic = 1) AS flagged FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def review_progress(spark, sf):
    done = frame(spark, sf, "labels").select("doc_id", "toxic", F.lit(1).alias("d"))
    return frame(spark, sf, "documents").select("doc_id", "lang").join(done, "doc_id", "left").groupBy(F.col("lang").alias("queue")).agg(F.count("*").alias("cases"), F.count("d").alias("done"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@query("SELECT p_name AS place, count(*) AS n FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1 ORDER BY n DESC, place LIMIT 10")
def top_unresolved(spark, sf):
    return frame(spark, sf, "part").where("p_brand <> 'Brand#1'").groupBy(F.col("p_name").alias("place")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(10)


@query("SELECT p_brand, p_partkey AS id FROM part WHERE p_size % 2 <> p_partkey % 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5")
def first_disagreements(spark, sf):
    bad = frame(spark, sf, "part").where("p_size % 2 <> p_partkey % 2").withColumn("k", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")))
    return bad.where("k <= 5").select("p_brand", F.col("p_partkey").alias("id"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 AS INT) AS stayed FROM orders", dates=("stayed",))
def relative_stay_date(spark, sf):
    told = F.concat(F.lit("اقامت "), text.persian_digits((F.col("o_orderkey") % 60).cast("string")), F.lit(" روز پیش"))
    days = F.regexp_extract(text.latin_digits(told), r"(\d+)\s*روز پیش", 1).cast("int")
    return frame(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_sub(F.col("o_orderdate").cast("date"), days).alias("stayed"))


_FA = "translate(replace(format('{:,}', CAST(%s AS BIGINT)), ',', '٬'), '0123456789', '۰۱۲۳۴۵۶۷۸۹')"


@query(f"{with_views('listing')} SELECT listing, CASE WHEN weekend IS NULL THEN 'دست‌کم ' || {_FA % '(base // 10)'} || ' تومان' WHEN least(base, weekend) = greatest(base, weekend) THEN {_FA % '(base // 10)'} || ' تومان' ELSE {_FA % '(least(base, weekend) // 10)'} || ' تا ' || {_FA % '(greatest(base, weekend) // 10)'} || ' تومان' END AS price FROM listing WHERE base IS NOT NULL")
def display_prices(spark, sf):
    low, high = F.when(F.col("weekend").isNull(), F.col("base")).otherwise(F.least("base", "weekend")), F.when(F.col("weekend").isNotNull(), F.greatest("base", "weekend"))
    return frame(spark, sf, "listing").where("base IS NOT NULL").select("listing", display.toman(low, high).alias("price"))


def _km(tenths: str) -> str:
    """SQL of kilometres from tenths of one."""
    return f"{_FA % f'({tenths} // 10)'} || CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '٫' || {_FA % f'({tenths} % 10)'} END"


@query(f"""SELECT id, CASE WHEN high < 1000 THEN {_FA % '(low // 50 * 50)'} || ' تا ' || {_FA % '((high + 49) // 50 * 50)'} || ' متر'
ELSE {_km('(low // 100)')} || ' تا ' || {_km('((high + 99) // 100)')} || ' کیلومتر' END AS metres FROM (SELECT p_partkey AS id, p_partkey * 3 AS low, p_partkey * 3 + 90 AS high FROM part)""")
def display_ranges(spark, sf):
    low = F.col("p_partkey") * 3
    return frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), display.metres_range(low, low + 90).alias("metres"))


@query("SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' END AS kind FROM pages")
def media_types(spark, sf):
    heads = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in ("FFD8FFE000104A464946", "89504E470D0A1A0A", "52494646000000005745425056503820", "00000000"))), (F.col("page_id") % 4 + 1).cast("int"))
    return frame(spark, sf, "pages").select(F.col("page_id").alias("id"), text.media_type(heads).alias("kind"))


@query("""WITH p AS (SELECT conv_id AS id, list_distinct(list(turn)) AS cited, count(*) AS n, conv_id % 3 = 0 AS single FROM conversations GROUP BY conv_id)
SELECT id, len(list_filter(cited, lambda x: x > 3)) AS unknown, len(cited) = 1 AND NOT single AS unlabelled FROM p""")
def summary_citations(spark, sf):
    """Points of a summary cite known reviews; one that rests on a single review says so."""
    p = frame(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_set("turn").alias("cited"))
    known = F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))
    return p.select("id", F.size(F.array_except("cited", known)).cast("bigint").alias("unknown"), ((F.size("cited") == 1) & (F.col("id") % 3 != 0)).alias("unlabelled"))


@query("SELECT event_type AS model, round(count(*) FILTER (WHERE value >= 20) / CAST(count(*) AS DOUBLE), 9) AS written, round(count(*) FILTER (WHERE value < 20 AND value >= 5) / CAST(count(*) AS DOUBLE), 9) AS template, round(count(*) FILTER (WHERE value < 5) / CAST(count(*) AS DOUBLE), 9) AS failed FROM events GROUP BY 1")
def explanation_sources(spark, sf):
    share = lambda cond: F.round(F.count_if(cond) / F.count("*"), 9)
    v = F.col("value")
    return frame(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(share(v >= 20).alias("written"), share((v < 20) & (v >= 5)).alias("template"), share(v < 5).alias("failed"))


@query(f"{with_views('gold')}, f(floor) AS (VALUES (0.5::DOUBLE), (0.7), (0.9)), j AS (SELECT label, 0.5 + (id % 50) / CAST(100 AS DOUBLE) AS c, CASE id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'non_match' ELSE 'unsure' END AS v FROM gold WHERE label <> 'unsure') SELECT floor, count(*) FILTER (WHERE v = 'match' AND label = 'match' AND c >= floor) AS tp, count(*) FILTER (WHERE v = 'match' AND label <> 'match' AND c >= floor) AS fp, count(*) FILTER (WHERE v = 'unsure' OR c < floor) AS unsure FROM j, f GROUP BY floor")
def judge_by_floor(spark, sf):
    j = frame(spark, sf, "gold").where("label <> 'unsure'").select("label", (0.5 + (F.col("id") % 50) / 100).alias("c"), F.expr("CASE id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'non_match' ELSE 'unsure' END").alias("v"))
    at = j.select("*", F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))).alias("floor"))
    yes = (F.col("v") == "match") & (F.col("c") >= F.col("floor"))
    return at.groupBy("floor").agg(F.count_if(yes & (F.col("label") == "match")).alias("tp"), F.count_if(yes & (F.col("label") != "match")).alias("fp"), F.count_if((F.col("v") == "unsure") | (F.col("c") < F.col("floor"))).alias("unsure"))


_COAST = ((51.0, 36.2), (51.3, 36.35), (51.7, 36.3), (52.0, 36.5))
_K = "(6371008.8 * pi() / 180)"


@query(f"""{with_views('spot')}, s(a_lon, a_lat, b_lon, b_lat) AS (VALUES {', '.join(f'({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)' for a, b in zip(_COAST, _COAST[1:]))}),
d AS (SELECT id, (a_lon - lon) * cos(radians(lat)) * {_K} AS ax, (a_lat - lat) * {_K} AS ay, (b_lon - lon) * cos(radians(lat)) * {_K} AS bx, (b_lat - lat) * {_K} AS b_y FROM spot, s),
t AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM d)
SELECT id, round(min(sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (b_y - ay), 2))), 3) AS metres FROM t GROUP BY id HAVING min(sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (b_y - ay), 2))) <= 100000""")
def coast_distance(spark, sf):
    """Distance to a coastline of segments; the coastline of a region is a small table."""
    rows = [(*a, *b) for a, b in zip(_COAST, _COAST[1:], strict=False)]
    s = spark.createDataFrame(rows, "a_lon double, a_lat double, b_lon double, b_lat double")
    c = F.col
    met = frame(spark, sf, "spot").crossJoin(F.broadcast(s)).select("id", geo.segment_distance(c("lat"), c("lon"), c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon")).alias("m"))
    return met.groupBy("id").agg(F.min("m").alias("m")).where("m <= 100000").select("id", F.round("m", 3).alias("metres"))


@query(f"{with_views('photo')} SELECT x.photo AS a, y.photo AS b, round(list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])), 6) AS cosine FROM photo x JOIN photo y ON x.owner = y.owner AND x.photo < y.photo")
def photos_within_listing(spark, sf):
    return match.cosines_within(frame(spark, sf, "photo").select(F.col("photo").alias("id"), "owner", "v"))
