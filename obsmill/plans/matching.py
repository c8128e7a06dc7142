"""Blocking, similarity joins, evidence, scores, policy, clusters; geography; claims and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsmill.functions import geo, numeric, text
from obsmill.operators import claims, match
from obsmill.plans.surrogate import as_text, frame, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = as_text(sql, *dates)
        return f

    return add


_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"{with_views('spot')} SELECT a.id AS a, b.id AS b, round({_HAV}, 3) AS metres FROM spot a JOIN spot b ON a.id < b.id AND {_HAV} <= 2000")
def haversine_pairs(spark, sf):
    return match.near_pairs(frame(spark, sf, "spot").select("id", "lat", "lon"), 2000.0, lambda m, a, b: F.round(m, 3))


@query(f"{with_views('spot')} SELECT a.id AS a, b.id AS b, round(greatest(0.0, {_HAV} - coalesce(a.radius, 0) - coalesce(b.radius, 0)), 1) AS least FROM spot a JOIN spot b ON a.id < b.id AND {_HAV} <= 1500")
def least_distance(spark, sf):
    spots = frame(spark, sf, "spot").select("id", "lat", "lon", "radius")
    return match.near_pairs(spots, 1500.0, lambda m, a, b: geo.least_distance(m, a["radius"], b["radius"])).withColumnRenamed("metres", "least")


_NEAREST = f"""SELECT a.id, b.kind, arg_min(b.name, {_HAV}) AS name, min({_HAV}) AS metres FROM spot a JOIN place b ON {_HAV} <= 30000 GROUP BY a.id, b.kind"""


@query(f"{with_views('spot', 'place')} SELECT id, kind, name, round(metres, 3) AS metres FROM ({_NEAREST})")
def nearest_place(spark, sf):
    got = match.nearest(frame(spark, sf, "spot").select("id", "lat", "lon"), frame(spark, sf, "place"), 30000.0)
    return got.withColumn("metres", F.round("metres", 3))


def _blurred(spark, sf):
    spots = frame(spark, sf, "spot")
    got = match.nearest(spots.select("id", "lat", "lon"), frame(spark, sf, "place").where("kind = 'k0'"), 30000.0)
    return spots.join(got, "id", "left").withColumn("r", geo.blur_range(F.col("metres"), F.col("radius")))


@query(f"{with_views('spot', 'place')}, n AS ({_NEAREST}) SELECT spot.id, round(greatest(0.0, metres - coalesce(radius, 500)), 3) AS low, round(metres + coalesce(radius, 500), 3) AS high, radius IS NULL AS assumed FROM spot LEFT JOIN n ON spot.id = n.id AND kind = 'k0'")
def blur_range(spark, sf):
    return _blurred(spark, sf).select("id", F.round("r.low", 3).alias("low"), F.round("r.high", 3).alias("high"), F.col("r.assumed").alias("assumed"))


@query(f"""{with_views('spot', 'place')}, n AS ({_NEAREST}), x AS (SELECT spot.id, greatest(0.0, metres - coalesce(radius, 500)) / 10 AS low, (metres + coalesce(radius, 500)) / 10 AS high FROM spot LEFT JOIN n ON spot.id = n.id AND kind = 'k0')
SELECT CASE WHEN low IS NULL THEN 'unknown' WHEN high <= 1000 THEN 'measured' WHEN low > 1000 THEN 'denied' ELSE 'unknown' END AS evidence, count(*) AS n FROM x GROUP BY 1""")
def near_sea(spark, sf):
    return _blurred(spark, sf).groupBy(geo.near_sea(F.col("r.low") / 10, F.col("r.high") / 10).alias("evidence")).agg(F.count("*").alias("n"))


@query(f"{with_views('spot')}, s AS (SELECT id, lat, lon, unnest(range(0, 8)) * 45 AS bearing, 500 / 6371008.8 AS d FROM spot) SELECT id, bearing, round(degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(bearing)))), 8) AS lat FROM s")
def blur_samples(spark, sf):
    s = frame(spark, sf, "spot").select("id", F.posexplode(geo.blur_samples(F.col("lat"), F.col("lon"), F.lit(500.0))).alias("k", "p")).where("k > 0")
    return s.select("id", ((F.col("k") - 1) * 45).cast("bigint").alias("bearing"), F.round("p.lat", 8).alias("lat"))


@query(f"{with_views('spot')} SELECT id % 50 AS region, count(*) FILTER (WHERE lat BETWEEN 36.2 AND 36.7 AND lon BETWEEN 51.3 AND 51.9) AS inside, count(*) AS n FROM spot GROUP BY 1")
def bounding_box(spark, sf):
    inside = F.col("lat").between(36.2, 36.7) & F.col("lon").between(51.3, 51.9)
    return frame(spark, sf, "spot").groupBy((F.col("id") % 50).alias("region")).agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))


# a photo's hash: the signs of its vector's components
def _hashes(spark, sf):
    bits = F.aggregate(F.transform("v", lambda x, i: F.expr("1L") * F.when(x > 0, F.lit(1)).otherwise(0)), F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return frame(spark, sf, "photo").select(F.col("photo").alias("id"), bits.alias("h"))


_HAM = "SELECT x.photo AS a, y.photo AS b, CAST(len(list_filter(list_zip(x.v, y.v), lambda p: (p[1] > 0) <> (p[2] > 0))) AS INT) AS hamming FROM photo x JOIN photo y ON x.photo < y.photo"


@query(f"{with_views('photo')} SELECT * FROM ({_HAM}) WHERE hamming <= 16")
def hamming_pairs(spark, sf):
    return match.hamming_pairs(_hashes(spark, sf), 16)


_TOP = """c AS (SELECT x.photo AS id, y.photo AS other, round(list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])), 4) AS cosine FROM photo x JOIN photo y ON x.owner <> y.owner),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM c QUALIFY rank <= 5)"""


@query(f"{with_views('photo')}, {_TOP} SELECT * FROM top")
def cosine_topk(spark, sf):
    return match.cosine_topk(frame(spark, sf, "photo").select(F.col("photo").alias("id"), "owner", "v"), 5)


@query(f"{with_views('photo')}, {_TOP}, p AS (SELECT least(id % 100, other % 100) AS a, greatest(id % 100, other % 100) AS b, cosine FROM top WHERE cosine >= 0.35) SELECT a, b, max(cosine) AS cosine FROM p GROUP BY a, b")
def photo_blocking(spark, sf):
    top = match.cosine_topk(frame(spark, sf, "photo").select(F.col("photo").alias("id"), "owner", "v"), 5, least=0.35)
    a, b = match.pair_key(F.col("id") % 100, F.col("other") % 100)
    return top.select(a.alias("a"), b.alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _similar(spark, sf):
    return match.hamming_links(_hashes(spark, sf), 18)


@query(f"""{with_views('photo', recursive=True)}, link AS (SELECT a, b FROM ({_HAM}) WHERE hamming <= 18), e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT photo AS id, photo AS other FROM photo UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a), c AS (SELECT id, min(other) AS g FROM reach GROUP BY id),
n AS (SELECT g, count(DISTINCT owner) AS df FROM c JOIN photo ON photo = id GROUP BY g) SELECT id AS photo, df FROM c JOIN n USING (g)""")
def document_frequency(spark, sf):
    return match.document_frequency(_similar(spark, sf), frame(spark, sf, "photo").select("photo", "owner"))


def _galleries(spark, sf):
    """Photos with hashes, and the pairs of neighbouring owners."""
    p = frame(spark, sf, "photo")
    rows = p.join(_hashes(spark, sf), F.col("photo") == F.col("id")).select("id", "owner", "v", "h", (F.col("id") % 3).alias("df"))
    owners = p.select(F.col("owner").alias("a")).distinct()
    return rows, owners.select("a", (F.col("a") + 1).alias("b"))


def _one_to_one(name: str, rows: str, within: str, left: str, right: str, order: str) -> str:
    """SQL: of a CTE the rows that a greedy one-to-one choice takes, as rounds of rows that are first on both sides."""
    first = lambda side: f"row_number() OVER (PARTITION BY {within}{side} ORDER BY {order}) = 1"
    gone = lambda side: f"bool_or(best) OVER (PARTITION BY {within}{side})"
    return f"""{name}_round AS (SELECT *, {first(left)} AND {first(right)} AS best FROM {rows} UNION ALL
  SELECT * EXCLUDE (gone), {first(left)} AND {first(right)} AS best FROM (SELECT * EXCLUDE (best), {gone(left)} OR {gone(right)} AS gone FROM {name}_round) WHERE NOT gone),
{name} AS (SELECT * EXCLUDE (best) FROM {name}_round WHERE best)"""


@query(f"""{with_views('photo', recursive=True)}, x AS (SELECT x.owner AS a, y.owner AS b, x.photo AS l, y.photo AS r, len(list_filter(list_zip(x.v, y.v), lambda p: (p[1] > 0) <> (p[2] > 0))) - 18 AS h,
  round(list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])) + 0.55, 4) AS c, x.photo % 3 AS df FROM photo x JOIN photo y ON y.owner = x.owner + 1),
s AS (SELECT *, CASE WHEN h <= 6 OR c >= 0.92 THEN 1.0 WHEN h <= 10 OR c >= 0.85 THEN 0.5 ELSE 0.0 END AS s FROM x), strong AS (SELECT * FROM s WHERE s > 0),
{_one_to_one('taken', 'strong', 'a, b, ', 'l', 'r', 's DESC, c DESC, h, l, r')},
t AS (SELECT a, b, count(*) FILTER (WHERE s = 1.0) AS strong, count(*) FILTER (WHERE s < 1.0) AS weak, sum(CAST(s AS DOUBLE) / greatest(1, df)) AS w FROM taken GROUP BY a, b)
SELECT x.a, x.b, CAST(coalesce(any_value(strong), 0) AS INT) AS strong, CAST(coalesce(any_value(weak), 0) AS INT) AS weak, round(coalesce(any_value(w), 0), 4) AS weighted, max(c) AS best_cosine, CAST(min(h) AS INT) AS best_hamming FROM x LEFT JOIN t ON t.a = x.a AND t.b = x.b GROUP BY x.a, x.b""")
def photo_evidence(spark, sf):
    return match.gallery_evidence(*_galleries(spark, sf), bits=18, tilt=0.55)


@query(f"""{with_views('photo')}, x AS (SELECT x.owner AS a, y.owner AS b, len(list_filter(list_zip(x.v, y.v), lambda p: (p[1] > 0) <> (p[2] > 0))) - 18 AS h, round(list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])) + 0.55, 4) AS c
FROM photo x JOIN photo y ON y.owner = x.owner + 1)
SELECT a, b, count(*) FILTER (WHERE h <= 6 OR c >= 0.92) AS strong, count(*) FILTER (WHERE NOT (h <= 6 OR c >= 0.92) AND (h <= 10 OR c >= 0.85)) AS weak, max(c) AS best FROM x GROUP BY a, b""")
def photo_strength(spark, sf):
    return match.gallery_strength(*_galleries(spark, sf), bits=18, tilt=0.55)


@query("""WITH s AS (SELECT o_custkey % 300 AS a, o_custkey % 300 + 1 + o_orderkey % 3 AS b, CASE o_orderkey % 4 WHEN 0 THEN 'wide' WHEN 1 THEN 'geo_rooms' WHEN 2 THEN 'photo_hash' ELSE 'photo_embedding' END AS source FROM orders)
SELECT a, b, CASE WHEN count(DISTINCT source) > 1 THEN array_to_string(list_sort(list_filter(list_distinct(list(source)), lambda x: x <> 'wide')), ',') ELSE min(source) END AS sources FROM s GROUP BY a, b""")
def block_union(spark, sf):
    o = frame(spark, sf, "orders")
    s = o.select((F.col("o_custkey") % 300).alias("a"), (F.col("o_custkey") % 300 + 1 + F.col("o_orderkey") % 3).alias("b"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'wide' WHEN 1 THEN 'geo_rooms' WHEN 2 THEN 'photo_hash' ELSE 'photo_embedding' END").alias("source"))
    return match.block_union(s).withColumn("sources", F.array_join("sources", ","))


_EVIDENCE = """SELECT p_partkey AS id, (p_partkey % 23) / CAST(5 AS DOUBLE) - 1 AS weighted, p_partkey % 6 AS compared_left, p_partkey % 7 AS compared_right, nullif(p_partkey * 31 % 5000, 17) / CAST(1 AS DOUBLE) * (p_partkey % 3) AS distance_m,
    nullif(p_partkey % 5, 4) AS bedrooms_diff, nullif(p_partkey % 6, 5) AS capacity_diff, nullif(p_partkey % 10, 0) / CAST(10 AS DOUBLE) AS area_ratio, 1 + nullif(p_partkey % 8, 0) / CAST(4 AS DOUBLE) AS price_ratio, (p_partkey % 11) / CAST(10 AS DOUBLE) AS title_similarity FROM {part}"""


@query(f"""WITH e AS ({_EVIDENCE.format(part='part')})
SELECT id, round(
  CASE WHEN weighted > 0 THEN round(2.5::DOUBLE * least(weighted, 4), 4) WHEN least(compared_left, compared_right) >= 3 THEN -2 ELSE 0 END
  + CASE WHEN distance_m = 0 THEN 1 WHEN distance_m > 3000 THEN -6 WHEN distance_m > 1000 THEN -3 ELSE 0 END
  + CASE WHEN bedrooms_diff = 0 THEN 0.5 WHEN bedrooms_diff = 1 THEN -0.5 WHEN bedrooms_diff IS NOT NULL THEN -2.5 ELSE 0 END
  + CASE WHEN capacity_diff >= 3 THEN -1 ELSE 0 END + CASE WHEN area_ratio < 0.6 THEN -1 ELSE 0 END
  + CASE WHEN price_ratio > 2.5 THEN -2 WHEN price_ratio > 1.67 THEN -1 ELSE 0 END + CASE WHEN title_similarity >= 0.5 THEN 1 ELSE 0 END, 4) AS score FROM e""")
def pair_score(spark, sf):
    e = spark.sql(_EVIDENCE, part=frame(spark, sf, "part"))
    return e.withColumn("parts", match.contributions()).select("id", match.score(F.col("parts")).alias("score"))


@query(f"""WITH e AS ({_EVIDENCE.format(part='part')}) SELECT bedrooms_diff, count(*) AS n, count(*) FILTER (WHERE weighted > 0) AS shared, count(*) FILTER (WHERE NOT weighted > 0 AND least(compared_left, compared_right) >= 3) AS absent FROM e GROUP BY 1""")
def score_contributions(spark, sf):
    e = spark.sql(_EVIDENCE, part=frame(spark, sf, "part")).withColumn("names", F.transform(match.contributions(), lambda x: x["feature"]))
    has = lambda name: F.count_if(F.array_contains("names", name))
    return e.groupBy("bedrooms_diff").agg(F.count("*").alias("n"), has("shared_photos").alias("shared"), has("no_shared_photo").alias("absent"))




@query(f"{with_views('listing')} SELECT a.listing AS a, b.listing AS b, CASE WHEN a.area IS NOT NULL AND b.area IS NOT NULL THEN round(least(a.area, b.area) / CAST(greatest(a.area, b.area) AS DOUBLE), 4) END AS area_ratio, CASE WHEN a.base IS NOT NULL AND b.base IS NOT NULL THEN round(greatest(a.base, b.base) / CAST(least(a.base, b.base) AS DOUBLE), 4) END AS price_ratio, abs(a.min_nights - b.min_nights) AS nights_diff FROM listing a JOIN listing b ON a.villa = b.villa AND a.platform = 'a' AND b.platform = 'b'")
def pair_evidence(spark, sf):
    rows = frame(spark, sf, "listing")
    a, b = rows.where("platform = 'a'").alias("a"), rows.where("platform = 'b'").alias("b")
    c = F.col
    return a.join(b, c("a.villa") == c("b.villa")).select(c("a.listing").alias("a"), c("b.listing").alias("b"), numeric.ratio(False, c("a.area"), c("b.area")).alias("area_ratio"), numeric.ratio(True, c("a.base"), c("b.base")).alias("price_ratio"), numeric.diff(c("a.min_nights"), c("b.min_nights")).alias("nights_diff"))


_CANDIDATES = """SELECT id, id % 400 AS a, 400 + id % 390 AS b, score, blocked, id % 7 <> 0 AS cross_platform, CASE id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'non_match' WHEN 2 THEN 'unsure' END AS verdict, CASE WHEN id % 4 < 3 THEN 0.5 + (id % 50) / CAST(100 AS DOUBLE) END AS confidence FROM {gold}"""


def _candidates(spark, sf):
    return spark.sql(_CANDIDATES, gold=frame(spark, sf, "gold"))


_DECIDED = f"""{with_views('gold')}, c AS ({_CANDIDATES.format(gold='gold')}), f AS (SELECT *, blocked AND cross_platform AND score >= 2 AS rule, blocked AND cross_platform AND verdict IS NOT NULL AND score >= -1 AND score < 4 AS judged FROM c),
d AS (SELECT *, CASE WHEN judged AND confidence >= 0.8 AND verdict = 'match' THEN 'judge' WHEN judged THEN NULL WHEN rule THEN 'rule' END AS decided_by, CASE WHEN judged AND NOT (confidence >= 0.8 AND verdict IN ('match', 'non_match')) THEN 'unsure' END AS wait FROM f)"""
_POLICY = match.Policy(2.0, -1.0, 4.0, 0.8, True, True)


@query(f"{_DECIDED} SELECT id, decided_by, wait, round(CASE decided_by WHEN 'judge' THEN -2 + confidence WHEN 'rule' THEN score END, 9) AS weight FROM d")
def decide_policy(spark, sf):
    return match.decide(_candidates(spark, sf), _POLICY).select("id", "decided_by", "wait", F.round("weight", 9).alias("weight"))


@query(f"""{with_views('gold')}, c AS ({_CANDIDATES.format(gold='gold')}), f AS (SELECT *, blocked AND cross_platform AND score >= 2 AS rule, blocked AND cross_platform AND verdict IS NOT NULL AND score >= -1 AND score < 4 AS judged FROM c)
SELECT id, CASE WHEN rule THEN 'rule' END AS decided_by, CASE WHEN judged AND confidence >= 0.8 AND verdict = 'match' THEN CASE WHEN NOT rule THEN 'suggested' END WHEN judged AND confidence >= 0.8 AND verdict = 'non_match' THEN CASE WHEN rule THEN 'disputed' END WHEN judged THEN 'unsure' END AS wait FROM f""")
def decide_advisory(spark, sf):
    return match.decide(_candidates(spark, sf), match.Policy(2.0, -1.0, 4.0, 0.8, False, False)).select("id", "decided_by", "wait")


@query(f"""{_DECIDED}, q AS (SELECT a, b, row_number() OVER (ORDER BY id) AS position FROM c WHERE id % 11 = 0), w AS (SELECT DISTINCT a, b, wait, confidence, id FROM d WHERE wait IS NOT NULL)
SELECT id, wait, row_number() OVER (ORDER BY confidence DESC, w.a, w.b) + (SELECT max(position) FROM q) AS position FROM w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.a = w.a AND q.b = w.b)""")
def wait_queue(spark, sf):
    c = _candidates(spark, sf)
    from pyspark.sql.window import Window as W

    queued = c.where("id % 11 = 0").select("a", "b", F.row_number().over(W.orderBy("id")).alias("position"))
    return match.wait_queue(match.decide(c, _POLICY), queued, "id").select("id", "wait", "position")


@query(f"""{with_views('gold', recursive=True)}, c AS ({_CANDIDATES.format(gold='gold')}), e AS (SELECT *, blocked AND cross_platform AS ok FROM c), d AS (SELECT * FROM e WHERE ok AND score >= 1), no AS (SELECT a, b FROM c WHERE verdict = 'non_match' AND confidence > 0.9),
free AS (SELECT a, b, max(score) AS w FROM d WHERE id % 13 <> 0 AND (a, b) NOT IN (SELECT (a, b) FROM no) GROUP BY a, b),
{_one_to_one('pair', 'free', '', 'a', 'b', 'w DESC, a, b')},
every AS (SELECT a AS id FROM d UNION SELECT b FROM d)
SELECT id, coalesce(pair.a, id) AS cluster FROM every LEFT JOIN pair ON id = pair.a OR id = pair.b""")
def cluster_villas(spark, sf):
    c = match.decide(_candidates(spark, sf), match.Policy(1.0)).where("decided_by IS NOT NULL").withColumn("complex_unit", F.col("id") % 13 == 0)
    ids = c.select(F.col("a").alias("id")).union(c.select("b")).distinct().withColumn("platform", F.when(F.col("id") < 400, "x").otherwise("y"))
    cannot = _candidates(spark, sf).where("verdict = 'non_match' AND confidence > 0.9").select("a", "b").distinct()
    grouped, _ = match.cluster(ids, c, cannot)
    return grouped


@query(f"""WITH RECURSIVE old AS (SELECT 'v-' || CAST(o_orderkey // 3 AS VARCHAR) AS villa, o_orderkey AS id FROM orders), fresh AS (SELECT (o_orderkey + o_custkey % 2) // 3 AS cluster, o_orderkey AS id FROM orders),
shared AS (SELECT villa, cluster, count(*) AS n FROM old JOIN fresh USING (id) GROUP BY villa, cluster),
{_one_to_one('kept', 'shared', '', 'villa', 'cluster', 'n DESC, villa, cluster')},
m AS (SELECT cluster, array_to_string(list_sort(list(CAST(id AS VARCHAR))), '|') AS m FROM fresh WHERE cluster NOT IN (SELECT cluster FROM kept) GROUP BY cluster),
name AS (SELECT cluster, k, 'v-' || substr(sha256(m || CASE WHEN k > 0 THEN '#' || k ELSE '' END), 1, 12) AS villa FROM m, range(4) t(k)),
named AS (SELECT cluster, arg_min(villa, k) AS villa FROM name WHERE villa NOT IN (SELECT villa FROM old) GROUP BY cluster),
villas AS (SELECT cluster, villa FROM kept UNION ALL SELECT cluster, villa FROM named),
src AS (SELECT cluster, array_to_string(list_sort(list(DISTINCT villa)), ',') AS others, count(DISTINCT villa) AS n FROM shared GROUP BY cluster),
heir AS (SELECT shared.villa, array_to_string(list_sort(list(DISTINCT villas.villa)), ',') AS others, count(DISTINCT villas.villa) AS n FROM shared JOIN villas USING (cluster) GROUP BY shared.villa)
SELECT 'villa' AS what, CAST(cluster AS VARCHAR) AS key, villa FROM villas
UNION ALL SELECT 'created', coalesce(others, ''), villa FROM named LEFT JOIN src USING (cluster)
UNION ALL SELECT 'merged', others, villa FROM villas JOIN src USING (cluster) WHERE n > 1
UNION ALL SELECT 'split', others, villa FROM heir WHERE n > 1
UNION ALL SELECT 'retired', '', villa FROM (SELECT DISTINCT villa FROM old WHERE villa NOT IN (SELECT villa FROM kept))""")
def reconcile_ids(spark, sf):
    o = frame(spark, sf, "orders")
    old = o.select(F.concat(F.lit("v-"), (F.col("o_orderkey") / 3).cast("int").cast("string")).alias("villa"), F.col("o_orderkey").alias("id"))
    new = o.select(F.floor((F.col("o_orderkey") + F.col("o_custkey") % 2) / 3).alias("cluster"), F.col("o_orderkey").alias("id"))
    villas, events = match.reconcile(old, new)
    return villas.select(F.lit("villa").alias("what"), F.col("cluster").cast("string").alias("key"), "villa").union(events.select("kind", F.array_join("others", ","), "villa"))


@query("""WITH g AS (SELECT o_custkey, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), '|') AS m FROM orders GROUP BY 1) SELECT o_custkey AS villa, 'v-' || substr(sha256(m), 1, 12) AS id FROM g""")
def villa_id(spark, sf):
    g = frame(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("m"))
    return g.select(F.col("o_custkey").alias("villa"), match.villa_id(F.col("m")).alias("id"))


# ---------------------------------------------------------------- claims

_NUMBER = "(l_orderkey * 7 + l_linenumber) % 60 + 1"
_UNIT = "CASE l_partkey % 3 WHEN 0 THEN 'دقیقه' WHEN 1 THEN 'متر' ELSE 'کیلومتر' END"
_CLAIM = f"""SELECT l_orderkey AS listing, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, {_NUMBER} AS n, {_UNIT} AS unit, l_quantity AS q,
    CASE l_suppkey % 5 WHEN 0 THEN concat('زیر ', {_NUMBER}, ' ', {_UNIT}) WHEN 1 THEN concat('بیش از ', {_NUMBER}, ' ', {_UNIT}) WHEN 2 THEN concat({_NUMBER}, ' تا ', ({_NUMBER}) + 10, ' ', {_UNIT}) WHEN 3 THEN concat({_NUMBER}, ' ', {_UNIT}) ELSE 'خیلی نزدیک' END AS value,
    CASE l_linenumber % 5 WHEN 0 THEN 'فاصله تا دریا' WHEN 1 THEN 'مرکز شهر' WHEN 2 THEN 'جنگل و دریا' WHEN 3 THEN 'دریاچه' ELSE 'سوپرمارکت' END AS target, CASE l_orderkey % 3 WHEN 0 THEN 'walk' WHEN 1 THEN 'car' ELSE 'unknown' END AS mode,
    l_extendedprice / 20 AS near, l_extendedprice / 20 + l_quantity * 20 AS far FROM {{lineitem}}"""
_PARSED = f"""WITH c AS ({_CLAIM.format(lineitem='lineitem')}), s AS (SELECT *, CAST(CASE WHEN unit = 'کیلومتر' THEN 1000 ELSE 1 END AS DOUBLE) AS k, CASE WHEN unit = 'دقیقه' THEN 'minutes' ELSE 'metres' END AS u FROM c),
p AS (SELECT *, CASE WHEN supp % 5 = 4 THEN NULL ELSE u END AS parsed, CASE supp % 5 WHEN 0 THEN 0 WHEN 1 THEN n * k WHEN 2 THEN n * k WHEN 3 THEN 0 END AS low, CASE supp % 5 WHEN 0 THEN n * k WHEN 2 THEN (n + 10) * k WHEN 3 THEN n * k + greatest(CASE WHEN u = 'minutes' THEN 5 ELSE 50 END, n * k / 2) END AS high,
  CASE line % 5 WHEN 0 THEN 'sea' WHEN 1 THEN 'city_center' WHEN 2 THEN 'other' WHEN 3 THEN 'other' ELSE 'supermarket' END AS kind FROM s),
r AS (SELECT *, CASE WHEN parsed = 'metres' THEN [low] WHEN mode = 'walk' THEN [low * 40] WHEN mode = 'car' THEN [low * 150] ELSE [low * 40, low * 150] END AS lows, CASE WHEN parsed = 'metres' THEN [high] WHEN mode = 'walk' THEN [high * 100] WHEN mode = 'car' THEN [high * 1000] ELSE [high * 100, high * 1000] END AS highs FROM p),
v AS (SELECT *, list_distinct(list_transform(list_zip(lows, highs), lambda x: CASE WHEN x[2] IS NOT NULL AND near > x[2] THEN 'contradicted' WHEN (x[2] IS NULL OR far <= x[2]) AND near >= x[1] THEN 'supported' ELSE 'not_confirmed' END)) AS each FROM r),
j AS (SELECT *, CASE WHEN parsed IS NULL THEN 'not_understood' WHEN len(each) = 1 THEN each[1] ELSE 'not_confirmed' END AS verdict FROM v)"""


def _claims(spark, sf):
    c = spark.sql(_CLAIM, lineitem=frame(spark, sf, "lineitem"))
    c = c.withColumn("claim", claims.parse(F.col("value"))).withColumn("kind", claims.target(F.col("target")))
    judged = claims.verdict(claims.readings(F.col("claim"), F.col("mode")), F.col("near"), F.col("far"))
    return c.withColumn("verdict", F.when(F.col("claim").isNull(), "not_understood").otherwise(judged))


@query(f"{_PARSED} SELECT listing, line, part, supp, q, parsed AS unit, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, kind FROM j")
def distance_claim_parse(spark, sf):
    return _claims(spark, sf).select("listing", "line", "part", "supp", "q", "claim.unit", "claim.low", "claim.high", "kind")


@query(f"{_PARSED} SELECT listing, line, part, supp, q, verdict FROM j")
def claim_verdict(spark, sf):
    return _claims(spark, sf).select("listing", "line", "part", "supp", "q", "verdict")


@query(f"{_PARSED} SELECT kind || ':' || verdict AS outcome, mode, count(*) AS n FROM j GROUP BY ALL")
def verdict_report(spark, sf):
    return _claims(spark, sf).groupBy(F.concat_ws(":", "kind", "verdict").alias("outcome"), "mode").agg(F.count("*").alias("n"))


@query(f"{_PARSED} SELECT count(*) AS claims, count(parsed) AS parsed, count(*) FILTER (WHERE kind = 'other') AS other, count(DISTINCT listing) AS listings, count(DISTINCT value) FILTER (WHERE parsed IS NULL) AS unparsed FROM j")
def claim_coverage(spark, sf):
    return _claims(spark, sf).agg(F.count("*").alias("claims"), F.count("claim").alias("parsed"), F.count_if(F.col("kind") == "other").alias("other"), F.count_distinct("listing").alias("listings"), F.count_distinct(F.when(F.col("claim").isNull(), F.col("value"))).alias("unparsed"))


@query(f"""{_PARSED}, l AS (SELECT listing, bool_or(kind = 'sea') AS has_sea, bool_or(kind = 'sea' AND verdict = 'contradicted') AS bad FROM j GROUP BY listing)
SELECT count(*) FILTER (WHERE has_sea) AS claimed, count(*) FILTER (WHERE bad) AS contradicted FROM l""")
def sea_truth_report(spark, sf):
    per = _claims(spark, sf).groupBy("listing").agg(F.bool_or(F.col("kind") == "sea").alias("has_sea"), F.bool_or((F.col("kind") == "sea") & (F.col("verdict") == "contradicted")).alias("bad"))
    return per.agg(F.count_if("has_sea").alias("claimed"), F.count_if("bad").alias("contradicted"))


@query("""SELECT p_partkey AS id, CASE WHEN a THEN CASE WHEN hn THEN 'unknown' ELSE 'listed' END WHEN NOT a THEN CASE WHEN h THEN 'unknown' ELSE 'denied' END WHEN hn THEN 'denied' WHEN h THEN CASE WHEN s THEN 'photo' ELSE 'described' END ELSE 'unknown' END AS evidence
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, p_size % 2 = 0 AS h, p_size % 5 = 0 AS hn, p_size % 3 = 0 AS s FROM part)""")
def evidence_lattice(spark, sf):
    p = frame(spark, sf, "part")
    amenity = F.expr("CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    return p.select(F.col("p_partkey").alias("id"), claims.evidence(amenity, F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 0, F.col("p_size") % 3 == 0).alias("evidence"))


_PHRASES = ("ویلا استخر دارد", "بدون استخر", "استخر ندارد. شومینه", "نزدیک استخر", "استخر مشاع شهرک", "ویوی دریا و پارکینگ", "استخر اختصاصی. استخر فعلا قابل استفاده نیست", "منقل و کباب پز")
_TOLD = (("pool:has",), ("pool:not",), ("fireplace:has", "pool:not"), (), ("pool:has",), ("parking:has", "sea_view:has"), ("pool:not",), ("barbecue:has",))


@query(f"SELECT p_partkey AS id, (CASE p_partkey % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{chr(44).join(t)}{chr(39)}' for k, t in enumerate(_TOLD))} END) AS claims FROM part")
def feature_claims(spark, sf):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    got = frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), claims.feature_claims(text.normalize(phrase)).alias("c"))
    each = F.array_sort(F.transform("c", lambda x: F.concat_ws(":", x["feature"], F.when(x["has"], "has").otherwise("not"))))
    return got.select("id", F.array_join(each, ",").alias("claims"))


_SAID = "SELECT o_custkey AS grp, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS platform, concat('f', o_orderkey % 3) AS feature, o_totalprice > 150000 AS has, CAST(o_orderkey % 7 AS DOUBLE) AS low, CAST(nullif(o_orderkey % 7 + o_orderkey % 3, 8) AS DOUBLE) AS high FROM {orders}"


@query(f"WITH s AS ({_SAID.format(orders='orders')}), u AS (SELECT grp, platform, feature, bool_or(has) AS has FROM s GROUP BY ALL HAVING bool_or(has) = bool_and(has)) SELECT grp, feature FROM u GROUP BY ALL HAVING count(DISTINCT has) > 1 AND count(DISTINCT platform) > 1")
def feature_consistency(spark, sf):
    s = spark.sql(_SAID, orders=frame(spark, sf, "orders")).withColumnRenamed("grp", "group")
    return claims.feature_conflicts(s).withColumnRenamed("group", "grp")


_RANGES = f"WITH s AS ({_SAID.format(orders='orders')}), p AS (SELECT grp, platform, feature, min(low) AS low, max(coalesce(high, 'infinity'::DOUBLE)) AS high FROM s GROUP BY ALL), bad AS (SELECT grp, feature FROM p GROUP BY ALL HAVING count(*) > 1 AND max(low) > min(high))"


@query(f"{_RANGES} SELECT grp, feature FROM bad")
def range_consistency(spark, sf):
    s = spark.sql(_SAID, orders=frame(spark, sf, "orders")).withColumnRenamed("grp", "group").withColumnRenamed("feature", "target")
    return claims.range_conflicts(s).toDF("grp", "feature")


@query(f"{_RANGES}, u AS (SELECT grp, platform, feature, bool_or(has) AS has FROM s GROUP BY ALL HAVING bool_or(has) = bool_and(has)), f AS (SELECT grp FROM u GROUP BY grp, feature HAVING count(DISTINCT has) > 1 AND count(DISTINCT platform) > 1) SELECT (SELECT count(DISTINCT grp) FROM s) AS judged, (SELECT count(*) FROM (SELECT grp FROM bad UNION SELECT grp FROM f)) AS inconsistent")
def h4_report(spark, sf):
    s = spark.sql(_SAID, orders=frame(spark, sf, "orders")).withColumnRenamed("grp", "group")
    bad = claims.feature_conflicts(s).select("group").union(claims.range_conflicts(s.withColumnRenamed("feature", "target")).select("group")).distinct()
    return s.agg(F.count_distinct("group").alias("judged")).join(F.broadcast(bad.agg(F.count("*").alias("inconsistent"))))


@query("SELECT (p_partkey % 2 = 0) AS listed, CASE WHEN p_partkey % 4 = 0 OR p_size % 5 = 0 THEN 'amenities_silent' WHEN (p_partkey % 2 = 0) = (p_size % 2 = 0) THEN 'agrees' ELSE 'amenities_disagree' END AS outcome, count(*) AS n FROM part GROUP BY ALL")
def amenity_agreement(spark, sf):
    stated = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 2 == 0)
    out = claims.agreement(stated, F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 0)
    return frame(spark, sf, "part").groupBy((F.col("p_partkey") % 2 == 0).alias("listed"), out.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_partkey AS id, 'f' || p_size % 3 AS feature FROM part WHERE p_partkey % 2 = 0), x AS (SELECT p_partkey AS id, 'f' || p_partkey % 3 AS feature, split_part(p_name, ' ', 2) AS quote, p_name AS text FROM part WHERE p_partkey % 3 <> 1)
SELECT id, feature, by_reader, start FROM (SELECT id, feature, false AS by_reader, 0 AS start FROM r UNION ALL SELECT id, feature, true, strpos(text, quote) - 1 FROM x WHERE quote <> '' AND strpos(text, quote) > 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.id = x.id AND r.feature = x.feature))""")
def merge_read_claims(spark, sf):
    p = frame(spark, sf, "part")
    rules = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string")).alias("feature"), F.lit(True).alias("has"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(False).alias("shared"))
    read = p.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("feature"), F.lit(True).alias("has"), F.lit(False).alias("shared"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("quote"), F.col("p_name").alias("text"))
    return claims.merge_read(rules, read).select("id", "feature", "by_reader", "start")


@query("""SELECT p_partkey AS id, min(2 * leg + 3) FILTER (WHERE leg % 5 <> 0) AS low, max(2 * leg + 3) FILTER (WHERE leg % 5 <> 0) AS high, max(CASE WHEN k = 0 AND leg % 5 <> 0 THEN 2 * leg + 3 END) AS pin FROM (SELECT p_partkey, unnest(range(0, 9)) AS k, (p_partkey * 3 + unnest(range(0, 9)) * 7) % 50 AS leg FROM part) GROUP BY 1""")
def drive_times(spark, sf):
    legs = frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).withColumn("leg", (F.col("id") * 3 + F.col("k") * 7) % 50)
    routed = F.when(F.col("leg") % 5 != 0, 2 * F.col("leg") + 3)
    return legs.groupBy("id").agg(F.min(routed).alias("low"), F.max(routed).alias("high"), F.max(F.when(F.col("k") == 0, routed)).alias("pin"))
