"""Ranking, filters, facets, evaluation, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsmill.functions import numeric
from obsmill.operators import evaluate, rank
from obsmill.plans.surrogate import as_text, frame, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = as_text(sql, *dates)
        return f

    return add


_CANDIDATE = """SELECT p_partkey AS id, p_partkey % 300 AS villa, p_partkey % 12 <> 0 AS bookable, nullif(p_size % 10, 0) AS max_capacity, nullif(p_size % 5, 4) AS bedrooms,
    CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(round(p_retailprice) AS BIGINT) END AS low, CASE WHEN p_partkey % 19 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(round(p_retailprice) AS BIGINT) + p_partkey % 3 * 100 END AS high,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1 + (p_partkey % 41) / CAST(10 AS DOUBLE) END AS rating, CAST(nullif(p_partkey * 3 % 500, 7) AS DOUBLE) AS drive_low, CAST(nullif(p_partkey * 3 % 500, 7) + p_partkey % 40 AS DOUBLE) AS drive_high,
    CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END AS contradicted, CASE p_partkey % 6 WHEN 0 THEN 'denied' WHEN 1 THEN 'unknown' WHEN 2 THEN 'described' WHEN 3 THEN 'photo' WHEN 4 THEN 'listed' ELSE 'measured' END AS pool, CASE p_partkey % 5 WHEN 0 THEN 'denied' WHEN 1 THEN 'listed' WHEN 2 THEN 'described' ELSE 'unknown' END AS parking FROM {part}"""
_WANTS = rank.Wants(nights=2, guests=3, bedrooms_min=1, budget=1400, basis="whole_stay", features=("pool", "parking"), max_drive=400.0)
_CHECKED = f"""WITH c AS ({_CANDIDATE.format(part='part')}), k AS (SELECT *, CASE WHEN NOT bookable THEN 'not_bookable' WHEN max_capacity < 3 THEN 'too_small' WHEN bedrooms < 1 THEN 'few_bedrooms' WHEN low > 1400 THEN 'over_budget' WHEN drive_low > 400 THEN 'too_far' WHEN pool = 'denied' OR parking = 'denied' THEN 'feature_denied' END AS reason FROM c),
e AS (SELECT *, low / CAST(3 AS DOUBLE) / 2 AS price, CASE WHEN pool IN ('listed', 'measured', 'photo', 'described') THEN 1 ELSE 0 END + CASE WHEN parking IN ('listed', 'measured', 'photo', 'described') THEN 1 ELSE 0 END AS confirmed FROM k WHERE reason IS NULL),
s AS (SELECT *, 0.6::DOUBLE * CASE WHEN price IS NULL THEN 0 WHEN min(price) OVER () = max(price) OVER () THEN 1 ELSE (max(price) OVER () - price) / (max(price) OVER () - min(price) OVER ()) END + 0.4::DOUBLE * coalesce(least(1.0, greatest(0.0, (rating - 1) / 4)), 0) AS score FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY confirmed DESC, score DESC, id) AS rank FROM s)"""


def _candidates(spark, sf):
    c = spark.sql(_CANDIDATE, part=frame(spark, sf, "part"))
    return c.withColumn("features", F.create_map(F.lit("pool"), "pool", F.lit("parking"), "parking"))


@query(f"{_CHECKED} SELECT id, confirmed, round(score, 9) AS score, rank FROM r")
def rank_candidates(spark, sf):
    return rank.ranked(_candidates(spark, sf), _WANTS).select("id", "confirmed", F.round("score", 9).alias("score"), "rank")


@query(f"{_CHECKED} SELECT villa, id, rank FROM r QUALIFY row_number() OVER (PARTITION BY villa ORDER BY rank) = 1")
def best_of_villa(spark, sf):
    return rank.one_per(rank.ranked(_candidates(spark, sf), _WANTS), "villa").select("villa", "id", "rank")


@query(f"{_CHECKED} SELECT reason, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY reason")
def exclusions(spark, sf):
    return rank.exclusions(_candidates(spark, sf), _WANTS)


@query(f"""{_CHECKED} SELECT id, array_to_string(list_sort(list_filter([CASE WHEN max_capacity IS NULL THEN 'capacity_unknown' END, CASE WHEN bedrooms IS NULL THEN 'bedrooms_unknown' END, CASE WHEN low IS NULL THEN 'price_unknown' END, CASE WHEN low IS NOT NULL AND (high IS NULL OR high > 1400) THEN 'may_exceed_budget' END,
CASE WHEN drive_low IS NULL THEN 'drive_unknown' END, CASE WHEN drive_low <= 400 AND drive_high > 400 THEN 'may_exceed_drive' END, CASE WHEN pool = 'unknown' OR parking = 'unknown' THEN 'feature_unconfirmed' END, CASE WHEN pool = 'described' OR parking = 'described' THEN 'feature_only_described' END, CASE WHEN contradicted > 0 THEN 'claim_contradicted' END], lambda x: x IS NOT NULL)), ',') AS cautions FROM k WHERE reason IS NULL""")
def cautions(spark, sf):
    return rank.checked(_candidates(spark, sf), _WANTS, "whole_stay").where("reason IS NULL").select("id", F.array_join("cautions", ",").alias("cautions"))


@query(f"""WITH c AS ({_CANDIDATE.format(part='part')}), k AS (SELECT bookable AND NOT coalesce(low > 1400, false) AS w, bookable AND NOT coalesce(low > 2800, false) AS p FROM c)
SELECT 'per_night' AS basis, count(*) FILTER (WHERE p) AS kept, bool_or(p <> w) AS differ FROM k UNION ALL SELECT 'whole_stay', count(*) FILTER (WHERE w), bool_or(p <> w) FROM k""")
def budget_readings(spark, sf):
    return rank.budget_readings(_candidates(spark, sf), rank.Wants(nights=2, budget=1400))


@query(f"""WITH c AS ({_CANDIDATE.format(part='part')}), k AS (SELECT drive_low FROM c WHERE bookable AND NOT coalesce(max_capacity < 3, false) AND drive_low IS NOT NULL) SELECT h AS hours, count(*) FILTER (WHERE drive_low <= h * 60) AS n FROM k, (VALUES (3), (4), (5), (6)) t(h) GROUP BY h""")
def drive_coverage(spark, sf):
    return rank.drive_coverage(_candidates(spark, sf), rank.Wants(guests=3))


_FILTERS = rank.Filters(price_min=9_200_000, price_max=9_900_000, bedrooms_min=2, capacity_min=4, platforms=("a",), rating_min=1.5, coast_max_m=4500.0)
_PASS = "bedrooms >= 2 AND max_capacity >= 4 AND platform IN ('a') AND rating >= 1.5 AND coast_low_m <= 4500"


@query(f"{with_views('facet')} SELECT listing, villa, total FROM facet WHERE coalesce(total >= 9200000 AND total <= 9900000 AND {_PASS}, false)")
def facet_filter(spark, sf):
    return frame(spark, sf, "facet").withColumn("features", F.array().cast("array<string>")).where(rank.passes(_FILTERS)).select("listing", "villa", "total")


@query(f"{with_views('facet')} SELECT property_type, count(*) AS listings, count(DISTINCT villa) AS villas FROM facet WHERE coalesce({_PASS}, false) GROUP BY property_type")
def facet_counts(spark, sf):
    from dataclasses import replace

    rows = frame(spark, sf, "facet").where(rank.passes(replace(_FILTERS, price_min=None, price_max=None)))
    return rows.groupBy("property_type").agg(F.count("*").alias("listings"), F.count_distinct("villa").alias("villas"))


@query(f"{with_views('facet')} SELECT listing, total / nights AS per_night, total / CAST(nights AS DOUBLE) <= 3000000 AS cheap FROM facet WHERE total IS NOT NULL AND multi_platform AND instant")
def price_per_night(spark, sf):
    f = rank.Filters(price_max=3_000_000, per_night=True)
    rows = frame(spark, sf, "facet").where("total IS NOT NULL").where(rank.passes(rank.Filters(multi_platform=True, instant=True)))
    return rows.select("listing", rank.price(f).alias("per_night"), rank.passes(f).alias("cheap"))


@query(f"""{with_views('facet')}, p AS (SELECT CAST(total AS DOUBLE) AS p FROM facet WHERE total IS NOT NULL), o AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM p),
e AS (SELECT floor(min(p) / 500000) * 500000 AS lo, max(p) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.98::DOUBLE) AS BIGINT))) AS top FROM o), b AS (SELECT lo, greatest(lo + 500000, ceil(top / 500000) * 500000) AS hi FROM e),
s AS (SELECT lo, (hi - lo) / 24 AS step FROM b), k AS (SELECT CAST(least(23, greatest(0, floor((p - lo) / step))) AS INT) AS bin, count(*) AS n FROM p, s GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * step, 6) AS low, coalesce(k.n, 0) AS n FROM range(24) g(bin) CROSS JOIN s LEFT JOIN k ON k.bin = g.bin""")
def price_histogram(spark, sf):
    return rank.histogram(frame(spark, sf, "facet"), rank.Filters()).withColumn("low", F.round("low", 6))


# ---------------------------------------------------------------- evaluation

_WILSON = """round(CASE WHEN n > 0 THEN k / n END, 9) AS estimate, round(CASE WHEN n > 0 THEN greatest(0.0, (k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 / (1 + 3.841458820694124 / n) * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) ELSE 0 END, 9) AS low,
round(CASE WHEN n > 0 THEN least(1.0, (k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 / (1 + 3.841458820694124 / n) * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) ELSE 1 END, 9) AS high"""


def _rounded(df, *keys, struct="w", digits=9):
    return df.select(*keys, *(F.round(f"{struct}.{c}", digits).alias(c) for c in ("estimate", "low", "high")))


@query(f"SELECT lang, {_WILSON} FROM (SELECT lang, CAST(sum(toxic) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def wilson_by_group(spark, sf):
    rows = frame(spark, sf, "labels").join(frame(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return _rounded(rows.groupBy("lang").agg(numeric.wilson(F.sum("toxic"), F.count("*")).alias("w")), "lang")


@query(f"{with_views('gold')} SELECT stratum, round(sum(size) * sum(size) / CAST(sum(size * size) AS DOUBLE), 6) AS effective, count(*) AS n FROM (SELECT stratum, size * (id % 3 + 1) AS size FROM gold) GROUP BY stratum")
def kish_weighted(spark, sf):
    g = frame(spark, sf, "gold").withColumn("w", (F.col("size") * (F.col("id") % 3 + 1)).cast("double"))
    return g.groupBy("stratum").agg(F.round(numeric.kish(F.col("w")), 6).alias("effective"), F.count("*").alias("n"))


_CURVE = f"""{with_views('gold')}, w AS (SELECT g.*, size / CAST(count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS weight FROM gold g), t(threshold) AS (VALUES (-2.0::DOUBLE), (-1.0), (0.0), (1.0), (2.0), (3.0), (4.0)),
x AS (SELECT threshold, weight, label = 'match' AS y, blocked AND score >= threshold AS p FROM w, t WHERE label <> 'unsure'),
a AS (SELECT threshold, coalesce(sum(weight) FILTER (WHERE p AND y), 0) AS tp, coalesce(sum(weight) FILTER (WHERE p AND NOT y), 0) AS fp, coalesce(sum(weight) FILTER (WHERE NOT p AND y), 0) AS fn, sum(weight) FILTER (WHERE p) AS wp, sum(weight * weight) FILTER (WHERE p) AS wp2, sum(weight) FILTER (WHERE y) AS wy, sum(weight * weight) FILTER (WHERE y) AS wy2 FROM x GROUP BY threshold)"""


def _curve(spark, sf):
    g = frame(spark, sf, "gold")
    weighted = evaluate.stratum_weights(g.drop("size"), g.select("stratum", "size").distinct())
    t = spark.createDataFrame([(float(x),) for x in range(-2, 5)], "threshold double")
    return evaluate.confusion(weighted, t)


@query(f"{_CURVE} SELECT threshold, round(tp / wp, 9) AS precision, round(tp / wy, 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM a")
def pr_curve(spark, sf):
    return _curve(spark, sf).select("threshold", F.round("precision.estimate", 9).alias("precision"), F.round("recall.estimate", 9).alias("recall"), F.round("f1", 9).alias("f1"))


@query(f"{_CURVE}, k AS (SELECT threshold, tp / wp * (wp * wp / wp2) AS k, wp * wp / wp2 AS n FROM a) SELECT threshold, {_WILSON} FROM k")
def precision_interval(spark, sf):
    return _rounded(_curve(spark, sf), "threshold", struct="precision")


@query(f"{_CURVE}, k AS (SELECT threshold, tp / wp * (wp * wp / wp2) AS k, wp * wp / wp2 AS n FROM a), i AS (SELECT threshold, {_WILSON} FROM k) SELECT threshold FROM i WHERE estimate >= 0.55 AND low >= 0.5 ORDER BY threshold LIMIT 1")
def operating_point(spark, sf):
    return evaluate.operating_point(_curve(spark, sf), 0.55, 0.5).select("threshold")


@query(f"{with_views('gold')}, w AS (SELECT g.*, size / CAST(count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS weight FROM gold g), a AS (SELECT sum(weight) FILTER (WHERE blocked) / sum(weight) AS p, sum(weight) * sum(weight) / sum(weight * weight) AS n FROM w WHERE label = 'match'), k AS (SELECT p * n AS k, n FROM a) SELECT {_WILSON} FROM k")
def blocking_recall(spark, sf):
    g = frame(spark, sf, "gold")
    weighted = evaluate.stratum_weights(g.drop("size"), g.select("stratum", "size").distinct())
    return _rounded(weighted.agg(evaluate.proportion(F.col("blocked"), F.col("weight"), F.col("label") == "match").alias("w")))


@query(f"{with_views('gold')}, s AS (SELECT label = 'match' AS y, score AS photo, score * (id % 3) / 2 AS other FROM gold WHERE blocked AND label <> 'unsure'), l AS (SELECT 'photo' AS part, photo AS s, y FROM s UNION ALL SELECT 'other', other, y FROM s), t(x) AS (SELECT unnest(range(-4, 16)) / CAST(2 AS DOUBLE)), f AS (SELECT part, x, 2 * count(*) FILTER (WHERE s >= x AND y) / CAST(count(*) FILTER (WHERE s >= x) + count(*) FILTER (WHERE y) AS DOUBLE) AS f1 FROM l, t GROUP BY ALL) SELECT part, round(max(f1), 9) AS f1 FROM f GROUP BY part")
def ablation(spark, sf):
    g = frame(spark, sf, "gold").where("blocked AND label <> 'unsure'").withColumn("y", F.col("label") == "match")
    parts = g.select("y", F.explode(F.array(F.struct(F.lit("photo").alias("part"), F.col("score").alias("s")), F.struct(F.lit("other").alias("part"), (F.col("score") * (F.col("id") % 3) / 2).alias("s")))).alias("p")).select("y", "p.part", "p.s")
    t = F.explode(F.array(*(F.lit(k / 2) for k in range(-4, 16)))).alias("x")
    at = parts.select("*", t).groupBy("part", "x").agg((2 * F.count_if((F.col("s") >= F.col("x")) & F.col("y")) / (F.count_if(F.col("s") >= F.col("x")) + F.count_if("y"))).alias("f1"))
    return at.groupBy("part").agg(F.round(F.max("f1"), 9).alias("f1"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 500 AS p, (o_custkey + o_orderkey % 2) % 500 AS g FROM orders)
SELECT round(avg(pr), 9) AS precision, round(avg(re), 9) AS recall FROM (SELECT a.id, count(*) FILTER (WHERE a.p = b.p AND a.g = b.g) / CAST(count(*) FILTER (WHERE a.p = b.p) AS DOUBLE) AS pr, count(*) FILTER (WHERE a.p = b.p AND a.g = b.g) / CAST(count(*) FILTER (WHERE a.g = b.g) AS DOUBLE) AS re FROM c a JOIN c b ON a.p = b.p OR a.g = b.g GROUP BY a.id)""")
def bcubed(spark, sf):
    o = frame(spark, sf, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 500).alias("cluster"))
    g = o.select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") + F.col("o_orderkey") % 2) % 500).alias("cluster"))
    got = evaluate.bcubed(p, g)
    return got.select(*(F.round(c, 9).alias(c) for c in got.columns))


@query(f"{with_views('gold')} SELECT CASE WHEN score >= 4 THEN 'high' WHEN score >= 0 THEN 'mid' ELSE 'low' END AS band, label, count(*) AS n, count(*) FILTER (WHERE (score >= 1) = (label = 'match')) AS agree FROM gold GROUP BY ALL")
def judge_confusion(spark, sf):
    band = F.when(F.col("score") >= 4, "high").when(F.col("score") >= 0, "mid").otherwise("low")
    return frame(spark, sf, "gold").groupBy(band.alias("band"), "label").agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 1) == (F.col("label") == "match")).alias("agree"))


@query(f"""{with_views('gold')}, b AS (SELECT stratum AS tag, score, count(*) FILTER (WHERE label = 'match') AS h, count(*) AS n FROM gold GROUP BY ALL), r AS (SELECT tag, score, sum(h) OVER w AS hits, sum(n) OVER w AS predicted FROM b WINDOW w AS (PARTITION BY tag ORDER BY score DESC)),
g AS (SELECT * FROM r WHERE predicted >= 10 AND hits >= 0.6 * predicted) SELECT tag, score AS threshold, CAST(hits AS BIGINT) AS hits, CAST(predicted AS BIGINT) AS predicted FROM g QUALIFY row_number() OVER (PARTITION BY tag ORDER BY hits DESC, score DESC) = 1""")
def tag_threshold(spark, sf):
    scored = frame(spark, sf, "gold").select(F.col("stratum").alias("tag"), "score", (F.col("label") == "match").alias("y"))
    return evaluate.choose_threshold(scored, 0.6, 10)


@query("""WITH x AS (SELECT 'f' || p_size % 3 AS feature, CASE p_partkey % 3 WHEN 0 THEN 'has' WHEN 1 THEN 'has_not' ELSE 'none' END AS y, CASE p_partkey % 5 WHEN 0 THEN 'has' WHEN 1 THEN 'has_not' ELSE 'none' END AS p FROM part)
SELECT feature, count(*) FILTER (WHERE p <> 'none' AND p = y) AS tp, count(*) FILTER (WHERE p <> 'none' AND p <> y) AS fp, count(*) FILTER (WHERE y <> 'none' AND p <> y) AS fn FROM x GROUP BY feature""")
def stance_counts(spark, sf):
    p = frame(spark, sf, "part")
    row = lambda n: p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string")).alias("feature"), F.expr(f"CASE p_partkey % {n} WHEN 0 THEN 'has' WHEN 1 THEN 'has_not' ELSE 'none' END").alias("stance"))
    return evaluate.stance_counts(row(3), row(5).where("stance <> 'none'"))


_RESULTS = "SELECT o_custkey % 40 AS query, CASE WHEN o_orderkey % 2 = 0 THEN 's1' ELSE 's2' END AS system, o_orderkey % 50 AS item, min(o_orderkey) AS first FROM {orders} GROUP BY ALL"
_GRADES = "SELECT o_custkey % 40 AS query, o_orderkey % 50 AS item, max(o_orderkey % 3) AS grade FROM {orders} WHERE o_orderkey % 4 <> 0 GROUP BY ALL"
_JUDGED = f"WITH x AS ({_RESULTS.format(orders='orders')}), r AS (SELECT query, system, item, row_number() OVER (PARTITION BY query, system ORDER BY first) AS rank FROM x), g AS ({_GRADES.format(orders='orders')})"


def _judged(spark, sf):
    from pyspark.sql.window import Window as W

    o = frame(spark, sf, "orders")
    r = spark.sql(_RESULTS, orders=o).withColumn("rank", F.row_number().over(W.partitionBy("query", "system").orderBy("first")))
    return r, spark.sql(_GRADES, orders=o)


@query(f"""{_JUDGED}, d AS (SELECT query, system, sum((power(2, grade) - 1) / log2(rank + 1)) AS dcg FROM r JOIN g USING (query, item) WHERE rank <= 10 GROUP BY ALL), b AS (SELECT query, sum((power(2, grade) - 1) / log2(k + 1)) AS ideal FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS k FROM g) WHERE k <= 10 GROUP BY query)
SELECT a.query, a.system, round(CASE WHEN ideal = 0 THEN 0 ELSE coalesce(dcg, 0) / ideal END, 9) AS ndcg FROM (SELECT DISTINCT query, system FROM r) a JOIN b USING (query) LEFT JOIN d ON d.query = a.query AND d.system = a.system""")
def ndcg_at_k(spark, sf):
    return evaluate.ndcg(*_judged(spark, sf)).withColumn("ndcg", F.round("ndcg", 9))


@query(f"{_JUDGED}, n AS (SELECT query, count(*) AS n FROM g WHERE grade >= 1 GROUP BY query), h AS (SELECT query, system, count(*) AS h FROM r JOIN g USING (query, item) WHERE rank <= 20 AND grade >= 1 GROUP BY ALL) SELECT a.query, a.system, round(coalesce(h, 0) / CAST(n AS DOUBLE), 9) AS recall FROM (SELECT DISTINCT query, system FROM r) a JOIN n USING (query) LEFT JOIN h ON h.query = a.query AND h.system = a.system")
def recall_at_k(spark, sf):
    return evaluate.recall_at(*_judged(spark, sf)).withColumn("recall", F.round("recall", 9))


@query("""WITH e AS (SELECT p_partkey AS c, 's' || k AS slot, p_size % (k + 2) AS v FROM part, range(3) t(k) WHERE p_partkey % (k + 2) <> 0), f AS (SELECT p_partkey AS c, 's' || k AS slot, p_size % (k + 2) AS v FROM part, range(3) t(k) WHERE p_partkey % (k + 3) <> 0),
b AS (SELECT coalesce(e.c, f.c) AS c, coalesce(e.v = f.v, false) AS ok FROM e FULL JOIN f ON e.c = f.c AND e.slot = f.slot) SELECT round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 9) AS accuracy, (SELECT round(avg(x), 9) FROM (SELECT CASE WHEN bool_and(ok) THEN 1.0 ELSE 0 END AS x FROM b GROUP BY c)) AS exact FROM b""")
def slot_accuracy(spark, sf):
    p = frame(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    rows = lambda d: p.where(F.col("p_partkey") % (F.col("k") + d) != 0).select(F.col("p_partkey").alias("case"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("slot"), (F.col("p_size") % (F.col("k") + 2)).alias("value"))
    got = evaluate.slot_accuracy(rows(2), rows(3))
    return got.select(*(F.round(c, 9).alias(c) for c in got.columns))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) AS value FROM r WHERE i = CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS BIGINT) GROUP BY event_type")
def nearest_rank_latency(spark, sf):
    return evaluate.nearest_rank(frame(spark, sf, "events"), "value", 0.95, "event_type")


@query(f"""{with_views('photo')}, p AS (SELECT x.photo % 10 = y.photo % 10 AS same, round(list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])), 6) AS c FROM photo x JOIN photo y ON x.photo < y.photo), t AS (SELECT round(quantile_cont(c, 0.05), 6) AS t FROM p WHERE same) SELECT t AS threshold, round(count(*) FILTER (WHERE NOT same AND c >= t) / CAST(count(*) FILTER (WHERE NOT same) AS DOUBLE), 6) AS fpr FROM p, t GROUP BY t""")
def retrieval_fpr(spark, sf):
    from obsmill.operators.match import cosine_counts

    p = frame(spark, sf, "photo").select(F.col("photo").alias("id"), (F.col("photo") % 10).alias("label"), "v")
    pairs = cosine_counts(p)
    t = pairs.where("same").agg(F.round(F.percentile("cosine", 0.05, F.col("n")), 6).alias("threshold"))
    both = pairs.join(F.broadcast(t))  # one row
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return both.groupBy("threshold").agg(F.round(n(~F.col("same") & (F.col("cosine") >= F.col("threshold"))) / n(~F.col("same")), 6).alias("fpr"))


@query(f"{with_views('gold')} SELECT id, CAST(floor((((row_number() OVER (ORDER BY score DESC, id)) ) * 7 - 1) / CAST((SELECT count(*) FROM gold) AS DOUBLE)) AS INT) AS band FROM gold")
def score_bands(spark, sf):
    return evaluate.score_bands(frame(spark, sf, "gold"), [F.desc("score"), F.col("id")], 7).select("id", "band")


@query(f"""{with_views('gold')}, a AS (SELECT id FROM gold WHERE blocked ORDER BY sha256('1:' || id) LIMIT 50), b AS (SELECT id FROM gold WHERE score > 0 AND id NOT IN (SELECT id FROM a) ORDER BY score DESC, id LIMIT 40), c AS (SELECT id FROM gold WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b) ORDER BY id LIMIT 30)
SELECT id, 'hashed' AS stratum FROM a UNION ALL SELECT id, 'top' FROM b UNION ALL SELECT id, 'rest' FROM c""")
def strata_draw(spark, sf):
    g = frame(spark, sf, "gold")
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    return evaluate.strata_draw(g, [("hashed", F.col("blocked"), [hashed], 50), ("top", F.col("score") > 0, [F.desc("score"), F.col("id")], 40), ("rest", F.lit(True), [F.col("id")], 30)], "id").select("id", "stratum")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('seed:' || o_orderkey) LIMIT 100")
def hash_sample(spark, sf):
    return evaluate.hash_sample(frame(spark, sf, "orders"), "seed", "o_orderkey", 100).select("o_orderkey")


@query(f"{with_views('gold')}, r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'unsure' ELSE label END AS before FROM gold WHERE id % 3 = 0) SELECT gold.id, coalesce(r.before, label) AS label FROM gold LEFT JOIN r USING (id)")
def original_labels(spark, sf):
    g = frame(spark, sf, "gold")
    r = g.where("id % 3 = 0").select("id", F.expr("CASE WHEN id % 4 = 0 THEN 'unsure' ELSE label END").alias("before"), F.col("label").alias("after"), F.lit(1).alias("revised_at"))
    later = r.select("id", F.lit("match").alias("before"), F.lit("match").alias("after"), F.lit(2).alias("revised_at"))
    return evaluate.original_labels(g, r.unionByName(later))
