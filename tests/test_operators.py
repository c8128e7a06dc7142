"""Single operators on tables of a few rows, and sequential ones against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsmill.functions import calendar, display, geo, numbers, numeric, text
from obsmill.operators import claims, evaluate, graph, intent, match, observe, quote, rank
from obsmill.sources import readers


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_newest_of_a_night_wins_in_both_orders(spark):
    rows = [(1, "n", datetime(2024, 1, 2), "b", 5), (1, "n", datetime(2024, 1, 1), "a", 4)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "k int, night string, at timestamp, snap string, v int")
        assert values(observe.latest(df, ["k", "night"], [F.col("at").desc(), F.col("snap")]), "v") == [(5,)]


def test_upsert_keeps_the_newer_row(spark):
    schema = "k int, at int, v string"
    stored, late = spark.createDataFrame([(1, 5, "old"), (2, 5, "x")], schema), spark.createDataFrame([(1, 4, "late"), (2, 5, "same age"), (3, 1, "new")], schema)
    got = dict(values(observe.upsert_newest(stored, late, ["k"], "at", []), "k", "v"))
    assert got == {1: "old", 2: "same age", 3: "new"}


def test_gaps_and_streaks(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([("h", base + timedelta(seconds=s), c) for s, c in ((0, 200), (3.2, 429), (7.2, 429), (10.8, 429), (800, 200))], "host string, at timestamp, status int")
    got = observe.host_traffic(df.withColumn("run", F.lit(1)).withColumn("b", F.col("status")).withColumn("size", F.lit(10)), "run", "host", "at", "b", "size")
    r = got.first()
    assert (r["responses"], round(r["min_gap"], 3), round(r["median_gap"], 3), r["stored"]) == (5, 3.2, 3.6, 20)
    assert values(observe.streaks(df, ["host"], ["at"], F.col("status") == 429), "length") == [(3,)]


LISTING = "listing int, base_capacity int, extra_capacity int, min_nights int, fees_known boolean, base bigint, weekend bigint, holiday bigint, extra_base bigint, extra_weekend bigint, extra_holiday bigint"
NIGHT = "listing int, night date, availability string, price bigint, extra_price bigint, min_nights int, is_holiday boolean, observed_at timestamp_ntz"


def stay(spark, nights, listing=(1, 4, 2, None, True, 100, 120, 200, 10, None, None), guests=4, direct=None):
    n = spark.createDataFrame([(1, date(2024, 1, 1 + k), *x, datetime(2024, 1, 1)) for k, x in enumerate(nights)], NIGHT)
    req = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 1, 3), guests)], "request int, check_in date, check_out date, guests int")
    return quote.quote_stays(spark.createDataFrame([listing], LISTING), n, req, [F.col("observed_at").desc()], direct).first()


def test_quote_outcomes(spark):
    free, taken, unsure = ("available", 90, None, None, False), ("booked", 90, None, None, False), ("unknown", 90, None, None, False)
    r = stay(spark, [free, free])
    assert (r["status"], r["kind"], tuple(r["total"])) == ("bookable", "exact", (180, 180))
    assert stay(spark, [free, taken])["status"] == "unavailable"
    assert stay(spark, [free, unsure])["status"] == stay(spark, [free])["status"] == "unknown"
    assert stay(spark, [taken, free], guests=7)["status"] == "too_many_guests"
    assert stay(spark, [("available", 90, None, 3, False), free])["status"] == "below_min_nights"
    r = stay(spark, [free, ("available", None, None, None, False)])
    assert (r["kind"], tuple(r["total"]), r["caveats"]) == ("range", (190, 210), ["night_price_from_rate_card"])
    r = stay(spark, [free, ("available", None, None, None, None)], listing=(1, 4, 2, None, True, 100, 120, None, 10, None, None))
    assert (r["kind"], r["total"]["low"], r["caveats"]) == ("open", 90, ["night_price_unknown"])
    r = stay(spark, [free, free], guests=5)
    assert tuple(r["total"]) == (200, 200)
    r = stay(spark, [free, free], listing=(1, None, None, None, False, 100, 120, 200, 10, None, None))
    assert (r["kind"], r["caveats"]) == ("open", ["capacity_unknown", "fees_unknown"])


def test_direct_quote_must_be_fresh(spark):
    schema = "listing int, request int, total bigint, observed_at timestamp_ntz"
    free = ("available", 90, None, None, False)
    fresh, old = (spark.createDataFrame([(1, 1, 500, datetime(2024, 1, d))], schema) for d in (2, 1))
    assert tuple(stay(spark, [free, free], direct=fresh)["total"]) == (500, 500)
    older = old.withColumn("observed_at", F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz"))
    assert tuple(stay(spark, [free, free], direct=older)["total"]) == (180, 180)


def test_gap_summary_uses_index_p90(spark):
    df = spark.createDataFrame([("k", x) for x in (1.0, 1.1, 1.5, 3.0)], "k string, ratio double")
    assert values(quote.gap_summary(df, "k"), "pairs", "median_ratio", "p90_ratio") == [(4, 1.3, 3.0)]


def test_wilson_without_trials(spark):
    df = spark.createDataFrame([(0.0, 0.0), (9.0, 10.0)], "k double, n double").select(numeric.wilson(F.col("k"), F.col("n")).alias("w"))
    none, some = (r["w"] for r in df.collect())
    assert tuple(none) == (None, 0.0, 1.0)
    assert some["estimate"] == 0.9 and round(some["low"], 3) == 0.596 and round(some["high"], 3) == 0.982


def test_hamming_pairs_with_negative_hashes(spark):
    rng = random.Random(3)
    h = [rng.getrandbits(64) - 2**63 for _ in range(60)] + [-1, -2, 5, 5]
    h += [x ^ (1 << rng.randrange(63)) for x in h[:20]]
    got = set(values(match.hamming_pairs(spark.createDataFrame(list(enumerate(h)), "id long, h long"), 6), "a", "b", "hamming"))
    want = {(i, j, ((h[i] ^ h[j]) & (2**64 - 1)).bit_count()) for i in range(len(h)) for j in range(i + 1, len(h)) if ((h[i] ^ h[j]) & (2**64 - 1)).bit_count() <= 6}
    assert got == want


def test_near_pairs_and_antimeridian(spark):
    rng = random.Random(5)
    pts = [(k, 36 + rng.random() / 10, 51 + rng.random() / 10) for k in range(120)] + [(200, 10.0, 179.999), (201, 10.0, -179.999), (202, 70.0, 20.0), (203, 70.0, 20.01)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {(a, b) for a, b in values(match.near_pairs(df, 900.0), "a", "b")}
    both = df.alias("x").join(df.alias("y"), F.expr("x.id < y.id")).select(F.col("x.id"), F.col("y.id"), geo.distance(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")).alias("m")).where("m <= 900")
    assert got == {(r[0], r[1]) for r in both.collect()} and (200, 201) in got and (202, 203) in got


def plain_cluster(members, decisions, cannot):
    of = {m: {m} for m, _ in members}
    platform = dict(members)
    for a, b, w, by, cx in sorted(decisions, key=lambda d: (-d[2], d[0], d[1])):
        x, y = of[a], of[b]
        if x is y or {platform[m] for m in x} & {platform[m] for m in y} or any((min(p, q), max(p, q)) in cannot for p in x for q in y) or (cx and by != "human"):
            continue
        x |= y
        for m in y:
            of[m] = x
    return {m: min(s) for m, s in of.items()}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_match_plain_python(spark, seed):
    rng = random.Random(seed)
    members = [(k, f"p{k % 4}") for k in range(40)]
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    decisions = [(a, b, float(rng.randrange(5)), rng.choice(["rule", "human"]), rng.random() < 0.2) for a, b in pairs]
    cannot = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(15)}
    got, refused = match.cluster(spark.createDataFrame(members, "id long, platform string"), spark.createDataFrame(decisions, "a long, b long, weight double, decided_by string, complex_unit boolean"), spark.createDataFrame(list(cannot), "a long, b long"))
    assert dict(values(got, "id", "cluster")) == plain_cluster(members, decisions, cannot)
    assert {r for (r,) in values(refused, "reason")} <= {"same_platform", "cannot_link", "complex_unit"}


def test_reconcile_names_events(spark):
    old = spark.createDataFrame([("v1", 1), ("v1", 2), ("v2", 3), ("v3", 9)], "villa string, id long")
    new = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (7, 7)], "cluster long, id long")
    villas, events = match.reconcile(old, new)
    kept = dict(values(villas, "cluster", "villa"))
    assert kept[1] == "v1" and kept[2].startswith("v-") and kept[7].startswith("v-")
    told = {(k, v) for k, v in values(events, "kind", "villa")}
    assert {("merged", "v1"), ("split", "v1"), ("retired", "v2"), ("retired", "v3"), ("created", kept[2]), ("created", kept[7])} == told


def test_photo_matching_is_one_to_one(spark):
    rows = [("p", 1, 1, 2, None, 1), ("p", 1, 2, 3, 0.95, 1), ("p", 2, 1, 9, None, 2), ("p", 3, 3, None, 0.5, 1)]
    got = match.photo_evidence(spark.createDataFrame(rows, "k string, l long, r long, hamming int, cosine double, df int"), ["k"]).first()
    # the second pair is strong with the higher cosine, then 2-1 is weak at a shared photo
    assert (got["strong"], got["weak"], got["weighted"], got["best_cosine"], got["best_hamming"]) == (1, 1, 1.25, 0.95, 2)


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = dict(values(graph.components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_claim_readings_must_agree(spark):
    rows = [("زیر ۵ دقیقه", "walk", 100.0, 200.0, "supported"), ("زیر ۵ دقیقه", "walk", 600.0, 700.0, "contradicted"), ("زیر ۵ دقیقه", "unknown", 600.0, 700.0, "not_confirmed"), ("۲ کیلومتر", "car", 2500.0, 2600.0, "supported"), ("نزدیک", "car", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "value string, mode string, low double, high double, want string").withColumn("c", claims.parse(F.col("value")))
    got = df.select(F.when(F.col("c").isNotNull(), claims.verdict(claims.readings(F.col("c"), F.col("mode")), F.col("low"), F.col("high"))).alias("v"), "want")
    assert all(a == b for a, b in values(got, "v", "want"))


def test_feature_claims_of_text():
    told = lambda t: [(f, h) for f, h, *_ in claims.claims_of(t)]
    assert told("استخر دارد") == [("pool", True)]
    assert told("بدون استخر، شومینه") == [("pool", False), ("fireplace", True)]
    assert told("نزدیک استخر") == [] and told("بی نیاز از استخر") == []
    assert claims.claims_of("استخر مشاع شهرک")[0][4] is True


def test_numbers_and_money():
    assert numbers.money_rial("12.5 میلیون تومان") == 125_000_000
    assert numbers.money_rial("5 میلیون و 500 هزار") == 55_000_000
    assert numbers.money_rial("3 و 5 میلیون") is None and numbers.money_rial("") is None
    assert [float(x) for x in numbers.mentions("دو میلیون و پانصد هزار")] == [2_500_000]
    assert numbers.mentions("پنج شنبه") == []


def test_ranking_keeps_unknowns_and_filters_drop_them(spark):
    c = spark.createDataFrame([(1, True, None, 2, 100, 100, 4.0), (2, True, 5, 2, None, None, None), (3, True, 2, 2, 50, 50, 5.0), (4, False, 9, 9, 1, 1, 5.0)], "id int, bookable boolean, max_capacity int, bedrooms int, low bigint, high bigint, rating double")
    c = c.withColumn("drive_low", F.lit(None).cast("double")).withColumn("drive_high", F.lit(None).cast("double")).withColumn("contradicted", F.lit(0)).withColumn("features", F.expr("map('pool', 'listed')"))
    wants = rank.Wants(guests=4, features=("pool",))
    assert [r for (r,) in values(rank.ranked(c, wants).orderBy("rank"), "id")] == [1, 2]
    assert dict(values(rank.exclusions(c, wants), "reason", "n")) == {"too_small": 1, "not_bookable": 1}
    rows = spark.createDataFrame([(1, None), (2, 3)], "listing int, bedrooms int")
    assert values(rows.where(rank.passes(rank.Filters(bedrooms_min=2))), "listing") == [(2,)]


def test_labels_revised_all_or_nothing(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    schema = "id int, before string, after string, revised_at int"
    good, bad = spark.createDataFrame([(1, "a", "c", 1)], schema), spark.createDataFrame([(1, "a", "c", 1), (2, "x", "d", 1)], schema)
    assert dict(values(evaluate.revised_labels(labels, good), "id", "label")) == {1: "c", 2: "b"}
    assert dict(values(evaluate.revised_labels(labels, bad), "id", "label")) == {1: "a", 2: "b"}


@given(st.dates(date(1900, 1, 1), date(2200, 1, 1)))
@settings(max_examples=60, deadline=None)
def test_jalali_round_trip(day):
    year = next(y for y in range(day.year - 622, day.year - 619) if calendar.new_year(y) <= day < calendar.new_year(y + 1))
    k = (day - calendar.new_year(year)).days
    month = next(m for m in range(1, 13) if k < sum(calendar.month_length(year, x) for x in range(1, m + 1)))
    first = sum(calendar.month_length(year, x) for x in range(1, month))
    assert calendar.to_gregorian(year, month, k - first + 1) == day


def test_known_jalali_days():
    assert calendar.new_year(1403) == date(2024, 3, 20) and calendar.is_leap(1403) and not calendar.is_leap(1404)
    assert calendar.to_gregorian(1405, 7, 9) == date(2026, 10, 1)


def test_date_expressions():
    friday = date(2026, 10, 2)
    assert calendar.resolve("weekend", friday)["caveats"] == ["partial_weekend"]
    assert calendar.resolve("weekend", date(2026, 10, 3))["check_in"] == date(2026, 10, 8)
    assert calendar.resolve("jalali_month", friday, month=7) == {"check_in": friday, "check_out": date(2026, 10, 23), "flexible": True, "caveats": []}
    assert calendar.resolve("nowruz", friday)["check_in"] == date(2027, 3, 21)
    with pytest.raises(ValueError):
        calendar.resolve("jalali_day", friday, month=1, day=1, year=1400)


@given(st.text(alphabet="ab يك‌​ـ\t\n٤۵ً", max_size=25))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_normalisation_is_idempotent(spark, t):
    df = spark.createDataFrame([(t,)], "t string").select(text.normalize(F.col("t")).alias("a")).select("a", text.normalize(F.col("a")).alias("b"))
    a, b = df.first()
    assert a == b


def test_readers(spark, tmp_path):
    p = tmp_path / "x.geojsonseq"
    p.write_text('\x1e{"id":"w1","type":"Feature","geometry":{"type":"LineString","coordinates":[[51,36],[51.1,36],[51.1,36.1]]},"properties":{"shop":"bakery"}}\n\x1e{"id":"n1","type":"Feature","geometry":{"type":"Point","coordinates":[51,36]},"properties":{"amenity":"clinic"}}\n', encoding="utf-8")
    f = readers.geojson_lines(spark, str(p))
    assert readers.segments(f).count() == 2
    assert dict(values(f.select("id", readers.place_kind(F.col("tags")).alias("k")), "id", "k")) == {"w1": "bakery", "n1": "medical"}
    q = tmp_path / "c.toml"
    q.write_text('[fee.a]\nknown = true\n[fee.b]\nknown = false\n')
    assert dict(values(readers.config_table(spark, str(q), "name string, known boolean", "fee"), "name", "known")) == {"a": True, "b": False}
    assert list(readers.json_objects('x {"a": {"b": 1}} y {bad {"c": 2}')) == ['{"a": {"b": 1}}', '{"c": 2}']
    d = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    readers.replace_partition(d, str(tmp_path / "t"), "k")
    readers.replace_partition(d.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), "k")
    assert dict(values(spark.read.parquet(str(tmp_path / "t")), "k", "v")) == {"a": 9, "b": 2}
    blob = tmp_path / "blobs"
    blob.mkdir()
    (blob / "f").write_bytes(b"abc")
    assert readers.blobs(spark, str(blob)).first()["key"].startswith("ba7816bf")


def test_intents_hold_what_was_said():
    query = "ویلا در رامسر برای چهار نفر زیر 5 میلیون"
    said = intent.Intent(guest_parts=(4,), budget_toman=5_000_000, basis="per_night", places=("رامسر", "نور"), bedrooms_min=3)
    assert intent.violations(said, query) == {"bedrooms_min": ["3"], "places": ["نور"]}
    kept = intent.without_violations(said, query)
    assert (kept.bedrooms_min, kept.places, kept.guests, kept.budget_toman) == (None, ("رامسر",), 4, 5_000_000)
    assert intent.stated_basis(kept, query).basis == "unknown" and intent.stated_basis(kept, query + " هر شب").basis == "per_night"
    unstated = intent.stated_basis(kept, query)
    assert intent.without(unstated, ["basis:whole_stay", "place:رامسر"]).basis == "whole_stay"
    assert intent.without(unstated, ["budget", "basis:whole_stay"]).basis == "unknown" and intent.without(unstated, ["guests"]).guests is None
    assert intent.missing(intent.Intent(party="couple")) == ["dates"] and intent.wants(unstated, 2).guests == 4


def test_display(spark):
    df = spark.createDataFrame([(12_345_670, 12_345_670, 15_300.0, 15_840.0, 1230.0, 1950.0)], "low bigint, high bigint, a double, b double, m double, n double")
    c = F.col
    got = df.select(display.toman(c("low"), c("high")), display.minutes_range(c("a"), c("b")), display.metres_range(c("m"), c("n")), display.minutes_range(F.lit(600.0), F.lit(600.0))).first()
    assert list(got) == ["۱٬۲۳۴٬۵۶۷ تومان", "۴ ساعت و ۱۵ دقیقه تا ۴ ساعت و ۲۵ دقیقه", "۱٫۲ تا ۲ کیلومتر", "حدود ۱۰ دقیقه"]
