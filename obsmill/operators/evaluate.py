"""Evaluation: weighted precision and recall, thresholds, clusters, rankings, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.functions.numeric import wilson


def stratum_weights(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds weight: the stratum's size over its labelled rows so far. sizes: stratum, size."""
    done = labels.groupBy("stratum").agg(F.count("*").alias("__n")).join(sizes, "stratum")
    return labels.join(done.select("stratum", (F.col("size") / F.col("__n")).alias("weight")), "stratum")


def proportion(hit: Column, weight: Column, of: Column) -> Column:
    """Weighted share of ``hit`` among ``of`` with a Wilson interval at the effective number (an aggregate)."""
    w = F.when(of, weight)
    n = F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w))
    p = F.try_divide(F.sum(F.when(of & hit, weight).otherwise(0.0)), F.sum(w))
    return wilson(p * n, F.coalesce(n, F.lit(0.0)))


def confusion(labels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Weighted precision, recall and F1 at each threshold (a small table: threshold).

    labels: score, blocked, label (match, non_match, unsure), weight. Unsure rows don't count; rows
    that blocking missed are never predicted.
    """
    known = labels.where("label <> 'unsure'").withColumn("y", F.col("label") == "match")
    at = known.crossJoin(F.broadcast(thresholds)).withColumn("p", F.col("blocked") & (F.col("score") >= F.col("threshold")))
    w = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(0.0))
    out = at.groupBy("threshold").agg(w(F.col("p") & F.col("y")).alias("tp"), w(F.col("p") & ~F.col("y")).alias("fp"), w(~F.col("p") & F.col("y")).alias("fn"), proportion(F.col("y"), F.col("weight"), F.col("p")).alias("precision"), proportion(F.col("p"), F.col("weight"), F.col("y")).alias("recall"))
    return out.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def operating_point(curve: DataFrame, least: float = 0.95, least_low: float = 0.92) -> DataFrame:
    """The lowest threshold whose precision and its lower bound pass; precision needn't rise with it."""
    return curve.where((F.col("precision.estimate") >= least) & (F.col("precision.low") >= least_low)).orderBy("threshold").limit(1)


def choose_threshold(scored: DataFrame, least_precision: float = 0.85, least_predicted: int = 10) -> DataFrame:
    """By tag the threshold with most hits at enough precision; the highest of equal ones. scored: tag, score, y."""
    by_score = scored.groupBy("tag", "score").agg(F.count_if("y").alias("h"), F.count("*").alias("n"))
    down = W.partitionBy("tag").orderBy(F.desc("score"))
    run = by_score.select("tag", "score", F.sum("h").over(down).alias("hits"), F.sum("n").over(down).alias("predicted"))
    good = run.where((F.col("predicted") >= least_predicted) & (F.col("hits") >= least_precision * F.col("predicted")))
    return good.groupBy("tag").agg(F.max(F.struct("hits", F.col("score").alias("threshold"), "predicted")).alias("m")).select("tag", "m.threshold", "m.hits", "m.predicted")


def bcubed(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean precision and recall over shared elements. Both: id, cluster.

    Counted by cell of the two clusterings: no pair of elements is made.
    """
    both = predicted.select("id", F.col("cluster").alias("p")).join(gold.select("id", F.col("cluster").alias("g")), "id")
    cell = both.groupBy("p", "g").agg(F.count("*").alias("c"))
    np_, ng = cell.groupBy("p").agg(F.sum("c").alias("np")), cell.groupBy("g").agg(F.sum("c").alias("ng"))
    full = cell.join(np_, "p").join(ng, "g")
    sq = F.col("c").cast("double") * F.col("c")
    return full.agg((F.sum(sq / F.col("np")) / F.sum("c")).alias("precision"), (F.sum(sq / F.col("ng")) / F.sum("c")).alias("recall"))


def ndcg(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k by query and system, gain 2^g - 1; the ideal is over all judged grades of the query.

    results: query, system, item, rank; grades: query, item, grade.
    """
    gain = lambda r: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(r + 1)
    got = results.where(F.col("rank") <= k).join(grades, ["query", "item"]).groupBy("query", "system").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    best = grades.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "item"))).where(F.col("rank") <= k).groupBy("query").agg(F.sum(gain(F.col("rank"))).alias("ideal"))
    asked = results.select("query", "system").distinct().join(best, "query").join(got, ["query", "system"], "left")
    return asked.select("query", "system", F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")), F.lit(0.0)).alias("ndcg"))


def recall_at(results: DataFrame, grades: DataFrame, k: int = 20, relevant: int = 1) -> DataFrame:
    good = grades.where(F.col("grade") >= relevant)
    n = good.groupBy("query").agg(F.count("*").alias("n"))
    got = results.where(F.col("rank") <= k).join(good, ["query", "item"]).groupBy("query", "system").agg(F.count("*").alias("hit"))
    return results.select("query", "system").distinct().join(n, "query").join(got, ["query", "system"], "left").select("query", "system", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def slot_accuracy(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Shares of right slots over the union of both sides' slots, and of wholly right cases. Both: case, slot, value."""
    e, f = expected.select("case", "slot", F.col("value").alias("e")), found.select("case", "slot", F.col("value").alias("f"))
    each = e.join(f, ["case", "slot"], "full").select("case", F.coalesce(F.col("e") == F.col("f"), F.lit(False)).alias("ok"))
    per = each.groupBy("case").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    return per.agg((F.sum("k") / F.sum("n")).alias("accuracy"), F.avg(F.when(F.col("n") == F.col("k"), 1.0).otherwise(0.0)).alias("exact"))


def nearest_rank(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """Quantile by nearest rank, round(q (n - 1)) with halves to even."""
    spec = W.partitionBy(*keys)
    ranked = df.withColumn("__n", F.count("*").over(spec)).withColumn("__i", F.row_number().over(spec.orderBy(value)) - 1)
    return ranked.where(F.col("__i") == F.bround(F.lit(q) * (F.col("__n") - 1), 0)).groupBy(*keys).agg(F.max(value).alias(value))


def stance_counts(labels: DataFrame, found: DataFrame) -> DataFrame:
    """TP, FP, FN by feature; a wrong stance is both. Both: id, feature, stance (none: says nothing)."""
    a, b = labels.select("id", "feature", F.col("stance").alias("y")), found.select("id", "feature", F.col("stance").alias("p"))
    both = a.join(b, ["id", "feature"], "left").withColumn("p", F.coalesce("p", F.lit("none")))
    said, true = F.col("p") != "none", F.col("y") != "none"
    return both.groupBy("feature").agg(F.count_if(said & (F.col("p") == F.col("y"))).alias("tp"), F.count_if(said & (F.col("p") != F.col("y"))).alias("fp"), F.count_if(true & (F.col("p") != F.col("y"))).alias("fn"))


def score_bands(df: DataFrame, order: list[Column], bands: int) -> DataFrame:
    """Adds band: equal shares of the ranking, cut at floor(i n / bands)."""
    ranked = df.withColumn("__i", F.row_number().over(W.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(W.partitionBy()))
    return ranked.withColumn("band", F.floor(((F.col("__i") + 1) * bands - 1) / F.col("__n")).cast("int")).drop("__i", "__n")


def hash_sample(df: DataFrame, seed: str, id_col: str, n: int) -> DataFrame:
    """The n rows of least SHA-256 of seed and id."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256)).limit(n)


def strata_draw(df: DataFrame, strata: list[tuple[str, Column, list[Column], int]], id_col: str) -> DataFrame:
    """Draws for strata in turn, each from rows that none before it took: stratum name, filter, order, size."""
    out = None
    for name, where, order, n in strata:
        pool = df.where(where)
        if out is not None:
            pool = pool.join(out.select(id_col), id_col, "left_anti")
        some = pool.orderBy(*order).limit(n).withColumn("stratum", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out


def running_budget(calls: DataFrame, budget: float, order: list[str]) -> DataFrame:
    """Adds spent (running sum) and allowed (whether the call still fits the budget)."""
    spent = F.sum("cost").over(W.partitionBy("job").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return calls.withColumn("spent", spent).withColumn("allowed", F.col("spent") <= budget)


def original_labels(labels: DataFrame, revisions: DataFrame) -> DataFrame:
    """Labels as they were before any revision: the ``before`` of the earliest one."""
    first = revisions.groupBy("id").agg(F.min_by("before", "revised_at").alias("before"))
    return labels.join(first, "id", "left").select("id", F.coalesce("before", "label").alias("label"))


def revised_labels(labels: DataFrame, revisions: DataFrame) -> DataFrame:
    """Labels after all revisions, or as they were if any revision doesn't fit what it revises."""
    first, last = revisions.groupBy("id").agg(F.min_by("before", "revised_at").alias("b")), revisions.groupBy("id").agg(F.max_by("after", "revised_at").alias("after"))
    joined = first.join(last, "id").join(labels, "id", "left")
    bad = joined.agg(F.coalesce(F.bool_or(~F.col("b").eqNullSafe(F.col("label"))), F.lit(False)).alias("bad"))
    return labels.join(last, "id", "left").join(F.broadcast(bad)).select("id", F.when(F.col("bad"), F.col("label")).otherwise(F.coalesce("after", "label")).alias("label"))
