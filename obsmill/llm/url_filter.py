"""URL filters: a blocked Bloom filter in front of an exact hash join, in DataFrame functions only.

Each entry of the lists is a host and a path prefix that stands for the host, its subdomains and
every URL whose path begins so. A URL's keys are its host's last labels with the first characters of
its path, in the numbers of labels and characters that entries have. The Bloom filter, blocks of 256
bits in one literal, has 16 bits for each entry up to MAX_BLOCKS (2 MB, a million entries; with more
it lets more through, and the join works for it). It drops the keys that surely aren't listed; URLs
without others are done, unmoved. The rest meet the entries in an exact hash join, which removes the
false positives, and the longest entry wins (of equal ones that with the longer host). Rules come
before listed sites; a URL that meets neither is allowed.

A null URL or one without ``://`` has an empty host and path, meets no rule and is allowed. A very
long URL takes time in proportion to its length. Each row is judged on its own, so repeated rows and
ids stay; the order of entries doesn't matter; other columns aren't looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm import common

#: Blocks of four longs, from and to, and their bits for an entry.
LEAST_BLOCKS, MAX_BLOCKS, BITS = 16, 65_536, 16
_WORDS = 4
#: Sites listed besides the rules: (host, path prefix).
LISTED = (("spam-farm.example.org", "/"), ("cheap-pills.example.com", "/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, rf"(?s)^.*?://{pattern}", 1), F.lit(""))
    return F.translate(part("([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part("[^/?#]*([^?#]*)")


def _block(blocks: int) -> str:
    return f"cast(pmod(xxhash64(k), {blocks}) as int)"


def _mask(word: int) -> str:
    """SQL of the two bits that key ``k`` sets in one long of its block."""
    bit = lambda shift: f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(k, {word}), {shift}), 64) as int))"
    return f"({bit(8)} | {bit(20)})"


def bloom(entries: DataFrame, blocks: int) -> str:
    """SQL of the filter over entries (host, path): an array of 4 * blocks longs."""
    words = [0] * (_WORDS * blocks)
    keyed = entries.select(F.concat("host", F.lit("\n"), "path").alias("k"))
    for r in keyed.groupBy(F.expr(_block(blocks)).alias("b")).agg(*(F.expr(f"bit_or({_mask(w)})").alias(f"w{w}") for w in range(_WORDS))).collect():
        words[_WORDS * r["b"] : _WORDS * (r["b"] + 1)] = [r[f"w{w}"] for w in range(_WORDS)]
    return f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)"


def blocks_for(entries: int) -> int:
    return min(MAX_BLOCKS, max(LEAST_BLOCKS, -(-BITS * entries // 256)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame | Sequence[tuple[str, str]] = LISTED, *, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Per row: id_col, host, path, rule, verdict and whether a listed site holds the URL.

    rules: (host, path prefix, ``allow`` or ``block``). listed: (host, path prefix) of blocked sites.
    """
    spark = pages.sparkSession
    entries = spark.createDataFrame([(h.lower(), p, v, True) for h, p, v in rules], "host string, path string, verdict string, is_rule boolean")
    sites = listed if isinstance(listed, DataFrame) else spark.createDataFrame(list(listed), "host string, path string")
    entries = entries.unionByName(sites.select(F.lower("host").alias("host"), "path", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))).dropDuplicates(["host", "path", "is_rule"])
    entries = entries.withColumn("key", F.concat("host", F.lit("\n"), "path"))
    labels = "length(host) - length(replace(host, '.', '')) + 1"
    size = entries.agg(F.count("*").alias("n"), F.collect_set(F.struct(F.expr(labels).alias("labels"), F.length("path").alias("chars"))).alias("shapes")).first()

    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    none = [F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed")]
    if not size["n"]:
        return base.select(F.col("id").alias(id_col), "host", "path", *none)
    shapes = ", ".join(f"struct({x['labels']} AS labels, {x['chars']} AS chars)" for x in sorted(size["shapes"]))
    keys = f"transform(filter(array({shapes}), s -> s.labels <= {labels} AND s.chars <= length(path)), s -> concat(substring_index(host, '.', -s.labels), '\n', substring(path, 1, s.chars)))"
    blocks = blocks_for(size["n"])
    passed = " AND ".join(f"(element_at({bloom(entries, blocks)}, {_WORDS} * {_block(blocks)} + {w + 1}) & {_mask(w)}) = {_mask(w)}" for w in range(_WORDS))
    probed = base.withColumn("hits", F.expr(f"filter({keys}, k -> {passed})"))
    clean = probed.where("size(hits) = 0").select(F.col("id").alias(id_col), "host", "path", *none)

    known = entries.select("key", F.col("host").alias("at"), F.col("path").alias("prefix"), F.col("verdict").alias("says"), "is_rule")
    hits = probed.where("size(hits) > 0").withColumn("row", F.monotonically_increasing_id()).select("row", "id", "host", "path", F.explode("hits").alias("key"))
    if size["n"] <= common.BROADCAST_ROWS:
        met = hits.join(F.broadcast(known), "key", "left")
    else:  # a host that many URLs have is dealt out; equal hashes of different keys are told apart below
        met = common.join_split(hits.withColumn("h", F.xxhash64("key")), known.select(F.xxhash64("key").alias("h"), F.col("key").alias("of"), "at", "prefix", "says", "is_rule"), "h", "left")
        met = met.select("row", "id", "host", "path", *(F.when(F.col("of") == F.col("key"), F.col(c)).alias(c) for c in ("at", "prefix", "says", "is_rule")))
    order = lambda of: F.max(F.when(of, F.struct(F.length("at") + F.length("prefix"), F.length("at"), F.concat("at", "prefix").alias("rule"), "says")))
    best = met.groupBy("row").agg(F.first(F.struct("id", "host", "path")).alias("url"), order(F.col("is_rule")).alias("best"), F.coalesce(F.bool_or(~F.col("is_rule")), F.lit(False)).alias("listed"))
    verdict = F.coalesce(F.col("best.says"), F.when(F.col("listed"), "block").otherwise("allow"))
    return clean.unionByName(best.select(F.col("url.id").alias(id_col), "url.host", "url.path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed"))
