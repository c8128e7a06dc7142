"""Readers and writers: GeoJSON sequences, page objects, sitemaps, config tables, content-addressed blobs."""

from __future__ import annotations

import csv
import json
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Map tags to kinds of places, in order of precedence.
PLACE_TAGS = {
    "shop": {"supermarket": "supermarket", "convenience": "supermarket", "bakery": "bakery", "mall": "shopping"},
    "amenity": {"restaurant": "restaurant", "fast_food": "restaurant", "hospital": "medical", "clinic": "medical", "pharmacy": "medical"},
    "place": {"city": "city_center", "town": "city_center"},
    "landuse": {"forest": "forest"},
}


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON text sequence (a record separator before each is dropped): id, kind, tags, coordinates as JSON."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "^\x1e", "").alias("v")).where("trim(v) <> ''")
    got = raw.select(F.from_json("v", "id string, type string, geometry struct<type: string>, properties map<string, string>").alias("f"), F.get_json_object("v", "$.geometry.coordinates").alias("coordinates"))
    return got.select(F.coalesce("f.id", F.element_at("f.properties", "@id")).alias("id"), F.col("f.geometry.type").alias("kind"), F.col("f.properties").alias("tags"), "coordinates")


def segments(features: DataFrame) -> DataFrame:
    """Segments of line strings: id, a_lon, a_lat, b_lon, b_lat."""
    lines = features.where("kind = 'LineString'").select("id", F.from_json("coordinates", "array<array<double>>").alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.struct(F.element_at("p", i).alias("a"), F.try_element_at("p", i + 1).alias("b")))
    cut = lines.where("size(p) > 1").select("id", F.explode(pairs).alias("s"))
    return cut.select("id", F.col("s.a")[0].alias("a_lon"), F.col("s.a")[1].alias("a_lat"), F.col("s.b")[0].alias("b_lon"), F.col("s.b")[1].alias("b_lat"))


def place_kind(tags: Column) -> Column:
    """A place's kind from its tags: shop, amenity, place, landuse in this order."""
    found = [F.when(F.try_element_at(tags, F.lit(key)) == value, kind) for key, values in PLACE_TAGS.items() for value, kind in values.items()]
    return F.coalesce(*found)


def locations(xml: Column) -> Column:
    """The addresses of a sitemap."""
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)


def embedded(html: Column, element_id: str) -> Column:
    """The JSON text in a script element."""
    return F.regexp_extract(html, rf'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1)


def json_objects(text: str) -> Iterator[str]:
    """Outermost JSON objects in a text that holds other things too."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            yield text[at:end]
        except json.JSONDecodeError:
            end = at + 1
        at = text.find("{", end)


def pushed_chunks(html: str, function: str = "self.__next_f.push") -> str:
    """The strings that a page's scripts push, joined, with their escapes read."""
    out, call = [], f"{function}("
    at = html.find(call)
    while at >= 0:
        try:
            value, end = json.JSONDecoder().raw_decode(html, at + len(call))
            out += [x for x in value if isinstance(x, str)] if isinstance(value, list) else []
        except json.JSONDecodeError:
            end = at + len(call)
        at = html.find(call, end)
    return "".join(out)


def _page_objects(html: pd.Series) -> pd.Series:
    return pd.Series([list(json_objects(pushed_chunks(x) or x)) if x else [] for x in html])


def page_objects(html: Column) -> Column:
    """JSON objects in what a page pushes, or in the page where it pushes nothing."""
    return F.pandas_udf(_page_objects, "array<string>")(html)


def config_table(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """A small TOML, JSONL or CSV file read on the driver."""
    p = Path(path)
    if p.suffix == ".toml":
        data = tomllib.loads(p.read_text(encoding="utf-8"))
        rows = data[key] if key else [data]
        rows = [{"name": k, **v} for k, v in rows.items()] if isinstance(rows, dict) else rows
    elif p.suffix == ".csv":
        with p.open(encoding="utf-8", newline="") as f:
            rows = list(csv.DictReader(f))
        frame = spark.createDataFrame(rows) if rows else spark.createDataFrame([], "name string")
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind))
    else:
        rows = [json.loads(line) for line in p.read_text(encoding="utf-8").splitlines() if line.strip()]
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder by content: key (SHA-256), size, path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("content", 256).alias("key"), F.col("length").alias("size"), "path")


def replace_partition(df: DataFrame, path: str, *columns: str) -> None:
    """Overwrites the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def write_report(df: DataFrame, path: str, name: str, version: int = 1) -> None:
    """Rows as JSON lines, each in an envelope with the report's name and version."""
    df.select(F.lit(name).alias("report"), F.lit(version).alias("version"), F.struct("*").alias("row")).write.mode("overwrite").json(path)
