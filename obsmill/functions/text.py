"""Text normalisation, digits, trigrams, spans: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are one letter for matching, and characters that carry no meaning.
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ۀ": "ه", " ": " ", " ": " "}
DROPPED = "ـ​‍﻿­‎‏"
ZWNJ = "‌"
DIACRITICS = "[ً-ٰٟ]"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LATIN_DIGITS = "0123456789"


def latin_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, LATIN_DIGITS * 2)


def persian_digits(text: Column) -> Column:
    return F.translate(text, LATIN_DIGITS, PERSIAN_DIGITS)


def normalize(text: Column) -> Column:
    """Canonical form for matching; applying it twice changes nothing more."""
    source, target = "".join(LETTERS), "".join(LETTERS.values())
    t = F.translate(text, source + PERSIAN_DIGITS + ARABIC_DIGITS + DROPPED, target + LATIN_DIGITS * 2)
    t = F.regexp_replace(t, DIACRITICS, "")
    t = F.regexp_replace(t, f"{ZWNJ}+", ZWNJ)
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, f"[ {ZWNJ}]* [ {ZWNJ}]*", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), f"^{ZWNJ}|{ZWNJ}$", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of a text without its white space; none when it is shorter."""
    compact = F.regexp_replace(text, r"\s+", "")
    n = F.length(compact)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(compact, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), inter / (F.size(a) + F.size(b) - inter)).otherwise(F.lit(0.0))


def place_key(text: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Spelling-insensitive key: normalised, lower case, one prefix and all spaces and joiners dropped."""
    t = F.lower(normalize(text))
    if prefixes:
        t = F.regexp_replace(t, "^(?:" + "|".join(prefixes) + ")", "")
    return F.regexp_replace(t, f"[\\s{ZWNJ}]+", "")


def mentions(text: Column, word: Column) -> Column:
    """Whether a text holds a word as a whole word, words being split by spaces."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def verbatim(text: Column, span: Column) -> Column:
    """Whether a non-empty span is in the text as it stands."""
    return F.coalesce((F.length(span) > 0) & F.contains(text, span), F.lit(False))


def slots(text: Column) -> Column:
    """Names of the slots ``{F1}`` in a template."""
    return F.regexp_extract_all(text, F.lit(r"\{([A-Z]\d+)\}"), 1)


def render(template: Column, names: Column, values: Column) -> Column:
    """A template with each slot replaced; names and values are arrays of one length."""
    return F.aggregate(F.arrays_zip(names.alias("n"), values.alias("v")), template, lambda t, x: F.replace(t, F.concat(F.lit("{"), x["n"], F.lit("}")), x["v"]))


def sha(*parts: Column, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *(p.cast("string") for p in parts)), 256)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/:]+)", 1)


def media_type(data: Column) -> Column:
    """From a file's first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E47"), "image/png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("47494638"), "image/gif")
