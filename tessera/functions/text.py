"""Text expressions and the one Arrow function: the Indel similarity of two texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); two empty texts are alike. Bit-parallel over the shorter text."""
    if not a and not b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def similarity(a: Column, b: Column) -> Column:
    """indel_ratio() of two columns, in Arrow batches; null if either is."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="Float64")

    return ratio(a, b)


def slug(*parts: Column, longest: int = 80) -> Column:
    """Lower-case words joined by -, cut at a word's end."""
    joined = F.lower(F.concat_ws(" ", *parts))
    plain = F.translate(joined, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    dashed = F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, longest + 1), "-[^-]*$", "")
    return F.when(F.length(dashed) <= longest, dashed).otherwise(F.substring(cut, 1, longest))


def short_hash(text: Column, n: int = 10) -> Column:
    return F.substring(F.sha1(text), 1, n)


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last three of them dots if it was longer; line breaks become spaces."""
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 3), F.lit("...")))


def rescued_json(text: Column) -> Column:
    """VARIANT of a model's answer: code fences off, else what lies between the outermost braces; null if that isn't JSON."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?|```\s*$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6 371 000 m radius."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))
