"""Geography: lookup chain, continents, repair of regions, records, density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import urls as U

#: Words that say nothing of a camera's place (fixed values).
GENERIC_LABEL_WORDS = ("LIVE", "STREAM", "CAM", "CAMERA", "WEBCAM", "VIEW", "ONLINE", "NOW", "HD", "FEED", "VIDEO", "WATCH")


def place_of_label(label: Column) -> Column:
    """The place in a label: what stands before a word of viewing; a dash becomes a comma; null if it is generic or too short."""
    cut = F.regexp_replace(label, r"(?i)\s*\b(?:view|overlooking|panoram\w*|live\s*cam)\b.*$", "")
    bare = F.trim(F.replace(cut, F.lit(" - "), F.lit(", ")))
    words = F.filter(F.split(F.upper(bare), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    generic = F.size(F.filter(words, lambda w: ~w.isin(*GENERIC_LABEL_WORDS))) == 0
    return F.when((F.length(bare) >= 3) & ~generic, bare)


def looked_up(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Add geo_source, geo_confidence and the place found first: by city and country, city, label, host, country.

    gazetteer: kind ("city_country", "city", "label", "host", "country"), key in lower case, latitude,
    longitude, country, region, continent. One join per kind, so a large gazetteer is shuffled and a
    small one broadcast as Spark finds it; of several entries of a key the least counts.
    """
    value = F.struct("latitude", "longitude", F.col("country").alias("country"), "region", "continent")
    entries = gazetteer.select("kind", F.lower("key").alias("key"), value.alias("place")).groupBy("kind", "key").agg(F.min("place").alias("place"))
    known = lambda c: F.nullif(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))
    keys = {
        "city_country": F.concat(known(F.col("city")), F.lit("|"), known(F.col("country"))),
        "city": known(F.col("city")),
        "label": F.lower(place_of_label(F.col("label"))),
        "host": F.lower(U.domain(F.col("url"))),
        "country": known(F.col("country")),
    }
    out = rows.withColumns({f"_{k}": v for k, v in keys.items()})
    for kind in keys:
        part = entries.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.col("place").alias(f"_p_{kind}"))
        out = out.join(part, f"_{kind}", "left")
    place = F.coalesce(*[F.col(f"_p_{k}") for k in keys])
    source = F.coalesce(*[F.when(F.col(f"_p_{k}").isNotNull(), F.lit(k)) for k in keys])
    out = out.withColumns({"geo_source": source, "geo": place})
    confidence = F.when(F.col("geo_source") == "host", "low").when(F.col("geo.country").isNotNull(), "high").when(F.col("geo").isNotNull(), "medium")
    return out.withColumn("geo_confidence", confidence).drop(*[f"_{k}" for k in keys], *[f"_p_{k}" for k in keys])


def with_continent(rows: DataFrame, continents: DataFrame, country: str = "country") -> DataFrame:
    """Add continent by a country's exact name; Unknown if the table (country, continent) has none."""
    dim = continents.select(F.col("country").alias("_country"), F.col("continent").alias("_continent"))
    out = rows.drop("continent").join(dim, F.col(country) == F.col("_country"), "left")
    return out.withColumn("continent", F.coalesce("_continent", F.lit("Unknown"))).drop("_country", "_continent")


def repaired_regions(rows: DataFrame, aliases: DataFrame, regions: DataFrame, noise: Sequence[str] = ()) -> DataFrame:
    """Country aliases (alias, country) resolved; a sub-national name (region, country) in country moves to region; noise goes."""
    low = lambda c: F.lower(F.trim(c))
    silent = [n.lower() for n in noise]
    out = rows
    for c in ("city", "region", "country"):
        out = out.withColumn(c, F.when(low(F.col(c)).isin(*silent) if silent else F.lit(False), F.lit(None).cast("string")).otherwise(F.col(c)))
    a = aliases.select(low(F.col("alias")).alias("_alias"), F.col("country").alias("_as"))
    out = out.join(a, low(F.col("country")) == F.col("_alias"), "left").withColumn("country", F.coalesce("_as", "country")).drop("_alias", "_as")
    r = regions.select(low(F.col("region")).alias("_name"), F.col("country").alias("_of"))
    out = out.join(r, low(F.col("country")) == F.col("_name"), "left")
    moves = F.col("_of").isNotNull()
    empty = F.coalesce(F.trim("region"), F.lit("")) == ""
    return out.withColumns({"region": F.when(moves & empty, F.col("country")).otherwise(F.col("region")), "country": F.when(moves, F.col("_of")).otherwise(F.col("country"))}).drop("_name", "_of")


def with_coordinates(rows: DataFrame) -> DataFrame:
    """Coordinates from the feed, else from JSON notes, else from the lookup (geo); coordinate_source says which."""
    notes = F.try_parse_json("notes")
    lat, lon = (F.try_variant_get(notes, p, "double") for p in ("$.latitude", "$.longitude"))
    feed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    noted = lat.isNotNull() & lon.isNotNull()
    found = F.col("geo.latitude").isNotNull() & F.col("geo.longitude").isNotNull()
    return rows.withColumns(
        {
            "coordinate_source": F.when(feed, "feed").when(noted, "notes").when(found, "geocoder"),
            "latitude": F.when(feed, F.col("latitude")).when(noted, lat).otherwise(F.col("geo.latitude")),
            "longitude": F.when(feed, F.col("longitude")).when(noted, lon).otherwise(F.col("geo.longitude")),
        }
    )


def records(rows: DataFrame, as_of: str) -> DataFrame:
    """Catalogue records: defaults for what isn't known, an id from city and label, notes on what is missing."""
    city = F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.lit("Unknown"))
    country = F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit("Unknown"))
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), city)
    made = X.slug(city, label)
    unknown = city == "Unknown"
    ident = F.when(unknown | (made == ""), F.concat(F.lit("unknown-"), X.short_hash(F.col("url")))).otherwise(made)
    notes = F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), F.when(F.col("latitude").isNull(), "location_unknown"), F.concat(F.lit("coordinate_source="), F.col("coordinate_source")))
    return rows.withColumns({"id": ident, "label": label, "city": city, "country": country, "notes": notes, "last_verified": F.lit(as_of)})


def density(rows: DataFrame, cell: float = 1.0) -> DataFrame:
    """(lat_cell, lon_cell, n): located records per grid cell."""
    located = rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return located.groupBy(F.floor(F.col("latitude") / cell).alias("lat_cell"), F.floor(F.col("longitude") / cell).alias("lon_cell")).agg(F.count("*").alias("n"))
