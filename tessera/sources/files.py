"""Sources and sinks: JSON lines, artifacts, run reports, GeoJSON, snapshots, CSV. All through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import urls as U
from tessera.operators import scan
from tessera.storage import stored

CANDIDATES = (
    "url string, label string, city string, state_region string, country string, source_directory string, source_refs array<string>, notes string, "
    "latitude double, longitude double, viewer_url string, feed_endpoint string, source_page string, source_record_id string, raw_metadata string, "
    "source_domain string, source_query string, target_locations array<string>, stream_substatus string, stream_confidence double, stream_reasons array<string>"
)
RECORDS = (
    "id string, label string, city string, region string, country string, continent string, latitude double, longitude double, url string, feed_type string, "
    "playlist_type string, variant_streams array<string>, source_directory string, source_refs array<string>, legitimacy_score string, last_verified string, "
    "status string, notes string, stream_substatus string, stream_confidence double, stream_reasons array<string>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object per line that isn't blank; a line that isn't JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """(_artifact, _line, doc VARIANT, _raw): lines that aren't an object keep their text in _raw.

    _line is the place in the file, counted only if asked for: each block of a file counts its own lines, and what
    the blocks before it hold is added.
    """
    where, block = F.col("_metadata.file_path").alias("_artifact"), F.col("_metadata.file_block_start").alias("_block")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(where, block, F.col("value"))
    if numbered:
        lines = lines.withColumn("_id", F.monotonically_increasing_id())
        blocks = lines.groupBy("_artifact", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        before = Window.partitionBy("_artifact").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        lines = lines.join(blocks, ["_artifact", "_block"]).withColumn("_line", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int"))
    else:
        lines = lines.withColumn("_line", F.lit(None).cast("int"))
    lines = lines.where(F.trim("value") != "")
    doc = F.try_parse_json("value")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    return lines.select("_artifact", "_line", F.when(is_object, doc).alias("doc"), F.when(~is_object, F.col("value")).alias("_raw"))


URL_KEYS = ("url", "candidate_url", "stream_url", "page_url", "source_page", "root_url", "endpoint")


def first_member(doc: Column, names: Sequence[str]) -> Column:
    """The first of several members that isn't missing or empty; 0 counts."""
    return F.coalesce(*[F.nullif(F.try_variant_get(doc, f"$.{n}", "string"), F.lit("")) for n in names])


def read_artifacts(spark: SparkSession, folder: str, names: str = "*.jsonl") -> DataFrame:
    """All files of such names below a folder: (artifact, doc, url, domain)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(folder)
    rows = lines.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("artifact"), F.try_parse_json("value").alias("doc"))
    return rows.withColumn("url", first_member(F.col("doc"), URL_KEYS)).withColumn("domain", F.lower(U.domain(F.col("url"))))


def flattened(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(key, value): leaves of nested JSON under dotted keys, however deep; a list gives key.len.

    A level is a pass over the objects that the level before left; they are written, so that depth adds no lineage.
    """
    rows, out = stored(docs.select(F.lit("").alias("key"), F.col(doc).alias("v")).where(F.col("v").isNotNull()), "level"), None
    while True:
        kind = F.schema_of_variant("v")
        is_list, is_object = F.startswith(kind, F.lit("ARRAY")), F.startswith(kind, F.lit("OBJECT"))
        length = F.size(F.try_variant_get("v", "$", "array<variant>")).cast("string")
        leaf = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
        part = rows.where(~is_object).select(F.when(is_list, F.concat("key", F.lit(".len"))).otherwise(F.col("key")).alias("key"), F.when(is_list, length).otherwise(leaf).alias("value"))
        out = part if out is None else out.unionByName(part)
        inner = rows.where(is_object).select("key", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v"))
        rows = stored(inner.select(F.when(F.col("key") == "", F.col("k")).otherwise(F.concat("key", F.lit("."), "k")).alias("key"), "v"), "level")
        if rows.isEmpty():
            return out


def _outside(parts: Column, start: int) -> Column:
    """Brackets that open less those that close, in every other part of a text that is split at its quotes."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == start), "")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return count(r"[{\[]") - count(r"[}\]]")


def geojson_units(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, unit, text, whole): the features of collections as text, each file read by as many tasks as it has blocks.

    Files are split at every closing brace. Whether a piece begins in a string, and how deep it ends, are running
    counts of quotes and of brackets outside strings, so they are found by scans over segments of a file. What lies
    between two places of depth 2, inside the array of a collection's `features`, is a feature, put together of its
    pieces. whole is false for a feature that its file breaks off, and for what follows a file's broken end.
    """
    lines = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    m = F.col("_metadata")
    rows = lines.select(m["file_path"].alias("artifact"), m["file_block_start"].alias("block"), m["file_size"].alias("size"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"))
    by, order = ["artifact"], ["block", "nth"]
    pieces = scan.cut(rows, by, order)
    # a file's last piece may lack its brace: then the pieces and their braces are longer than the file
    last = pieces.groupBy("artifact").agg(F.max(F.struct(*order)).alias("last"), (F.sum(F.octet_length("text") + 1) > F.max("size")).alias("open_end"))
    pieces = pieces.join(last, "artifact").withColumn("brace", ~(F.col("open_end") & (F.struct(*order) == F.col("last"))))
    pieces = pieces.withColumn("parts", F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)).withColumn("quotes", F.size("parts") - 1)
    pieces = scan.running(pieces, by, order, "quotes", "quotes_so_far")
    starts_in, ends_in = (F.col("quotes_so_far") - F.col("quotes")) % 2 == 1, F.col("quotes_so_far") % 2 == 1
    change = F.when(starts_in, _outside(F.col("parts"), 1)).otherwise(_outside(F.col("parts"), 0)) - F.when(F.col("brace") & ~ends_in, 1).otherwise(0)
    pieces = scan.running(pieces.withColumn("change", change), by, order, "change", "depth")
    ends = (F.col("depth") <= 2) & ~ends_in & F.col("brace")
    pieces = scan.running(pieces.withColumns({"ends": ends.cast("int"), "from_depth": F.col("depth") - F.col("change")}), by, order, "ends", "units")
    pieces = pieces.withColumn("unit", F.col("units") - F.col("ends"))
    whole_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.concat("text", F.when(F.col("brace"), "}").otherwise("")).alias("t")))), lambda p: p["t"]), "")
    units = pieces.groupBy("artifact", "unit").agg(whole_text.alias("text"), F.min_by("from_depth", F.struct(*order)).alias("from_depth"), F.max("ends").alias("ends"), F.min_by("block", F.struct(*order)).alias("block"))
    # units that begin above depth 2, or with the end of an array, may open one, of features or else; others are in the array opened last
    opened = F.regexp_extract("text", r'(?s)"features"\s*:\s*\[(?:\s*(\{.*))?$', 0)
    apart = (F.col("from_depth") < 2) | F.col("text").rlike(r"^\s*\]")
    units = units.withColumn("opens", F.when(apart, opened != ""))
    units = scan.filled(units, by, ["unit"], F.col("opens"), "inside")
    start = F.when(apart, F.regexp_extract("text", r'(?s)"features"\s*:\s*\[\s*(\{.*)$', 1)).otherwise(F.regexp_extract("text", r"(?s)^[\s,]*(\{.*)$", 1))
    return units.where(F.col("inside") & (start != "")).select("artifact", "unit", start.alias("text"), (F.col("ends") == 1).alias("whole"))


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad rows): features of collections, properties lifted, [longitude, latitude] taken apart.

    Bad are features without a point, with coordinates out of range, that aren't JSON, or that the end of a file cuts off.
    """
    units = stored(geojson_units(spark, path), "features")
    doc = F.when(F.col("whole"), F.try_parse_json("text"))
    features = units.select(doc.alias("f"), "text")
    records, bad = split_features(features.where(F.col("f").isNotNull()))
    return records, bad.unionByName(features.where(F.col("f").isNull()).select(F.col("text").alias("_raw")))


def split_features(features: DataFrame, f: str = "f") -> tuple[DataFrame, DataFrame]:
    """(records, bad rows) of a column of feature variants."""
    at = F.try_variant_get(f, "$.geometry.coordinates", "array<double>")
    text = ("id", "label", "city", "region", "country", "continent", "url", "feed_type", "legitimacy_score", "last_verified", "status", "notes")
    rows = features.select(
        *[F.try_variant_get(f, f"$.properties.{c}", "string").alias(c) for c in text],
        F.get(at, F.lit(1)).alias("latitude"),
        F.get(at, F.lit(0)).alias("longitude"),
        F.to_json(f).alias("_raw"),
    )
    good = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("id").isNotNull() & F.col("url").isNotNull(), F.lit(False))
    return rows.where(good).drop("_raw"), rows.where(~good).select("_raw")


def geojson_features(records: DataFrame) -> DataFrame:
    """(feature): one RFC 7946 point per record that has coordinates, as JSON; every other column is a property."""
    located = records.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    properties = F.struct(*[c for c in records.columns if c not in ("latitude", "longitude")])
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return located.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def geojson_metadata(records: DataFrame, generated: str) -> DataFrame:
    """One row: total, live, dead, unknown (any other status), unmapped, generated."""
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "live").alias("live"),
        F.count_if(F.col("status") == "dead").alias("dead"),
        F.count_if(~F.coalesce(F.col("status").isin("live", "dead"), F.lit(False))).alias("unknown"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("unmapped"),
        F.lit(generated).alias("generated"),
    )


def write_geojson(records: DataFrame, path: str, generated: str) -> None:
    """Features as JSON lines in parallel part files, and metadata beside them; readers take the folder."""
    geojson_features(records).write.mode("overwrite").text(f"{path}/features")
    geojson_metadata(records, generated).write.mode("overwrite").json(f"{path}/metadata")


def grouped_catalogue(records: DataFrame) -> DataFrame:
    """(continent, country, city, items): per city its records in label order, with status, feed type and notes.

    The nested form is for reading by people; a city's list must fit a row.
    """
    item = F.struct("label", "url", "status", "feed_type", "notes")
    return records.groupBy("continent", "country", "city").agg(F.sort_array(F.collect_list(item)).alias("items"))


def write_grouped(records: DataFrame, path: str) -> None:
    grouped_catalogue(records).write.mode("overwrite").partitionBy("continent").json(path)


def write_snapshot(records: DataFrame, path: str, date: str) -> None:
    """A dated snapshot, only if there is none of that date."""
    records.write.mode("ignore").parquet(f"{path}/snapshot_date={date}")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows; an empty table writes nothing."""
    if rows.limit(1).count():
        rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def split_candidates(directory: DataFrame, search: DataFrame, order: str = "seq", both_distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merged candidates in two: streams, and the rest. The first of a URL wins; unless both_distinct, among the rest only."""
    from tessera.operators.windows import first_wins

    merged = directory.unionByName(search, allowMissingColumns=True)
    stream = U.is_stream(F.col("url"), "loose")
    streams, rest = merged.where(stream), merged.where(~stream)
    return first_wins(streams, ["url"], order) if both_distinct else streams, first_wins(rest, ["url"], order)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: url, html and what else the table has."""
    return spark.read.parquet(path)
