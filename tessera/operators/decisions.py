"""Decisions that come as text: normalise, apply, plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators.contains import is_small
from tessera.operators.windows import first_wins

#: Words that stand for a decision (fixed values).
ACCEPT = ("accept", "accepted", "allow", "approve", "approved", "keep", "yes", "true", "include", "in_scope")
REJECT = ("reject", "rejected", "deny", "block", "drop", "no", "false", "exclude", "out_of_scope")


def decision_of(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*ACCEPT), "accept").when(low.isin(*REJECT), "reject").otherwise("review")


def confidence_of(value: Column) -> Column:
    """0 to 1; over 1 and up to 100 is a percentage; null for what is no number."""
    x = F.regexp_replace(value, "%", "").try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((x > 1) & (x <= 100), x / 100).otherwise(x))))


def text_list(doc: Column, name: str) -> Column:
    """A member as ARRAY<STRING>: a list of texts, a single text as one, missing as none."""
    many = F.try_variant_get(doc, f"$.{name}", "array<string>")
    one = F.nullif(F.trim(F.try_variant_get(doc, f"$.{name}", "string")), F.lit(""))
    kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))
    return F.when(F.startswith(kind, F.lit("ARRAY")), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def scope_decisions(raw: DataFrame, items: DataFrame, missing: str = "review") -> DataFrame:
    """(item_id, decision, confidence, reason, evidence): one per item.

    raw: item_id, raw text of an answer. Text around the JSON is ignored; what can't be read is rejected
    for scope_decision_parse_error; items without an answer get `missing`.
    """
    doc = X.rescued_json(F.col("raw"))
    parsed = raw.select("item_id", doc.alias("doc"))
    reason = F.coalesce(
        F.nullif(F.array_join(text_list(F.col("doc"), "reason"), "; "), F.lit("")), F.nullif(F.array_join(text_list(F.col("doc"), "reasons"), "; "), F.lit("")), F.lit("")
    )
    told = parsed.select(
        "item_id",
        F.when(F.col("doc").isNull(), "reject").otherwise(decision_of(F.coalesce(F.try_variant_get("doc", "$.decision", "string"), F.lit("")))).alias("decision"),
        F.when(F.col("doc").isNull(), 0.0).otherwise(F.coalesce(confidence_of(F.try_variant_get("doc", "$.confidence", "string")), F.lit(0.0))).alias("confidence"),
        F.when(F.col("doc").isNull(), "scope_decision_parse_error").otherwise(reason).alias("reason"),
        F.when(F.col("doc").isNotNull(), text_list(F.col("doc"), "evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
    one = told.groupBy("item_id").agg(F.min(F.struct("decision", "confidence", "reason", "evidence")).alias("d")).select("item_id", "d.*")
    out = items.select("item_id").distinct().join(one, "item_id", "left")
    return out.select(
        "item_id",
        F.coalesce("decision", F.lit(missing)).alias("decision"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("reason", F.lit("scope_decision_missing")).alias("reason"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def response_table(raw: DataFrame, lists: Sequence[str], legacy: dict[str, str] | None = None, required: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): a batch of JSON answers (item_id, raw) with listed members as arrays.

    legacy: old member name by new name, merged in. required: a boolean without which a row is an error,
    as is one that isn't JSON. coordinates become an array of maps; confidence is clamped.
    """
    parsed = raw.select("item_id", "raw", X.rescued_json(F.col("raw")).alias("doc"))
    need = F.try_variant_get("doc", f"$.{required}", "boolean") if required else F.lit(True)
    good = F.col("doc").isNotNull() & need.isNotNull()
    columns = []
    for name in lists:
        value = text_list(F.col("doc"), name)
        if legacy and name in legacy:
            value = F.array_distinct(F.concat(value, text_list(F.col("doc"), legacy[name])))
        columns.append(value.alias(name))
    rows = parsed.where(good).select(
        "item_id",
        *columns,
        F.coalesce(F.try_variant_get("doc", "$.coordinates", "array<map<string,double>>"), F.array().cast("array<map<string,double>>")).alias("coordinates"),
        F.coalesce(confidence_of(F.try_variant_get("doc", "$.confidence", "string")), F.lit(0.0)).alias("confidence"),
        *([need.alias(required)] if required else []),
    )
    why = F.when(F.col("doc").isNull(), "not_json").otherwise(f"missing_{required}")
    return rows, parsed.where(~good).select("item_id", "raw", why.alias("error"))


def fanned_back(rows: DataFrame, decide, url: str = "url", order: str = "seq") -> DataFrame:
    """Decide once per normalised URL and give the decision to all its rows.

    decide: takes one row per key (_key and the columns of rows) and returns (_key, decision columns).
    """
    keyed = rows.withColumn("_key", U.gate_key(F.col(url)))
    decided = decide(first_wins(keyed, ["_key"], order))
    return keyed.join(decided, "_key", "left").drop("_key")


def original_candidates(streams: DataFrame, candidates: DataFrame) -> DataFrame:
    """Streams with the discovered candidate of the same URL, else one made of the stream and its lineage.

    streams: url, parent_pages, root_url, source_query. candidates: url, label, source_refs and more.
    """
    key = F.lower(F.trim("url"))
    c = candidates.groupBy(key.alias("_key")).agg(F.min(F.struct("url", "label", "source_refs")).alias("_c"))
    out = streams.withColumn("_key", key).join(c, "_key", "left")
    lineage = F.array_distinct(F.filter(F.concat(F.coalesce("parent_pages", F.array().cast("array<string>")), F.array("root_url")), lambda x: x.isNotNull()))
    return out.select(
        F.coalesce("_c.url", "url").alias("url"),
        F.col("_c.label").alias("label"),
        F.coalesce("_c.source_refs", lineage).alias("source_refs"),
        F.col("_c").isNotNull().alias("was_discovered"),
        "source_query",
    )


def new_sources(results: DataFrame, known: DataFrame, url: str = "url", least: int = 2) -> DataFrame:
    """(domain, hits): domains of search results that aren't known and turn up `least` times, for review."""
    hosts = results.select(F.lower(U.domain(F.col(url))).alias("domain")).where(F.col("domain") != "")
    fresh = hosts.join(known.select(F.lower("domain").alias("domain")), "domain", "left_anti")
    return fresh.groupBy("domain").agg(F.count("*").alias("hits")).where(F.col("hits") >= least).withColumn("needs_review", F.lit(True))


def city_queries(cities: DataFrame, languages: DataFrame, terms: DataFrame, templates: DataFrame, per_language: int = 2, most: int = 12) -> DataFrame:
    """(city, n, query): search queries of each city, by template group, in its languages.

    cities (city), languages (city, lang, pos), terms (lang, term, pos), templates (grp, pos, template) with
    {city} and {term}. English takes all its terms, other languages the first per_language.
    """
    spoken = languages.join(terms.withColumnRenamed("pos", "term_pos"), "lang").where((F.col("lang") == "en") | (F.col("term_pos") < per_language))
    joined = cities.join(spoken, "city", "left").withColumns({"term": F.coalesce("term", F.lit("live webcam")), "pos": F.coalesce("pos", F.lit(0)), "term_pos": F.coalesce("term_pos", F.lit(0))})
    if not is_small(templates):
        raise ValueError("templates are a list that a person writes; this table is too long for one")
    made = joined.join(F.broadcast(templates.withColumnRenamed("pos", "template_pos")))
    made = made.withColumn("query", F.replace(F.replace("template", F.lit("{city}"), F.col("city")), F.lit("{term}"), F.col("term")))
    order = F.struct("grp", "template_pos", "pos", "term_pos")
    first = made.groupBy("city", "query").agg(F.min(order).alias("o"))
    lists = first.groupBy("city").agg(F.slice(F.sort_array(F.collect_list(F.struct("o", "query"))), 1, most).alias("qs"))
    return lists.select("city", F.posexplode("qs").alias("n", "q")).select("city", "n", F.col("q.query").alias("query"))


#: Templates of plans, and words of camera types that ask for the traffic ones (fixed values).
TRAFFIC_WORDS = ("traffic", "road", "dot", "highway", "511")


def expanded_plan(places: DataFrame, templates: DataFrame, camera_types: Sequence[str], most: int = 25) -> DataFrame:
    """(pos, query): every location, agency and domain with its templates, distinct in order, at most `most`.

    places (kind, value, pos), templates (kind, template, pos, traffic): both lists of one request.
    """
    traffic = any(w in t.lower() for t in camera_types for w in TRAFFIC_WORDS)
    usable = templates if traffic else templates.where(~F.col("traffic"))
    made = places.withColumnRenamed("pos", "place_pos").join(usable.withColumnRenamed("pos", "template_pos"), "kind")
    made = made.select(F.replace("template", F.lit("{}"), F.col("value")).alias("query"), F.struct("place_pos", "template_pos").alias("o"))
    return made.groupBy("query").agg(F.min("o").alias("o")).orderBy("o", "query").limit(most).select("query")


def tier_sources(sources: DataFrame, tier: int, streams_only: bool = False) -> DataFrame:
    """(url, tier, pos): sources of tiers 1 to `tier` in order, the first of a URL; sources (url, tier, pos, feed_type)."""
    rows = sources.where(F.col("tier") <= tier)
    if streams_only:
        rows = rows.where(F.lower("feed_type").rlike("hls|m3u8"))
    best = rows.groupBy("url").agg(F.min(F.struct("tier", "pos")).alias("o"))
    return best.select("url", "o.tier", "o.pos").orderBy("tier", "pos")


def tier_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("tier").agg(F.count("*").alias("n"))
