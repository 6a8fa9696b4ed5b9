"""Link graph: expansion from root pages over stored pages, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.storage import stored

#: Words of links worth following and of those that aren't (fixed values).
POSITIVE_LINKS = ("camera", "cctv", "traffic", "region", "map", "stream", "viewer", "player", "cameralisting")
NEGATIVE_LINKS = ("privacy", "terms", "careers", "login", "signup")


def expand(
    roots: DataFrame,
    links: DataFrame,
    max_depth: int = 5,
    max_pages: int = 250,
    same_host: bool = True,
    positive: Sequence[str] = (),
    negative: Sequence[str] = NEGATIVE_LINKS,
) -> DataFrame:
    """(root, url, depth, parent): pages reached from each root, each once, at its least depth, from its least parent.

    roots (url); links (page, link), as of stored pages. A root gets at most max_pages pages, those of lesser
    depth first, then by URL. A root that has them goes no deeper, as nothing further could be among them. Each
    level is one join and one anti join, and is written to the shared folder.
    """
    words = lambda ws: "|".join(ws)
    steps = links.select("page", "link").distinct()
    if same_host:
        steps = steps.where(U.authority(F.col("page")) == U.authority(F.col("link")))
    if positive:
        steps = steps.where(F.lower("link").rlike(words(positive)))
    if negative:
        steps = steps.where(~F.lower("link").rlike(words(negative)))
    steps = stored(steps, "steps")
    frontier = roots.select(F.col("url").alias("root"), "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct()
    seen = frontier = stored(frontier, "level")
    pages = seen.groupBy("root").agg(F.count("*").alias("pages"))
    for depth in range(1, max_depth + 1):
        full = pages.where(F.col("pages") >= max_pages).select("root")
        frontier = frontier.join(full, "root", "left_anti")
        reached = frontier.join(steps, frontier["url"] == steps["page"]).groupBy("root", F.col("link").alias("url")).agg(F.min("page").alias("parent"))
        fresh = reached.join(seen, ["root", "url"], "left_anti").select("root", "url", F.lit(depth).alias("depth"), "parent")
        nth = F.row_number().over(Window.partitionBy("root").orderBy("url"))
        fresh = fresh.withColumn("nth", nth).where(F.col("nth") <= max_pages).join(pages, "root").where(F.col("nth") + F.col("pages") <= max_pages)
        frontier = stored(fresh.drop("nth", "pages"), "level")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
        pages = seen.groupBy("root").agg(F.count("*").alias("pages"))
    return seen


def lineage(reached: DataFrame, depth: int) -> DataFrame:
    """(root, url, parent_pages): the pages from the root to each page, by joins up the levels."""
    out = reached.select("root", "url", F.col("parent").alias("_up"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("parent_pages"))
    ups = reached.select("root", F.col("url").alias("_up"), F.col("parent").alias("_next"))
    for _ in range(depth - 1):
        out = out.join(ups, ["root", "_up"], "left").select(
            "root", "url", F.col("_next").alias("_up"), F.when(F.col("_next").isNotNull(), F.array_prepend("parent_pages", F.col("_next"))).otherwise(F.col("parent_pages")).alias("parent_pages")
        )
    return out.select("root", "url", "parent_pages")
