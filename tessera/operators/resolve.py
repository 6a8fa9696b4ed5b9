"""Entity resolution: which catalogue records are one, exactly as a greedy pass in arrival order would find.

A record is absorbed by the first leader before it that it matches by URL key, by distance in one city, or
by label in one city; a leader is a record that no earlier leader matches. Matching isn't passed on:
what matches an absorbed record only is a leader. A merge changes neither URL, city, label nor
coordinates, so the matches can be found beforehand and only who leads is settled in rounds.

Matches are kept between classes, never between all records: records of one URL key, one place or one
label are a class, whose members match each other, and only different places or labels are compared. So
a popular title or place costs linear work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.storage import stored

METRES, RATIO = 50.0, 85.0
#: Labels of more letters meet by length: the places where a segment may lie grow with its cube.
LONG = 48
#: Blocks that a city's labels of over LONG letters and one length are dealt to, a task each.
BLOCKS = 16
#: Labels that name nothing (fixed values).
GENERIC_LABELS = ("unknown", "unknown cam", "camera", "live", "stream")


def _near(a: Column, b: Column, metres: float) -> Column:
    return X.haversine_m(a["latitude"], a["longitude"], b["latitude"], b["longitude"]) <= metres


def _classes(rows: DataFrame, *by: str) -> DataFrame:
    """(seq, cls, by): the class of each record, named by its first."""
    first = rows.groupBy(*by).agg(F.min("seq").alias("cls"))
    return rows.select("seq", *by).join(first, list(by))


def places(rows: DataFrame) -> DataFrame:
    """(seq, cls, city, latitude, longitude): located records; those of one city and place are a class."""
    located = rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("city").isNotNull())
    return _classes(located.select("seq", F.lower("city").alias("city"), "latitude", "longitude"), "city", "latitude", "longitude")


def proximity_edges(members: DataFrame, metres: float = METRES) -> DataFrame:
    """(a, b), a < b: pairs of classes of places() of one city within so many metres, on any part of the globe.

    Places are points of the unit sphere, so neither the 180th meridian nor a pole is a border. Space is cut into cubes
    of over twice the chord's length; a place is filed under its cube and looks into the cubes that its reach touches,
    at most eight. Equi-joins on city and cube; half of the globe's girth and more is all places of the city.
    """
    chord = 2 * math.sin(min(metres / (2 * X.EARTH_M), math.pi / 2)) * (1 + 1e-9) + 1e-12
    lat, lon = F.radians(F.col("latitude")), F.radians(F.col("longitude"))
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    cube = lambda c: F.floor(c / (2.0 * chord))
    base = members.where(F.col("cls") == F.col("seq")).select("cls", "city", F.struct("latitude", "longitude").alias("p"), *[c.alias(k) for k, c in axes.items()])
    one = base.select("city", *[cube(F.col(k)).alias(k) for k in axes], F.col("cls").alias("i"), F.col("p").alias("a"))
    two = base.select("city", *axes, F.col("cls").alias("j"), F.col("p").alias("b"))
    for k in axes:
        two = two.withColumn(k, F.explode(F.array_distinct(F.array(cube(F.col(k) - chord), cube(F.col(k) + chord)))))
    near = one.join(two, ["city", *axes]).where((F.col("i") < F.col("j")) & _near(F.col("a"), F.col("b"), metres))
    return near.select(F.col("i").alias("a"), F.col("j").alias("b"))


def labels(rows: DataFrame) -> DataFrame:
    """(seq, cls, city, label): records of a known city whose label says something; those of one city and label, in lower case, are a class."""
    city, label = F.lower(F.trim("city")), F.lower(F.coalesce("label", F.lit("")))
    usable = rows.where(~city.isin("unknown", "") & ~F.trim(label).isin(*GENERIC_LABELS))
    return _classes(usable.select("seq", F.lower("city").alias("city"), label.alias("label")), "city", "label")


def label_edges(members: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(a, b), a < b: pairs of classes of labels() of one city whose labels are alike by more than `ratio`.

    A similarity join by partition: two labels above the ratio are at most `budget` insertions and deletions apart.
    The shorter one is cut into one segment more than that, so one of them is whole in the longer one, and not just
    anywhere: of all segments one has as many changes before it as there are segments before it, so it lies that many
    places or fewer off, by an even difference, and what is left of the budget must do for the rest. City, length,
    budget, number and text of a segment are the join's key. Candidates are told by a hash of letters with their
    counts, of which each change turns one bit, before labels are compared. Labels of over LONG letters would take too
    many places: those meet in the same city by length alone, and by the same bits.
    """
    classes = members.where(F.col("cls") == F.col("seq")).select("cls", "city", "label", F.length("label").alias("n"), letter_bits(F.col("label")).alias("bits"))
    classes = stored(classes.where("n > 0"), "labels")
    found = _by_segments(classes, ratio).unionByName(_by_length(classes, ratio)).distinct()
    one, two = (classes.select(F.col("cls").alias(k), F.col("label").alias(f"l{k}")) for k in ("a", "b"))
    pairs = stored(found, "pairs").join(one, "a").join(two, "b")
    return pairs.where(X.similarity(F.col("la"), F.col("lb")) > ratio).select("a", "b")


def budget(na: Column, nb: Column, ratio: float) -> Column:
    """The most insertions and deletions between labels of these lengths that are alike by more than the ratio; of the parity that they must have."""
    most = F.floor((na + nb) * ((100 - ratio) / 100) + 1e-9)
    return (most - F.pmod(most - na - nb, F.lit(2))).cast("int")


def letter_bits(label: Column) -> Column:
    """256 bits in four words, one turned for each letter and its how-manieth: an insertion or deletion turns exactly one.

    Of 64 bits two fifths of all pairs of 60 letters differ in no more than they may, so most were compared letter by letter.
    """
    letters = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(label)), lambda i: F.substring(label, i, F.lit(1))))
    seats = lambda row: F.transform(row, lambda c, i: F.pmod(F.xxhash64(c, i - F.array_position(row, c)), F.lit(256)).cast("int"))
    turned = lambda seat, i: F.when(F.floor(seat / 64) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), seat % 64)).otherwise(F.lit(0).cast("bigint"))
    words = range(4)
    none = F.struct(*[F.lit(0).cast("bigint").alias(f"w{i}") for i in words])
    bits = lambda row: F.aggregate(seats(row), none, lambda bits, seat: F.struct(*[bits[f"w{i}"].bitwiseXOR(turned(seat, i)).alias(f"w{i}") for i in words]))
    return F.get(F.transform(F.array(letters), bits), F.lit(0))  # bound by a lambda, the letters are sorted once a label, not once a letter


def _alike(d: Column) -> Column:
    return sum((F.bit_count(F.col(f"a_bits.w{i}").bitwiseXOR(F.col(f"b_bits.w{i}"))) for i in range(4)), F.lit(0)) <= d


def _shortest(n: Column, ratio: float) -> Column:
    """The least length that a label alike to one of n letters has."""
    return F.greatest(F.lit(1), F.ceil(n * (ratio / (200 - ratio)) - 1e-9)).cast("int")


def _by_segments(classes: DataFrame, ratio: float) -> DataFrame:
    short = classes.where(F.col("n") <= LONG)
    begin = lambda i, na, d: F.floor(i * na / (d + 1)).cast("int")
    # the shorter label, cut for every budget that it may have with a longer one
    longest = F.least(F.lit(LONG), F.floor(F.col("n") * ((200 - ratio) / ratio) + 1e-9).cast("int"))
    budgets = F.array_distinct(F.transform(F.sequence("n", F.greatest("n", longest)), lambda nb: budget(F.col("n"), nb, ratio)))
    cut = short.withColumn("d", F.explode(F.filter(budgets, lambda d: d >= 0))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, stop = begin(F.col("i"), F.col("n"), F.col("d")), begin(F.col("i") + 1, F.col("n"), F.col("d"))
    cut = cut.select("city", F.col("n").alias("na"), "d", "i", F.substring(F.col("label"), start + 1, stop - start).alias("segment"), F.col("cls").alias("short"), F.col("bits").alias("a_bits"))
    # the longer one, looking for it at every permitted place
    seek = short.withColumn("na", F.explode(F.sequence(_shortest(F.col("n"), ratio), F.col("n")))).withColumn("d", budget(F.col("na"), F.col("n"), ratio))
    more = F.col("n") - F.col("na")
    seek = seek.where(F.col("d") >= more).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, stop = begin(F.col("i"), F.col("na"), F.col("d")), begin(F.col("i") + 1, F.col("na"), F.col("d"))
    rest = F.col("d") - F.col("i")
    moves = F.filter(F.sequence(-F.col("i"), F.col("i"), F.lit(2)), lambda m: (F.abs(more - m) <= rest) & (start + m >= 0) & (stop + m <= F.col("n")))
    seek = seek.withColumn("move", F.explode(moves))
    seek = seek.select("city", "na", "d", "i", F.substring(F.col("label"), start + F.col("move") + 1, stop - start).alias("segment"), F.col("cls").alias("long"), F.col("bits").alias("b_bits"))
    met = cut.join(seek, ["city", "na", "d", "i", "segment"]).where((F.col("short") != F.col("long")) & _alike(F.col("d")))
    return met.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()


def _by_length(classes: DataFrame, ratio: float) -> DataFrame:
    cell = lambda c: F.floor(F.log(c.cast("double")) / math.log((200 - ratio) / ratio)).cast("int")
    long = classes.where(F.col("n") > LONG).select("city", F.col("cls").alias("long"), F.col("n").alias("nb"), F.col("bits").alias("b_bits"))
    # a cell is as wide as the lengths that can be alike: the longer one's own and the one below
    long = long.withColumn("cell", F.explode(F.array(cell(F.col("nb")), cell(F.col("nb")) - 1)))
    other = classes.where(F.col("n") >= _shortest(F.lit(LONG + 1), ratio)).select("city", F.col("cls").alias("short"), F.col("n").alias("na"), F.col("bits").alias("a_bits"), cell(F.col("n")).alias("cell"))
    d = budget(F.col("na"), F.col("nb"), ratio)
    ordered = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("short") < F.col("long"))
    # a city's labels of one length are dealt out: each block of the shorter ones meets all longer ones
    other = other.withColumn("block", F.pmod(F.xxhash64("short"), F.lit(BLOCKS)).cast("int"))
    long = long.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    met = other.join(long, ["city", "cell", "block"]).where(ordered & (d >= F.col("nb") - F.col("na")) & _alike(d))
    return met.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))


def links_of(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, cls, n_links): of each record its class and how many other records match it."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"))
    both = edges.select("a", "b").union(edges.select("b", "a"))
    around = both.join(sizes, both["b"] == sizes["cls"]).groupBy("a").agg(F.sum("size").alias("near"))
    per = sizes.join(around, sizes["cls"] == around["a"], "left").select("cls", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(stored(per, "links"), "cls").select("seq", "cls", "n_links")


def leaders(members: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(seq, leader): who absorbs each record; leaders absorb themselves.

    members (seq, cls): the classes that a record belongs to, one at least. edges (a, b): pairs of classes whose
    records match. In each round the records without an undecided earlier match settle: absorbed if an earlier
    leader matches, else leaders. What a class and its neighbours hold is told by its least leader and its
    least undecided record. Raises if max_rounds don't settle all.
    """
    members = stored(members.select("seq", "cls").distinct(), "members")
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    undecided = stored(members.select("seq").distinct(), "undecided")
    decided, none = None, F.lit(None).cast("bigint")
    for _ in range(max_rounds):
        if undecided.limit(1).count() == 0:
            return decided if decided is not None else members.select("seq", F.col("seq").alias("leader")).limit(0)
        waiting = stored(members.join(undecided, "seq", "left_semi"), "waiting")
        held = waiting.select("cls", F.col("seq").alias("open"), none.alias("lead"))
        if decided is not None:
            lead = decided.where(F.col("seq") == F.col("leader")).select("seq")
            held = held.unionByName(members.join(lead, "seq", "left_semi").select("cls", none.alias("open"), F.col("seq").alias("lead")))
        least = [F.min("open").alias("open"), F.min("lead").alias("lead")]
        per = held.groupBy("cls").agg(*least)
        near = both.join(per, both["b"] == per["cls"]).select(F.col("a").alias("cls"), "open", "lead")
        reach = stored(per.unionByName(near).groupBy("cls").agg(*least), "reach")
        before = lambda c: F.min(F.when(F.col(c) < F.col("seq"), F.col(c)))
        state = waiting.join(reach, "cls").groupBy("seq").agg(before("open").alias("open"), before("lead").alias("lead"))
        ready = F.col("open").isNull() | F.coalesce(F.col("lead") < F.col("open"), F.lit(False))
        settled = stored(state.where(ready).select("seq", F.coalesce("lead", "seq").alias("leader")), "settled")
        decided = settled if decided is None else stored(decided.unionByName(settled), "decided")
        undecided = stored(undecided.join(settled, "seq", "left_anti"), "undecided")
    raise RuntimeError(f"duplicates didn't settle in {max_rounds} rounds")


def merge(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per leader: its own fields, all refs and absorbed URLs sorted, the latest last_verified."""
    joined = rows.join(assigned, "seq")
    is_leader = F.col("seq") == F.col("leader")
    refs = F.concat(F.coalesce("source_refs", F.array().cast("array<string>")), F.when(is_leader, F.array().cast("array<string>")).otherwise(F.array("url")))
    parts = joined.select("leader", F.explode(refs).alias("ref")).distinct()
    all_refs = parts.groupBy("leader").agg(F.array_sort(F.collect_list("ref")).alias("_refs"))
    seen = joined.groupBy("leader").agg(F.max("last_verified").alias("_seen"), F.count("*").alias("merged_rows"))
    own = joined.where(is_leader).drop("seq")
    out = own.join(all_refs, "leader", "left").join(seen, "leader")
    return out.withColumns({"source_refs": F.coalesce("_refs", F.array().cast("array<string>")), "last_verified": F.col("_seen")}).drop("_refs", "_seen").withColumnRenamed("leader", "seq")


def deduplicate(rows: DataFrame, metres: float = METRES, ratio: float = RATIO) -> DataFrame:
    """merge() of all duplicates. rows: seq (arrival), url, city, label, latitude, longitude, source_refs, last_verified and more."""
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    keyed = rows.select("seq", F.concat(F.lit("u"), F.coalesce(U.catalogue_key(F.col("url")), F.col("seq").cast("string"))).alias("cls"))
    kinds = [("p", stored(places(rows), "places")), ("l", stored(labels(rows), "labels"))]
    members, edges = keyed, None
    for (kind, found), of in zip(kinds, (lambda m: proximity_edges(m, metres), lambda m: label_edges(m, ratio)), strict=True):
        members = members.unionByName(found.select("seq", named(kind, "cls").alias("cls")))
        part = of(found).select(named(kind, "a").alias("a"), named(kind, "b").alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    return merge(rows, leaders(members, edges))
