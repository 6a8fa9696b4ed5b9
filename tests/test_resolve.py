"""Entity resolution against the sequential greedy loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import resolve as R


def ratio(a, b):
    """By the textbook table."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_ratio(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(12))), "".join(rng.choice("abc ") for _ in range(rng.randrange(12)))) for _ in range(200)]
    pairs += [("times square north", "times sq. north"), ("abc", "xyz"), ("", "")]
    for a, b in pairs:
        assert math.isclose(X.indel_ratio(a, b), ratio(a, b)), (a, b)
    df = spark.createDataFrame([("ab", "ab"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(X.similarity(F.col("a"), F.col("b"))).collect()] == [100.0, None]


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def matches(a, b):
    """a, b: (seq, key, city, label, lat, lon)."""
    if a[1] == b[1]:
        return True
    if a[2].lower() != b[2].lower():
        return False
    if None not in (a[4], a[5], b[4], b[5]) and metres(a[4:6], b[4:6]) <= 50:
        return True
    known = a[2].strip().lower() not in ("unknown", "")
    named = a[3].strip().lower() not in R.GENERIC_LABELS and b[3].strip().lower() not in R.GENERIC_LABELS
    return known and named and ratio(a[3].lower(), b[3].lower()) > 85


@pytest.mark.parametrize("seed", [1, 2])
def test_like_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        label = rng.choice(["Times Square North", "Times Square South", "Harbour view", "live", "Old bridge east", "Old bridge west"]) + rng.choice(["", "1", " x"])
        lat = rng.choice([None, 85.0, 10.0]) if rng.random() < 0.5 else rng.uniform(0, 0.002)
        rows.append((i, f"https://h{rng.randrange(40)}.example/a.m3u8", rng.choice(["Rome", "rome", "Oslo", "Unknown"]), label, lat, None if lat is None else rng.uniform(0, 0.004)))
    leaders, want = [], {}
    for r in rows:
        hit = next((x for x in leaders if matches(x, r)), None)
        want[r[0]] = hit[0] if hit else r[0]
        if hit is None:
            leaders.append(r)
    df = spark.createDataFrame(rows, "seq long, url string, city string, label string, latitude double, longitude double")
    df = df.withColumns({"source_refs": F.array(F.lit("r")), "last_verified": F.format_string("2026-%03d", F.col("seq"))})
    merged = {r["seq"]: r for r in R.deduplicate(df).collect()}
    assert sorted(merged) == sorted(set(want.values()))
    for lead, r in merged.items():
        group = [s for s, x in want.items() if x == lead]
        assert r["merged_rows"] == len(group) and r["last_verified"] == f"2026-{max(group):03d}"
        assert r["source_refs"] == sorted({"r"} | {rows[s][1] for s in group if s != lead})


def test_chain_is_not_passed_on(spark):
    """A matches B, B matches C, A doesn't match C: C leads."""
    step = 40 / 111_195
    df = spark.createDataFrame([(i, f"https://h{i}.example", "Rome", x, i * step, 0.0, ["r"], "x") for i, x in enumerate(["alpha", "bravo", "candy"])], "seq long, url string, city string, label string, latitude double, longitude double, source_refs array<string>, last_verified string")
    assert sorted((r["seq"], r["merged_rows"]) for r in R.deduplicate(df).collect()) == [(0, 2), (2, 1)]
    assert R.deduplicate(df.limit(0)).count() == 0


def test_queries_take_whole_labels(spark, tmp_path):
    """Titles of one host with the same 24 characters at the start are told apart; alike ones with other openings meet."""
    from tessera import queries as Q

    opening = "Traffic cameras of the city: "
    titles = [opening + "harbour, quay and old bridge", opening + "mountain pass X951", "A view: quay, old bridge, tower and the long market", "B view: quay, old bridge, tower and the long market", opening + "mountain pass X951", ""]
    rows = [(4 * i + 1, f"http://h.example/p{i}", f"<html><TITLE lang='en'>{t}</TITLE><p>x</p></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {(4 * i + 1, 4 * j + 1) for j in range(6) for i in range(j) if ratio(titles[i].lower(), titles[j].lower()) > 85}
    assert want == {(5, 17), (9, 13)}
    near = {(r["seq"], r["cls"], r["n_links"]) for r in Q.QUERIES["j21_similar_labels"](spark, str(tmp_path)).collect()}
    assert near == {(1, 1, 0), (5, 5, 1), (9, 9, 1), (13, 13, 1), (17, 5, 1), (21, 21, 0)}
    assert {(r["seq"], r["merged_rows"]) for r in Q.QUERIES["d1_entity_resolution"](spark, str(tmp_path)).collect()} == {(1, 1), (5, 2), (9, 2), (21, 1)}


def test_neighbours_on_any_part_of_the_globe(spark):
    """Random places, many of them at the 180th meridian and the poles, against all pairs."""
    rng = random.Random(5)
    spots = [(0.0, 0.0), (12.0, 180.0), (-45.0, -180.0), (90.0, 20.0), (-90.0, 0.0), (89.9995, -120.0), (51.5, -0.1)]
    rows = []
    for i in range(600):
        lat, lon = rng.choice(spots)
        lat, lon = lat + rng.uniform(-0.002, 0.002), lon + rng.uniform(-0.002, 0.002) * (1 if abs(lat) < 80 else 60_000)
        rows.append((i, rng.choice("ab"), max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180))
    rows += [(600, "a", 10.0, 179.99999), (601, "a", 10.0, -179.99999), (602, "a", 89.9999, 0.0), (603, "a", 89.9999, 180.0), (604, "a", 10.0, 180.0), (605, "a", 10.0, -180.0)]
    df = spark.createDataFrame(rows, "seq long, city string, latitude double, longitude double")
    for reach in (50.0, 300.0, 3e7):
        some = rows if reach < 1e6 else rows[::6]
        want = {(a[0], b[0]) for a in some for b in some if a[0] < b[0] and a[1] == b[1] and metres(a[2:], b[2:]) <= reach}
        got = [tuple(r) for r in R.proximity_edges(R.places(df.where(F.col("seq").isin([r[0] for r in some]))), reach).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert {(600, 601), (602, 603)} <= {tuple(r) for r in R.proximity_edges(R.places(df)).collect()}


def alike_pairs(labels, ratio=85):
    """All pairs above the ratio: counts of letters rule out most in numpy, the textbook table settles the rest."""
    letters = sorted(set("".join(labels)))
    counts = np.array([[x.count(c) for c in letters] for x in labels], np.int16).T.copy()
    sizes, out = counts.sum(axis=0), set()
    order = np.argsort(sizes, kind="stable")
    counts, sizes = counts[:, order], sizes[order]
    for at in range(len(labels)):
        stop = np.searchsorted(sizes, sizes[at] * 1.36 + 1)
        if stop <= at + 1:
            continue
        shared = np.zeros(stop - at - 1, np.int32)
        for row in counts:
            if row[at]:
                shared += np.minimum(row[at], row[at + 1 : stop])
        for k in np.flatnonzero(200 * shared > ratio * (sizes[at] + sizes[at + 1 : stop])):
            i, j = int(order[at]), int(order[at + 1 + k])
            if X.indel_ratio(labels[i], labels[j]) > ratio:
                out.add((min(i, j), max(i, j)))
    return out


def edges_of(spark, labels):
    d = spark.createDataFrame(list(enumerate(labels)), "seq long, label string").withColumn("city", F.lit("Rome"))
    members = R.labels(d)
    return members, R.label_edges(members)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aé🙂ß ", "abcdefghijklmnopqrstuvwxyz -"])
def test_alike_labels_equal_all_pairs(spark, alphabet):
    """Labels of 1 to 70 letters, changed copies among them; equal lengths, other lengths, long with short."""
    rng = random.Random(len(alphabet))
    labels = {"".join(rng.choice(alphabet) for _ in range(rng.choice([*range(1, 30), 46, 47, 48, 49, 50, 60]))) for _ in range(120)}
    for x in sorted(labels):
        for _ in range(3):
            y = list(x)
            for _ in range(rng.randrange(1, 2 + len(x) // 5)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.choice([0, 0, 1, 1, 2])] = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet)])
            labels.add("".join(y))
    labels = [x for x in sorted(labels) if x.strip() and x.strip() not in R.GENERIC_LABELS]
    want = {(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels)) if X.indel_ratio(labels[i], labels[j]) > 85}
    got = [tuple(r) for r in edges_of(spark, labels)[1].collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_one_city_of_50_000_labels(spark):
    """Every alike pair is found, while few of the 1.25 billion pairs are compared and no join is by city alone."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    labels = dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randrange(2, 5))) for _ in range(48_500))
    for x in list(labels)[:1800]:
        at = rng.randrange(len(x))
        labels[x[:at] + rng.choice(["", "x", "yz"]) + x[at + 1 :]] = None
    labels = list(labels)[:50_000]
    members, edges = edges_of(spark, labels)
    assert members.count() == 50_000
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == alike_pairs(labels) and len(got) > 1000
    classes = R.stored(members.select("cls", "city", "label", F.length("label").alias("n"), R.letter_bits(F.col("label")).alias("bits")), "labels")
    compared = R._by_segments(classes, R.RATIO)
    joins = [line for line in compared._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("(segment#" in line and "(d#" in line and "(city#" in line for line in joins)
    n = compared.count() + R._by_length(classes, R.RATIO).count()
    print(f"{n} of {50_000 * 49_999 // 2} pairs compared")
    assert n < 50_000 * 49_999 / 2 / 1000


def test_few_long_labels_are_compared(spark):
    """Labels of 60 letters of one language meet by length; their letters' bits leave few of the pairs, and those that are alike."""
    rng = random.Random(6)
    parts = ["the", "er", "in", "th", "an", "ou", "ea", "st", "on", "re", "ly", "sh", " ", " ", "tion"]
    labels = ["".join(rng.choice(parts) for _ in range(40))[:60].replace("  ", "a ") for _ in range(600)]
    labels += [x[:20] + "xyz" + x[23:] for x in labels[:20]]
    members, edges = edges_of(spark, labels)
    classes = members.where("cls = seq").select("cls", "city", "label", F.length("label").alias("n"), R.letter_bits(F.col("label")).alias("bits"))
    got = {tuple(r) for r in edges.collect()}
    assert {(i, 600 + i) for i in range(20)} <= got and got == alike_pairs(labels)
    few = R._by_length(classes, R.RATIO).count()
    print(f"{few} of {620 * 619 // 2} pairs compared")
    assert few < 0.25 * 620 * 619 / 2
