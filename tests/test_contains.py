"""Terms in texts against Python's `in`, with one list and with many, and what the plan looks like."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import contains as C
from tessera.operators import gates as G
from tessera.operators import reports as R


def some(rng, n, letters="abc "):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("most", [1000, 7, 1])
def test_containing_equals_a_loop(spark, most):
    rng = random.Random(3)
    texts = [(i, some(rng, rng.randrange(14), "abcé🙂 "), i % 5) for i in range(200)] + [(200, None, 0), (201, "", 0)]
    terms = [(some(rng, rng.randrange(6), "abcé🙂 "), i) for i in range(60)] + [("", -1), (None, -2), ("ab", -3), ("ab", -4)]
    a, b = spark.createDataFrame(texts, "i int, t string, u int"), spark.createDataFrame(terms, "w string, k int")
    got = sorted(tuple(r) for r in C.containing(a, "t", b, "w", most).collect())
    assert got == sorted((*x, *y) for x in texts for y in terms if x[1] and y[0] and y[0] in x[1]) and got
    assert C.containing(a, "t", b.limit(0), "w").collect() == [] and C.containing(a.limit(0), "t", b, "w").collect() == []


@pytest.mark.parametrize("most", [1000, 2])
def test_rules_equal_a_loop(spark, most):
    rng = random.Random(4)
    rows = [(i, some(rng, rng.randrange(12)), rng.choice([None, some(rng, 8)])) for i in range(150)]
    rules = [(rng.choice([None, "t", "u", "other"]), some(rng, rng.randrange(6), "abcC-! ")) for _ in range(9)]
    normal = lambda x: " ".join("".join(c if c.isalnum() else " " for c in (x or "").lower()).split())
    blocked = lambda r: any(normal(w) and normal(w) in normal(v) for f, w in rules for k, v in zip("tu", r[1:], strict=True) if f in (None, k))
    d = spark.createDataFrame(rows, "i int, t string, u string")
    got = G.without_rules(d, spark.createDataFrame(rules, "field string, term string"), ["t", "u"], most)
    assert sorted(r["i"] for r in got.collect()) == [r[0] for r in rows if not blocked(r)] and 0 < got.count() < 150
    assert G.without_rules(d, spark.createDataFrame([], "field string, term string"), ["t", "u"]).count() == 150


def test_no_row_meets_every_term(spark):
    """However many terms: texts aren't multiplied or shuffled, and nothing is compared in a nested loop."""
    texts = spark.range(50).select(F.col("id").alias("i"), F.concat(F.lit("text "), F.col("id")).alias("t"))
    terms = spark.range(30_000).select(F.concat(F.lit("text "), F.col("id")).alias("term"), F.lit(None).cast("string").alias("field"))
    for out in (C.containing(texts, "t", terms.drop("field"), "term"), G.without_rules(texts, terms, ["t"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "ArrowEvalPython" in plan
    assert C.containing(texts, "t", terms.drop("field"), "term").count() == 50 + 40  # "text 1" is in "text 10" to "text 19" too
    metrics = spark.createDataFrame([("pages.x", "3"), ("a.cap", "9")], "metric string, value string")
    caps = spark.createDataFrame([("p", 2.0, "PAGES"), ("q", 9.0, "cap")], "cap_name string, cap_value double, hint string")
    assert [(r["metric"], r["cap_name"]) for r in R.cap_audit(metrics, caps).collect()] == [("pages.x", "p")]


def test_long_lists_of_a_request(spark):
    words = [f"w{i}" for i in range(100)] + ["W3", "", None]
    d = spark.createDataFrame([("a w12 b",), ("none",), (None,), ("",)], "t string")
    got = [r[0] for r in d.select(G.term_hits(F.col("t"), words)).collect()]
    assert got[0] == ["w1", "w2", "w12"][:1] + ["w12"] and got[1:] == [[], [], []]
    few = [r[0] for r in d.select(G.term_hits(F.col("t"), words[:20])).collect()]
    assert few[0] == got[0]
