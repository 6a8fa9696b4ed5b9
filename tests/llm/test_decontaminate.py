import random

import pytest

from tessera.llm import decontaminate as D


def brute(docs, items):
    out = set()
    for i, text in items:
        want = D.shingles_of(text)
        for d, doc in docs:
            own = D.shingles_of(doc)
            if d is not None and want and len(want & own) >= 0.8 * len(want) - 1e-9:
                out.add((d, i, len(want), len(want & own)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_like_brute_force(spark, limit):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 17, 40])))) for i in range(40)] + [(90, ""), (91, None), (92, "?!"), (0, "other text of the same id here now")]
    docs = []
    for d in range(60):
        inside = rng.choice(items)[1] or ""
        mangled = " ".join(w if rng.random() > 0.03 else "zz" for w in inside.split())
        docs.append((d, " ".join(rng.choice(words) for _ in range(rng.randrange(300))) + ". " + mangled.title() + ", " + rng.choice(words)))
    docs += [(7, docs[7][1]), (None, items[5][1]), (70, None), (71, ""), (72, "one two")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.contaminated(d, i, broadcast_bytes=limit).collect()
    got = {tuple(r)[:4] for r in rows}
    assert len(rows) == len(got) and got == brute(docs, items) and len(got) > 20


def test_edges(spark, edge):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon alpha"), (2, "Hund")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(edge, items).collect()} == {(5, 1), (6, 1)}
    kept = D.drop_contaminated(edge, items)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 7, 8]
    assert D.contaminated(edge.limit(0), items).count() == 0 and D.contaminated(edge, items.limit(0)).count() == 0
    assert D.drop_contaminated(edge, items.limit(0)).count() == edge.count()


def test_sketches_cover_the_class():
    for q in range(1, 300):
        gaps = q - -(-q * 8 // 10)
        assert D.sketch_size(q, 0.8) >= min(q, gaps + 1)
