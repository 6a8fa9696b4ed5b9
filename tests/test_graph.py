"""Link graph against a breadth-first search."""

import random

from tessera import queries as Q
from tessera.operators import graph as G


def search(roots, links, max_depth=5, max_pages=250):
    out = {}
    for root in roots:
        found, level = {root: (0, None)}, [root]
        for depth in range(1, max_depth + 1):
            fresh = {}
            for page in sorted(level):
                for link in links.get(page, ()):
                    if link not in found:
                        fresh.setdefault(link, page)
            found |= {link: (depth, page) for link, page in fresh.items()}
            level = list(fresh)
        for url, (depth, parent) in sorted(found.items(), key=lambda x: (x[1][0], x[0]))[:max_pages]:
            out[root, url] = (depth, parent)
    return out


def test_every_page_is_a_root(spark, tmp_path):
    rng = random.Random(3)
    links = {f"http://h{h}.example/p{i}": {f"http://h{h}.example/p{rng.randrange(14)}" for _ in range(rng.randrange(3))} for h in range(12) for i in range(12)}
    links |= {f"http://chain.example/c{i:02}": {f"http://chain.example/c{i + 1:02}"} for i in range(9)}
    html = [(url, "".join(f"<a href='{x}'>x</a>" for x in sorted(to)) + "<a href='http://other.example/'>o</a>") for url, to in links.items()]
    spark.createDataFrame(html, "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["root"], r["url"]): (r["depth"], r["parent"]) for r in Q.QUERIES["g1_link_graph"](spark, str(tmp_path)).collect()}
    assert got == search(links, links)


def test_page_limit(spark):
    rng = random.Random(4)
    links = {f"http://h.example/p{i:02}": {f"http://h.example/p{rng.randrange(30):02}" for _ in range(3)} for i in range(25)}
    rows = spark.createDataFrame([(a, b) for a, to in links.items() for b in to], "page string, link string")
    roots = spark.createDataFrame([(u,) for u in links], "url string")
    for most in (1, 4, 9):
        got = {(r["root"], r["url"]): (r["depth"], r["parent"]) for r in G.expand(roots, rows, max_pages=most).collect()}
        assert got == search(links, links, max_pages=most)
