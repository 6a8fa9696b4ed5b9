import json
import zlib

import numpy as np
import pytest

from tessera.llm import chat as C
from tessera.llm import html as H
from tessera.llm import warc as W


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two&nbsp;<b>three</b></p></article><footer>f</footer>", ["A & B", "one two three"]),
        ("<article><p><b>x<br><p>y</p><aside>s</aside><div class='ad'>buy</div><form><p>f</p></form><ul><li>a<li>b</ul></article>", ["x", "y", "a", "b"]),
        ("<div class='ad'>never closed<article><p>z</p></article>", ["z"]),
        ("<article>t<section id='comments'><article class='comment'>c</article></section></article><div class='cookie-notice'>n</div>", ["t"]),
        ("<main><p>m</p></main><p>outside</p>", ["m", "outside"]),
        ("<div class='post-meta'>by A</div><div class='body'><p>b</p></div><div class='widget'>short</div>", ["by A", "b"]),
        (f"<div class='page-header'>{'long ' * 20}</div><div class='cookie'>{'long ' * 20}</div><p>t</p>", [("long " * 20).strip(), "t"]),
        ("<p class='ad'>a<p>b<div hidden>c</div><div style='display: none'>d</div>", ["b"]),
        ("<article><header><h1>T</h1></header><!-- <p>no</p> --><p title='a>b'>q < 3 &lt;tag&gt; &#233;</p><table><tr><td>1<td>2</table>", ["T", "q < 3 <tag> é", "1", "2"]),
        ("", []),
    ],
)
def test_blocks(body, want):
    around, article = H.main_blocks(page(body))
    assert (article or H.kept_blocks("", [t for t, _ in around], [level for _, level in around], [])) == want


def test_host_runs(spark):
    menu = "home news sport weather contact imprint privacy terms login"
    rows = [(i, "https://www.h.example/%d" % i, page(f"<div>{menu}</div><div>unique words of page number {i} are here and only here {i}</div>")) for i in range(4)]
    rows += [(10, "https://o.example/", page(f"<div>{menu}</div>")), (11, None, None), (12, "x", ""), (12, "x", ""), (None, "https://h.example/n", page(f"<article>{menu}</article>"))]
    out = {(r["page_id"], r["url"]): r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(4):
        assert out[i, rows[i][1]] == f"unique words of page number {i} are here and only here {i}"
    assert out[10, "https://o.example/"] == menu and out[11, None] == "" and out[12, "x"] == "" and out[None, "https://h.example/n"] == menu
    twice = spark.createDataFrame([(1, "http://h", rows[0][2]), (1, "http://h", rows[0][2])], "page_id bigint, url string, html string")
    assert all(r["text"].startswith("home news") for r in H.extract(twice).collect())
    assert H.extract(twice.limit(0)).count() == 0


def test_host_runs_against_all_windows(spark):
    """Pages without any telling markup, and some with an article: windows of RUN tokens that another page of the host has."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    shared = [" ".join(rng.choice(words, n)) for n in (5, 8, 9, 12, 30)]
    rows = []
    for i in range(40):
        blocks = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(4)]
        blocks += [shared[k] + " " * int(rng.integers(1, 3)) + f"x{i}" * int(rng.integers(0, 2)) for k in rng.choice(5, 2, replace=False)]
        rng.shuffle(blocks)
        body = "".join(f"<div>{b}</div>" for b in blocks)
        rows.append((i, f"http://h{i % 3}.example/{i}", page(f"<article>{i}</article>{body}" if i % 5 == 0 else body), blocks))
    seen = {}
    for i, url, _, blocks in rows:
        t = " ".join(blocks).split()
        if i % 5 == 0:
            t = t[:]
        for k in range(len(t) - H.RUN + 1):
            seen.setdefault((i % 3, *t[k : k + H.RUN]), set()).add(i)
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")).collect()}
    for i, _, _, blocks in rows:
        if i % 5 == 0:
            assert got[i] == str(i)
            continue
        t, flags = " ".join(blocks).split(), []
        flags = [False] * len(t)
        for k in range(len(t) - H.RUN + 1):
            if len(seen[i % 3, *t[k : k + H.RUN]]) > 1:
                flags[k : k + H.RUN] = [True] * H.RUN
        want, at = [], 0
        for b in blocks:
            n = len(b.split())
            if sum(flags[at : at + n]) < H.COVERED * n:
                want.append(" ".join(b.split()))
            at += n
        assert got[i] == "\n".join(want)
        assert got[i] != "\n".join(" ".join(b.split()) for b in blocks) or not any(flags)


def test_normaliser():
    records = [W.make_record(i, f"http://h/{i}", b"x y\r\n\r\n" * n, None, True) for i, n in enumerate((0, 1, 50_000, 3))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    mono = b"".join(map(packer.compress, records)) + packer.flush()
    for size in (1, 7, 1 << 18) if len(mono) < 5000 else (97, 1 << 18):
        out = []
        index = list(W.normalise([mono[i : i + size] for i in range(0, len(mono), size)], out.append))
        data = b"".join(out)
        assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == records
        assert list(W.normalise([data], [].append)) != [] and b"".join(W.inflate([data])) == b"".join(records)
    with pytest.raises(EOFError):
        list(W.normalise([mono[: len(mono) // 2]], [].append))
    assert list(W.normalise([], [].append)) == []


def test_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (2, None, None), (5, "u", ""), (7, "u", "é" * 100_000), (1, "http://b\r\nX: y", "same"), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    out = W.round_trip(df).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out), key=str)
    digest = {t: W.digest_of((t or "").encode()) for _, _, t in rows}
    want = [(3, "revisit", 1, 4, digest["same"]), (1, "response", None, 4, digest["same"]), (1, "response", None, 4, digest["same"]), (2, "response", None, 0, digest[""]), (5, "revisit", 2, 0, digest[""]),
            (7, "response", None, 200_000, digest["é" * 100_000]), (None, "revisit", 1, 4, digest["same"]), (None, "response", None, 5, digest["alone"])]
    assert got == sorted(want, key=str)
    assert {bytes(r["payload"]) for r in out if r["page_id"] == 7} == {("é" * 100_000).encode()} and {r["url"] for r in out if r["page_id"] == 1} == {"http://b%0D%0AX: y"}
    assert W.round_trip(df.limit(0)).count() == 0


CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"


def test_linking(spark):
    calls = spark.createDataFrame(
        [(1, "a", 5, "get", '{"n": 1, "city":"Rome"}', ["b"]), (1, "b", 9, "get", '{"city":"Oslo"}', None), (1, "b", 9, "get", '{"city":"Oslo"}', None), (1, "c", 10, "get", "[1]", ["a", "b"]),
         (2, "x", 1, "get", '{"city": 3, "z": 1, "n": null}', ["y"]), (2, "y", 2, "none", "{}", ["x"]), (2, "w", 3, "get", '{"city":"q","city":"r"}', ["unknown"]), (3, "a", 1, "get", None, None), (None, "a", 1, "get", "{}", None)],
        CALLS,
    )
    results = spark.createDataFrame([(1, "a", 6, 'say "hi"\n'), (1, "a", 8, "later"), (1, "zz", 7, None), (4, "a", 1, "o")], RESULTS)
    schemas = spark.createDataFrame([("get", "city", "STRING", True), ("get", "n", "DOUBLE", False)], "name string, field string, type string, required boolean")
    out = {(r["conv_id"], r["call_id"]): r for r in C.link_calls(calls, results, schemas).collect()}
    assert {k: (r["status"], r["level"], r["valid"]) for k, r in out.items()} == {
        (1, "a"): ("linked", 1, True), (1, "b"): ("unanswered", 0, True), (1, "c"): ("unanswered", 2, False), (1, "zz"): ("orphan_result", None, False),
        (2, "x"): ("unanswered", None, False), (2, "y"): ("unanswered", None, False), (2, "w"): ("unanswered", 0, False), (3, "a"): ("unanswered", 0, False), (4, "a"): ("orphan_result", None, False),
    }
    assert out[2, "x"]["errors"] == ["type:city", "unknown:z"] and out[2, "y"]["errors"] == ["no_schema"] and out[1, "c"]["errors"] == ["not_an_object"]
    assert out[1, "a"]["message"] == '{"call":{"arguments":{"city":"Rome","n":1},"id":"a","name":"get"},"result":{"content":"say \\"hi\\"\\n","id":"a"}}'
    assert json.loads(out[1, "zz"]["message"]) == {"call": None, "result": {"content": None, "id": "zz"}} and out[1, "a"]["result_turn"] == 6
    assert C.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (1, 3, "user", None), (2, 0, "assistant", "o"), (None, 0, "user", "x"), (3, 0, None, "n"), (1, 1, "user", "q")]
    out = C.format_conversations(spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, name string"))
    got = sorted((r["conv_id"], r["call_id"], r["status"], r["valid"]) for r in out.collect())
    assert got == [(1, "call-1", "linked", True), (1, "call-3", "unanswered", False), (2, "call--1", "orphan_result", False)]


def test_levels_of_deep_chains(spark, monkeypatch):
    """Calls that each need the next one, against the turns: the level is the depth; what needs a cycle has none."""
    monkeypatch.setattr(C, "ROUNDS", 4)
    n = 11
    rows = [("c", f"k{i}", i, "f", "{}", [f"k{i + 1}"]) for i in range(n)] + [("c", f"k{n}", n, "f", "{}", ["unknown"]), ("c", "a", 90, "f", "{}", ["b"]), ("c", "b", 91, "f", "{}", ["a"]), ("c", "d", 92, "f", "{}", ["a", "k0"])]
    df = spark.createDataFrame(rows, "conv_id string, call_id string, turn int, name string, arguments string, after array<string>").coalesce(1)
    got = {r["call_id"]: r["level"] for r in C.order_levels(df).collect()}
    assert got == {**{f"k{i}": n - i for i in range(n + 1)}, "a": None, "b": None, "d": None}


def test_archives_end_at_their_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 400 if i % 3 else f"<p>{i}</p>") for i in range(60)], "page_id bigint, url string, html string").coalesce(2)
    folder = f"file://{tmp_path}"
    written = W.write_archives(W.mark_revisits(pages), folder, archive_bytes=2000)
    assert written.count() > 4
    rows = {r["page_id"]: r for r in W.read_archives(W.normalise_archives(written, folder), folder).collect()}
    assert len(rows) == 60 and all(rows[i]["record_type"] == ("response" if i % 3 == 0 or i == 1 else "revisit") and rows[i]["refers_to"] == (None if i % 3 == 0 or i == 1 else 1) for i in rows)
