from tessera.operators import extract


def test_the_list_of_variants_is_worked_out_once(spark):
    """No filter on the list's size repeats it; playlists without entries give no rows."""
    body = "#EXTM3U\n#EXT-X-STREAM-INF:B=1\nlow.m3u8\n#EXT-X-STREAM-INF:B=1\n\n#x\n/hi.m3u8\n#EXT-X-STREAM-INF:B=1\n/hi.m3u8\nstray.m3u8"
    rows = [("https://p.example/a/m.m3u8", body), ("https://p.example/b", "#EXTM3U\nx.ts"), ("https://p.example/c", None), ("https://p.example/d", "#EXT-X-STREAM-INF:B=1")]
    out = extract.playlist_variants(spark.createDataFrame(rows, "url string, body string"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(rows[0][0], 0, "https://p.example/a/low.m3u8"), (rows[0][0], 1, "https://p.example/hi.m3u8")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1
