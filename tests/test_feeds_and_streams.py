import json

from pyspark.sql import functions as F

from feedloom.sources import feeds
from feedloom.streaming import events


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": 1, "url": "http://a", "title": "A &amp; B", "time": 0}\n{"id": 2, "title": "no url", "time": 5}\n')
    assert [(r.url, r.title) for r in feeds.stories(spark, str(tmp_path / "s.json")).collect()] == [("http://a", "A & B")]
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"id": i, "url": f"u{i}", "title": "t", "content": "<p>x</p>", "published_at": f"2024-01-0{i}T00:00:00Z"} for i in (1, 2, 3)]}))
    assert [r.url for r in feeds.reader_entries(spark, str(tmp_path / "r.json"), 2).collect()] == ["u3", "u2"]
    (tmp_path / "q.json").write_text(json.dumps({"topic": "T", "results": [{"url": f"https://x/{i}", "title": "t", "content": "c"} for i in range(30)] + [{"url": "ftp://x"}]}))
    assert feeds.search_results(spark, str(tmp_path / "q.json")).count() == 20
    item = "<item><title>N &lt;b&gt;ew</title><link>http://n</link><description>d</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>"
    old = item.replace("02 Jan 2024", "02 Jan 2020").replace("http://n", "http://o")
    (tmp_path / "f.xml").write_text(f"<rss><channel>{item}{old}</channel></rss>")
    assert [r.url for r in feeds.rss_entries(spark, str(tmp_path / "f.xml"), "2024-01-01").collect()] == ["http://n"]


def test_opml_discovery_and_atom(spark):
    opml = '<outline xmlUrl="http://a/f"/><outline xmlUrl="http://a/f"/><outline xmlUrl="https://b"/>'
    page = '<link rel="alternate" type="application/rss+xml" href="/rss"><link rel="icon" href="/i">'
    row = spark.createDataFrame([(opml, page)], "o string, p string").select(feeds.opml_feeds("o").alias("o"), feeds.discovered_feeds("p").alias("p")).first()
    assert (row.o, row.p) == (["http://a/f", "https://b"], ["/rss"])
    entry = feeds.as_atom(spark.createDataFrame([("http://x?a&b", "T<", None)], "url string, title string, summary string")).first().entry
    assert entry == '<entry><title>T&lt;</title><link href="http://x?a&amp;b"/><summary></summary></entry>'


def test_latest_votes_as_a_stream(spark, tmp_path):
    schema = "id long, key string, value string"
    for part, rows in enumerate([[(1, "a", "up"), (2, "b", "up")], [(3, "a", "down")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        events.run_once(stream, events.keep_latest(str(tmp_path / "out"), ["key"]), str(tmp_path / "ck"))
    assert {(r.key, r.value) for r in events.newest(spark, str(tmp_path / "out")).collect()} == {("a", "down"), ("b", "up")}
    spark.createDataFrame([(4, "b", "down")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    events.run_once(stream, events.keep_latest(str(tmp_path / "out"), ["key"]), str(tmp_path / "ck"))
    left = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert left == ["snapshot=0-1", "snapshot=0-2"]
    fresh = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))  # a new checkpoint reads all again
    events.run_once(fresh, events.keep_latest(str(tmp_path / "out"), ["key"], run="1"), str(tmp_path / "ck2"))
    assert {(r.key, r.value) for r in events.newest(spark, str(tmp_path / "out"), "1").collect()} == {("a", "down"), ("b", "down")}


def test_debounce_and_once_per_key_in_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:05:00"), (3, "a", "2024-01-01 01:00:00"), (4, "z", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "id long, key string, t string").select("id", "key", F.to_timestamp("t").alias("created_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, step in (("runs", lambda s: events.debounced(s, "key")), ("once", lambda s: events.once_per_key(s, "key"))):
        stream = step(spark.readStream.schema("id long, key string, created_at timestamp").parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.key, r.changes) for r in spark.table("runs").collect()) == [("a", 1), ("a", 2)]
    assert sorted(r.key for r in spark.table("once").collect()) == ["a", "z"]
