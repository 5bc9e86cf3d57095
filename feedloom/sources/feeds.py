"""Sources and sinks of feeds: fetched JSON and XML in, JSON, Atom and Markdown out."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from feedloom.functions import html, url

#: Entries taken of a feed and of a search, characters of a snippet.
FEED_ENTRIES, SEARCH_RESULTS, SNIPPET, MOST_BYTES = 20, 20, 500, 2 << 20
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")
USUAL_PATHS = ("/feed", "/rss", "/feed.xml", "/rss.xml", "/atom.xml", "/index.xml")
STORY = "id long, url string, title string, time long"
READER = "entries array<struct<id:long,url:string,title:string,content:string,published_at:string>>"
SEARCH = "topic string, results array<struct<url:string,title:string,content:string>>"


def _first(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("n") <= n).drop("n")


def stories(spark: SparkSession, path: str) -> DataFrame:
    """Stories of a discussion site, one JSON object a line; those without URL are skipped."""
    rows = spark.read.schema(STORY).json(path).filter("url IS NOT NULL")
    return rows.select("url", html.strip_html(F.col("title")).alias("title"), F.timestamp_seconds("time").alias("published_at"), F.lit("hackernews").alias("source"))


def reader_entries(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Unread entries of a feed reader's answer, newest first."""
    rows = spark.read.schema(READER).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    rows = rows.orderBy(F.desc("published_at"), "id").limit(limit)
    snippet = F.substring(html.strip_html(F.col("content")), 1, SNIPPET)
    return rows.select("url", html.strip_html(F.col("title")).alias("title"), snippet.alias("snippet"), html.first_image(F.col("content")).alias("image_url"), F.to_timestamp("published_at").alias("published_at"), F.lit("miniflux").alias("source"))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """The first results of a search for each topic, one answer a line."""
    rows = spark.read.schema(SEARCH).json(path).select("topic", F.posexplode("results").alias("pos", "r"))
    rows = _first(rows.filter(F.rlike("r.url", F.lit("^https?://"))), "topic", "pos", SEARCH_RESULTS)
    return rows.select("topic", "r.url", html.strip_html(F.col("r.title")).alias("title"), F.substring(html.strip_html(F.col("r.content")), 1, SNIPPET).alias("snippet"), F.lit("searxng").alias("source"))


def _local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _text(node) -> str:
    """An element's text; of markup within it the markup."""
    inner = "".join(ElementTree.tostring(c, encoding="unicode") for c in node)
    return (node.text or "") + inner


def _entries(content: bytes) -> Iterator[dict]:
    """The raw entries of a feed of either kind, in order, as far as it can be read: a feed that was cut off gives those that are whole."""
    parser = ElementTree.XMLPullParser(("end",))
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", content[:MOST_BYTES], re.I):
        return  # declared entities can grow without bound
    try:
        parser.feed(content[:MOST_BYTES])
    except ElementTree.ParseError:
        pass
    with contextlib.suppress(ElementTree.ParseError):
        for _, node in parser.read_events():
            if _local(node.tag) in ("item", "entry"):
                yield _entry(node)


def _entry(node) -> dict:
    out: dict = {"links": [], "media": [], "enclosures": []}
    for child in node.iter():
        if child is node:
            continue
        name, space = _local(child.tag), child.tag.rpartition("}")[0] if isinstance(child.tag, str) else ""
        if name in ("content", "thumbnail") and "search.yahoo.com/mrss" in space:
            out["media"].append((name != "content", child.get("url")))
        elif name == "enclosure":
            out["enclosures"].append((child.get("type"), child.get("url")))
        elif name == "link":
            if child.get("href"):
                rel = child.get("rel") or "alternate"
                (out["enclosures"] if rel == "enclosure" else out["links"]).append((child.get("type") if rel == "enclosure" else rel, child.get("href")))
            elif child.text:
                out["links"].append(("alternate", child.text.strip()))
        elif name in ("title", "summary", "description", "encoded", "content", "pubdate", "published", "updated", "date", "guid", "id"):
            out.setdefault(name, _text(child))
    media = [u for _, u in sorted(out["media"], key=lambda m: m[0])]
    return {
        "url": next((u for rel, u in out["links"] if rel == "alternate"), None),
        "title": out.get("title"),
        "summary": out.get("summary", out.get("description")),
        "content": out.get("encoded", out.get("content")),
        "published": next((out[k] for k in ("pubdate", "published", "date", "updated") if k in out), None),
        "media": [u for u in media if u],
        "enclosures": [u for kind, u in out["enclosures"] if u and "image" in (kind or "")],
    }


_RAW = T.StructType(
    [T.StructField("feed", T.StringType()), T.StructField("pos", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("url", "title", "summary", "content", "published")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("media", "enclosures")]
)


def _raw_entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [{"feed": f, "pos": i} | e for f, c in zip(part["feed"], part["content"], strict=True) for i, e in enumerate(islice(_entries(bytes(c or b"")), FEED_ENTRIES))]
        yield pd.DataFrame(rows, columns=_RAW.names)


def feed_entries(feeds: DataFrame, since: Column) -> DataFrame:
    """Entries of RSS and Atom feeds: feed, url, title, snippet, image_url, published_at, source. feeds: feed, content (bytes).

    The first FEED_ENTRIES of the first MOST_BYTES of each; those with an http(s) address, none published before `since`.
    The text is the content where there is one, else the summary. The image is the first of media, then thumbnails, then
    an enclosed one, then the text's first."""
    rows = feeds.select("feed", "content").mapInPandas(_raw_entries, _RAW).filter(F.rlike("url", F.lit("^https?://")))
    named = F.try_to_timestamp(F.regexp_replace(F.trim("published"), r"^[A-Za-z]+,\s*|\s*(?:GMT|UTC?|Z|[+]0000)$", ""), F.lit("d MMM yyyy HH:mm[:ss]"))
    zoned = F.try_to_timestamp(F.regexp_replace(F.trim("published"), r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm[:ss] XX"))
    iso = F.try_to_timestamp(F.trim("published"))
    rows = rows.withColumn("published_at", F.coalesce(zoned, named, iso)).filter(F.col("published_at").isNull() | (F.col("published_at") >= since))
    body = F.coalesce(F.nullif("content", F.lit("")), "summary")
    media = F.get(F.filter("media", lambda u: F.rlike(u, F.lit("^https?://"))), F.lit(0))
    image = F.coalesce(media, F.get("enclosures", F.lit(0)), html.first_image(body))
    return rows.select(
        "feed", "pos", "url", html.strip_html(F.col("title")).alias("title"), F.substring(html.strip_html(body), 1, SNIPPET).alias("snippet"), image.alias("image_url"), "published_at", F.lit("rss").alias("source")
    )


def rss_entries(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Entries of the feeds in a folder of fetched files; a feed is its file. Any store that Spark reads will do."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("feed"), "content")
    return feed_entries(files, F.lit(since).cast("timestamp"))


def opml_feeds(text: str) -> Column:
    """Feed addresses in an OPML text column, each once, in any quotes and case, entities decoded."""
    found = F.regexp_extract_all(text, F.lit("(?is)<outline\\b[^>]*?\\sxmlUrl\\s*=\\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.trim(html.decode(F.substring(u, F.lit(2), F.length(u) - 2)))), lambda u: F.rlike(u, F.lit("(?i)^https?://"))))


def discovered_feeds(page: str, base: Column | None = None) -> Column:
    """Alternate links of the feed types in a page, in order, in any quotes and case; with the page's address, as they are meant on it."""
    links = F.regexp_extract_all(F.substring(F.coalesce(page, F.lit("")), 1, 300_000), F.lit("(?is)(<link\\b[^>]*>)"), F.lit(1))

    def attribute(tag: Column, name: str) -> Column:
        value = F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*')", 1)
        return html.decode(F.substring(value, F.lit(2), F.length(value) - 2))

    fit = F.filter(links, lambda x: F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), "alternate") & F.lower(attribute(x, "type")).isin(*FEED_TYPES))
    found = F.transform(fit, lambda x: F.trim(attribute(x, "href")))
    return F.filter(found if base is None else F.transform(found, lambda u: url.joined(u, base)), lambda u: u.isNotNull() & (u != ""))


def looks_like_feed(content: Column) -> Column:
    return F.rlike(F.lower(F.decode(F.substring(content, 1, 1000), "ISO-8859-1")), F.lit("<rss|<feed|<rdf:rdf"))


def discover(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """site, feed: what each site's page names, else the first of the usual paths at which a feed was fetched; null where there is none.

    sites: site (its address), page (html, null if it could not be fetched); fetched: url, content, of those paths that answered."""
    root = F.regexp_extract("site", r"(?i)^(https?://[^/?#]+)", 1)
    named = sites.select("site", "page", F.get(discovered_feeds("page", F.col("site")), F.lit(0)).alias("named"), root.alias("root"))
    tried = named.filter("named IS NULL AND page IS NOT NULL").select("site", F.posexplode(F.transform(F.array(*map(F.lit, USUAL_PATHS)), lambda p: F.concat("root", p))).alias("place", "url"))
    usual = tried.join(fetched.filter(looks_like_feed(F.col("content"))).select("url").distinct(), "url").groupBy("site").agg(F.min_by("url", "place").alias("usual"))
    return named.join(usual, "site", "left").select("site", F.coalesce("named", "usual").alias("feed"))


def as_atom(items: DataFrame) -> DataFrame:
    """url, title, summary -> one Atom entry per row."""

    def safe(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    parts = [F.lit("<entry><title>"), safe("title"), F.lit('</title><link href="'), safe("url"), F.lit('"/><summary>'), safe("summary"), F.lit("</summary></entry>")]
    return items.select("url", F.concat(*parts).alias("entry"))


def publish(items: DataFrame, path: str, cycle: str) -> None:
    """The feed of a cycle, as a partition of its own that a second run replaces."""
    items.write.mode("overwrite").json(f"{path}/cycle_ts={cycle}")
