"""The readable part of pages: blocks scored by their words, links and neighbours, rebuilt from lists of what may stay.

A page is cut into tags and texts, which become rows; running sums over a page's rows tell
what lies in a link, a list, a figure or a part that goes round the article, and number
its blocks. All of it is windows and aggregates by page, so no page is parsed by Python and
none is held but as its own rows.

Defined results: null and empty pages, and those without enough sentences, have no
blocks; tags without an end count to the end of the page, or to the next article or main
element where they go round it; equal rows of one page id are read as one page each if
`page` tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions.html import decode
from feedloom.functions.plain_text import escaped, is_plain_text, once, paragraphs, plain_html
from feedloom.functions.text import LEAST_CHARS, LEAST_SENTENCES, MOST_WORDS, SENTENCE_END
from feedloom.functions.url import joined

#: Elements whose texts are not read, those round an article, those that begin a block, inline marks and what becomes of them.
UNREAD = "script style noscript template svg textarea select iframe title".split()
AROUND = ("nav", "aside", "footer", "form", "dialog", "header")
BLOCKS = (
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre"
    " section table tbody td tfoot th thead tr ul head"
).split()
INLINE = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "u": "em", "code": "code", "tt": "code"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
IMAGE_FILE = r"(?i)\.(jpe?g|png|webp|gif|avif)$"
#: An icon's side; a block's score, and the share of link words in percent up to which it can be text.
LEAST_PX, LEAST_SCORE, MOST_LINKED = 200, 15.0, 33
TOKEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{n}\b[^>]*>.*?(?:</{n}\s*>|\z)" for n in UNREAD) + "|<[a-z/!?][^>]*>|<?[^<]+|<"
#: A mark for line ends, and for those ends of blocks that are no element of their own.
BREAK = "\u0001"


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of an attribute of a tag, or null."""
    value = F.regexp_extract(tag, rf"(?is)^<[a-z0-9]+(?:\s+[^\s=>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*?\s+{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.nullif(decode(F.trim(F.regexp_replace(value, r"^[\"']|[\"']$", ""))), F.lit(""))


def image_address(tag: Column, page: Column) -> Column:
    """The address of an <img>; lazy pages keep it beside a placeholder."""
    names = ("src", "data-src", "data-lazy-src", "data-original", "srcset", "data-srcset")

    def own(name: str) -> Column:
        value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
        value = F.trim(F.regexp_replace(value, r"^[\"']|[\"']$", ""))
        return F.regexp_extract(value, r"^([^\s,]+)", 1) if "srcset" in name else value

    given = F.filter(F.array(*map(own, names)), lambda v: (v != "") & ~F.startswith(v, F.lit("data:")))
    return F.get(F.filter(F.transform(given, lambda v: joined(decode(v), page)), lambda v: v.isNotNull()), F.lit(0))


def _tokens(pages: DataFrame) -> DataFrame:
    """page, i, tok, name, step: what a page is made of; step is 1 for a tag that opens, -1 for one that closes, 0 for text."""
    rows = pages.select("page", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("i", "tok"))
    name = F.lower(F.regexp_extract("tok", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    tag = F.rlike("tok", F.lit("^<[A-Za-z/!?]"))
    return (
        rows.withColumn("name", F.when(tag, name).otherwise(""))
        .withColumn("step", F.when(~tag, 0).when(F.startswith("tok", F.lit("</")), -1).otherwise(1))
        .filter(~F.startswith("tok", F.lit("<!")) & ~F.col("name").isin(*UNREAD))
    )


def scored_blocks(pages: DataFrame) -> DataFrame:
    """page, block, tag, list, raw, words, linked, inside, score: the blocks of each page that hold words or an image.

    pages: page (tells pages apart), url, html. inside: within an article or main element; score: words out of links,
    with half of those of the blocks beside it."""
    upto = W.partitionBy("page").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    text = F.col("name") == ""
    # what is asked of a token is told before the windows, whose rows need not hold it then, unless blocks are put together
    rows = _tokens(pages).select(
        "*",
        F.when(text, F.regexp_count("tok", F.lit(r"\S+"))).otherwise(0).alias("words"),
        F.when(F.col("name") == "img", F.col("tok")).alias("image"),
        F.when((F.col("name") == "a") & (F.col("step") == 1), F.regexp_extract("tok", "(?i)\\shref\\s*=\\s*[\"']?([^\"'\\s>]*)", 1)).alias("target"),
    )
    is_block = F.col("name").isin(*BLOCKS, "img")
    step = F.col("step")

    def depth(*names: str) -> Column:
        return F.sum(F.when(F.col("name").isin(*names), step).otherwise(0)).over(upto)

    # where an article begins, what is open round it no longer counts
    frame = F.col("name").isin("article", "main") & (step == 1)
    numbered = rows.select(
        "*",
        F.sum(is_block.cast("int")).over(upto).alias("block"),
        depth(*AROUND).alias("around"),
        depth("a").alias("a"),
        depth("article", "main").alias("framed"),
        F.last("target", ignorenulls=True).over(upto).alias("href"),
        F.sum(F.when(F.col("name").isin("ul", "ol"), 1).otherwise(0)).over(upto).alias("list"),
        F.last(F.when(F.col("name").isin("ul", "ol") & (step == 1), F.col("name")), ignorenulls=True).over(upto).alias("list_kind"),
        F.sum(F.when(F.col("name") == "figure", 1).otherwise(0)).over(upto).alias("figure"),
        depth("figure").alias("in_figure"),
    )
    # in the order of the first windows, so the rows are sorted once
    numbered = numbered.withColumn("outer", F.coalesce(F.last(F.when(frame, F.col("around")), ignorenulls=True).over(upto), F.lit(0)))
    known = F.element_at(F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in INLINE.items()) + ")"), F.col("name"))
    inline = F.concat(F.when(step == 1, "<").otherwise("</"), known, F.lit(">"))
    piece = F.when(text, escaped(decode(F.col("tok")))).when(F.col("name") == "br", BREAK).otherwise(F.coalesce(inline, F.lit("")))
    goes = F.col("around") - F.col("outer") > 0
    blocks = numbered.groupBy("page", "block").agg(
        F.min(F.struct("i", "name", "step")).alias("head"),
        F.min(F.struct("i", "image", "list", "list_kind", "figure", "in_figure", "a", "href")).alias("about"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"]), "").alias("raw"),
        F.sum("words").alias("words"),
        F.sum(F.when(F.col("a") > 0, F.col("words")).otherwise(0)).alias("linked"),
        F.max(goes).alias("goes"),
        F.max(F.col("framed") > 0).alias("inside"),
    )
    blocks = blocks.filter((F.col("words") > 0) | (F.col("head.name") == "img"))
    blocks = blocks.withColumn("tag", F.when(F.col("head.step") == 1, F.col("head.name")).otherwise("div"))
    framed = F.max(F.col("inside") & ~F.col("goes")).over(W.partitionBy("page"))
    blocks = blocks.withColumn("has_frame", framed).filter(~F.col("goes") & (F.col("inside") | ~F.col("has_frame")))
    along = W.partitionBy("page").orderBy("block")
    own = (F.col("words") - F.col("linked")).cast("double")
    beside = F.coalesce(F.lag(own).over(along), F.lit(0.0)) + F.coalesce(F.lead(own).over(along), F.lit(0.0))
    return blocks.withColumn("score", own + 0.5 * beside)


def balanced(body: Column) -> Column:
    """Inline marks that close what they open stay; of others all of the block go. Marks of line ends become <br>."""
    given = body
    for mark in sorted(set(INLINE.values())):
        uneven = F.regexp_count(body, F.lit(f"<{mark}>")) != F.regexp_count(body, F.lit(f"</{mark}>"))
        opened, closed = F.instr(body, f"<{mark}>"), F.instr(body, f"</{mark}>")
        early = (closed > 0) & ((opened == 0) | (closed < opened))
        body = F.when(uneven | early, F.regexp_replace(body, f"</?{mark}>", "")).otherwise(F.regexp_replace(body, rf"<{mark}>(\s*)</{mark}>", "$1"))
    body = F.when(F.contains(given, F.lit("<")), body).otherwise(given)  # most blocks have no marks
    return F.regexp_replace(body, f"(?:\\s*{BREAK}\\s*)+", "<br>")


def _flat(raw: Column) -> Column:
    """One line, without line ends at either end."""
    return F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), f"^[{BREAK} ]+|[{BREAK} ]+$", "")


def _figure(alt: Column) -> Column:
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("<figcaption>"), "caption", F.lit("</figcaption>"))).otherwise("")
    return F.concat(F.lit('<figure><img src="'), escaped(F.col("src")), F.lit('" alt="'), escaped(alt), F.lit('" loading="lazy" referrerpolicy="no-referrer">'), caption, F.lit("</figure>"))


def _with_images(blocks: DataFrame) -> DataFrame:
    """Blocks with src, alt and caption of images; those go that are small, repeated, another page's teaser, or don't say what they are."""
    image, tok = F.col("tag") == "img", F.col("about.image")
    said = F.when(F.col("tag") == "figcaption", _flat(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), BREAK, " ")))
    in_figure = F.when(F.col("about.in_figure") > 0, F.col("about.figure"))
    rows = blocks.withColumns(
        {
            "figure": F.coalesce(in_figure, -F.col("block")),
            "said": said,
            "src": F.when(image, image_address(tok, F.col("url"))),
            "alt": F.when(image, F.trim(F.regexp_replace(F.coalesce(attribute(tok, "alt"), F.lit("")), r"\s+", " "))),
            "w": F.when(image, F.regexp_extract(tok, "(?i)\\swidth\\s*=\\s*[\"']?([0-9]+)[\"'\\s>/]", 1).try_cast("int")),
            "h": F.when(image, F.regexp_extract(tok, "(?i)\\sheight\\s*=\\s*[\"']?([0-9]+)[\"'\\s>/]", 1).try_cast("int")),
        }
    )
    rows = rows.withColumn("caption", F.min(F.when(F.col("said").isNotNull(), F.struct("block", "said"))).over(W.partitionBy("page", "figure"))["said"])
    rows = rows.withColumn("name", F.regexp_replace(F.regexp_extract("src", r"([^/?#]*)(?:[?#].*)?$", 1), r"-\d+x\d+(?=\.\w+$)", ""))
    target = F.regexp_extract(F.regexp_replace("about.href", r"[?#].*$", ""), r"^(?:[A-Za-z]+://[^/]+)?/*(.*)$", 1)
    teaser = F.coalesce((F.col("about.a") > 0) & (target != "") & ~F.rlike(target, F.lit(IMAGE_FILE)), F.lit(False))
    small = F.least(F.coalesce("w", F.lit(LEAST_PX)), F.coalesce("h", F.lit(LEAST_PX))) < LEAST_PX
    tells = F.col("caption").isNotNull() | (F.col("alt") != "") | F.col("w").isNotNull()
    rows = rows.withColumn("own", image & F.col("src").isNotNull() & ~F.endswith(F.lower("name"), F.lit(".svg")) & ~small & ~teaser & tells)
    nth = F.row_number().over(W.partitionBy("page", "own", "name").orderBy("block"))
    return rows.withColumn("nth", nth).filter(~image | (F.col("own") & (F.col("nth") == 1))).filter("tag <> 'figcaption'")


def reader_blocks(pages: DataFrame, title: str | None = None) -> DataFrame:
    """page, pos, tag, body: the article's blocks as safe HTML, in order, for pages with enough sentences.

    pages: page, url, html and, where named, the title that the reader shows above, whose repetition as first heading goes."""
    told = pages.select("page", "url", F.lower(F.trim(F.col(title) if title else F.lit(None).cast("string"))).alias("title"))
    blocks = _with_images(scored_blocks(pages).join(told, "page"))
    heading, image = F.col("tag").isin(*HEADINGS), F.col("tag") == "img"
    linked_out = 100 * F.col("linked") > MOST_LINKED * F.col("words")
    blocks = blocks.filter(image | (~linked_out & (heading | F.col("inside") | (F.col("score") >= LEAST_SCORE))))
    outer = F.when(F.col("tag").isin("h1", "h2"), "h2").when(heading, "h3").when(image, "figure").when(F.col("tag").isin("li", "pre", "blockquote"), F.col("tag")).otherwise("p")

    def pre(code: Column) -> Column:
        return once(decode(code), lambda x: F.when(is_plain_text(x), plain_html(paragraphs(x))).otherwise(F.concat(F.lit("<pre><code>"), code, F.lit("</code></pre>"))))

    code = F.regexp_replace(F.regexp_replace("raw", BREAK, "\n"), "</?(?:strong|em|code)>", "")
    body = F.when(image, _figure(F.col("alt"))).when(F.col("tag") == "pre", once(code, pre)).otherwise(once(_flat(F.col("raw")), balanced))
    said = F.when(image, "").otherwise(decode(F.regexp_replace(_flat(F.col("raw")), "<[^>]*>", "")))
    made = blocks.select("page", "block", "title", outer.alias("tag"), body.alias("body"), said.alias("said"), F.col("about.list").alias("list"), F.coalesce("about.list_kind", F.lit("ul")).alias("kind"))
    # enough sentences in all that is said, or the page has no article
    whole, some = W.partitionBy("page"), F.col("body") != ""
    length, ends = F.sum(F.when(some, F.length("said") + 1)).over(whole), F.sum(F.when(some, F.regexp_count("said", F.lit(SENTENCE_END)))).over(whole)
    words = F.sum(F.when(some, F.regexp_count("said", F.lit(r"\S+")))).over(whole)
    made = made.withColumns({"length": length - 1, "ends": ends, "all_words": words})
    # only here are empty blocks left out: before the window, the condition would have bodies made twice
    made = made.filter(some & (F.col("length") >= LEAST_CHARS) & (F.col("ends") >= LEAST_SENTENCES) & (F.col("all_words") <= MOST_WORDS * F.col("ends")))
    # items of one list are one block, at the place of its first
    item = F.col("tag") == "li"
    parts = made.groupBy("page", F.when(item, -F.col("list")).otherwise(F.col("block")).alias("part")).agg(
        F.min(F.struct("block", "tag", "kind", "title", F.lower(F.trim("said")).alias("said"))).alias("head"), F.sort_array(F.collect_list(F.struct("block", "body"))).alias("all")
    )
    tag = F.when(F.col("head.tag") == "li", F.col("head.kind")).otherwise(F.col("head.tag"))
    items = F.array_join(F.transform("all", lambda x: F.concat(F.lit("<li>"), x["body"], F.lit("</li>"))), "")
    inner = F.when(F.col("head.tag") == "li", items).otherwise(F.col("all")[0]["body"])
    full = F.when(F.col("head.tag").isin("pre", "figure"), inner).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">")))
    parts = parts.select("page", F.col("head.block").alias("block"), tag.alias("tag"), full.alias("body"), F.coalesce(F.col("head.said") == F.col("head.title"), F.lit(False)).alias("again"))
    along, head = W.partitionBy("page").orderBy("block"), F.col("tag").isin("h2", "h3")
    parts = parts.withColumn("n", F.row_number().over(along)).filter(~(head & F.col("again") & (F.col("n") == 1)))
    # a heading stays if text follows before a heading of its rank or above
    after = along.rowsBetween(1, W.unboundedFollowing)
    at = {x: F.min(F.when(F.col("tag").isin(*tags), F.col("block"))).over(after) for x, tags in (("top", ["h2"]), ("any", ["h2", "h3"]))}
    text_at, head_at = F.min(F.when(~head, F.col("block"))).over(after), F.when(F.col("tag") == "h2", at["top"]).otherwise(at["any"])
    kept = parts.withColumns({"text_at": text_at, "head_at": head_at}).filter(~head | (F.col("text_at") < F.coalesce("head_at", F.lit(2**62))))
    return kept.select("page", (F.row_number().over(along) - 1).cast("long").alias("pos"), "tag", "body")
