"""Translation of reader pages by verdict tables: blocks taken apart into templates and texts, chunks sent and answered, pages put together again.

A model is never called here. requests() gives the chunks to ask for; answers are a table
with a row for each attempt, and translated() joins them by place. Two attempts count; a
page of which a chunk has no answer that lines up is left out as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import decode_once
from feedloom.functions.plain_text import once
from feedloom.operators.replies import CHUNK, folded, reply_slice

#: Inline marks that survive, blocks of one text, lists, captions, and quotes as a model keeps them.
INLINE = "</?(?:strong|em|code)>|<br>"
SIMPLE, LIST, FIGURE = r"(?s)^<(p|blockquote|h2|h3)>(.*)</\1>$", r"(?s)^<(ul|ol)>(.*)</\1>$", r"(?s)^(<figure><img [^>]*>)<figcaption>(.*)</figcaption></figure>$"
QUOTES = {"“": "&ldquo;", "”": "&rdquo;", "„": "&bdquo;"}
ATTEMPTS = 2


def template(block: Column) -> Column:
    """fixed, texts: what stays of a block, in one part more than it has texts, and its texts. Code and pictures without a caption have none."""

    def of(fixed: Column, texts: Column) -> Column:
        return F.struct(fixed.alias("fixed"), texts.alias("texts"))

    name, figure = F.regexp_extract(block, SIMPLE, 1), F.regexp_extract(block, FIGURE, 1)
    items = F.regexp_extract_all(F.regexp_extract(block, LIST, 2), F.lit("(?s)<li>(.*?)</li>"), F.lit(1))
    kind = F.regexp_extract(block, LIST, 1)
    ends = F.array(F.concat(F.lit("<"), kind, F.lit("><li>"))), F.array(F.concat(F.lit("</li></"), kind, F.lit(">")))
    between = F.array_repeat(F.lit("</li><li>"), F.size(items) - 1)
    return (
        F.when(name != "", of(F.array(F.concat(F.lit("<"), name, F.lit(">")), F.concat(F.lit("</"), name, F.lit(">"))), F.array(F.regexp_extract(block, SIMPLE, 2))))
        .when((kind != "") & (F.size(items) > 0), of(F.concat(ends[0], between, ends[1]), items))
        .when(figure != "", of(F.array(F.concat(figure, F.lit("<figcaption>")), F.lit("</figcaption></figure>")), F.array(F.regexp_extract(block, FIGURE, 2))))
        .otherwise(of(F.array(block), F.array().cast("array<string>")))
    )


def filled(fixed: Column, texts: Column) -> Column:
    """A block from its template and as many texts."""
    return F.concat(F.array_join(F.zip_with(F.slice(fixed, 1, F.size(texts)), texts, lambda f, t: F.concat(f, t)), ""), F.element_at(fixed, -1))


def cleaned(text: Column) -> Column:
    """A translated text as reader HTML: inline marks survive, all else is text."""
    marks = F.regexp_extract_all(text, F.lit(f"({INLINE})"), F.lit(1))

    def plain(x: Column) -> Column:
        return F.replace(F.replace(F.replace(decode_once(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    parts = F.transform(F.split(text, INLINE, -1), plain)
    return F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def requests(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, chunk, texts: what to ask for. pages: page, title (plain text); blocks: page, pos, body.

    The title comes first, then the blocks' texts in their order; a chunk ends before it would hold over CHUNK characters."""
    texts = _texts(pages, blocks).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "text"))).alias("all"))
    cut = texts.withColumn("chunks", folded(F.transform("all", lambda x: F.length(x["text"])), CHUNK))
    rows = cut.select("page", F.posexplode(F.arrays_zip(F.transform("all", lambda x: x["text"]).alias("t"), F.col("chunks").alias("c"))).alias("i", "x"))
    own = F.array_sort(F.collect_list(F.struct("i", F.col("x.t").alias("t"))))
    return rows.groupBy("page", F.col("x.c").alias("chunk")).agg(F.transform(own, lambda x: x["t"]).alias("texts"))


def _texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, pos, n, text: every text to translate by its place; the title at -1."""
    title = F.replace(F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    heads = pages.select("page", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("n"), title.alias("text"))
    own = blocks.select("page", F.col("pos").cast("long").alias("pos"), F.posexplode(template(F.col("body"))["texts"]).alias("n", "text"))

    def quoted(text: Column) -> Column:
        for char, entity in QUOTES.items():
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    return heads.unionByName(own).withColumn("text", quoted(F.col("text")))


def parsed(reply: Column, n: Column) -> Column:
    """The n strings of a reply, or null: what a model thinks aloud before is dropped, and an array of another length doesn't line up."""
    bare = F.regexp_replace(reply, r"(?s)^.*</think>", "")
    strings = F.from_json(reply_slice(bare), "array<string>")
    return once(strings, lambda a: F.when((F.size(a) == n) & ~F.exists(a, lambda x: x.isNull()), a))


def translated(pages: DataFrame, blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """page, title, body, calls of the pages whose chunks all have an answer that lines up. answers: page, chunk, attempt (from 1), reply.

    The first attempt that lines up counts; calls are the attempts that it took."""
    asked = requests(pages, blocks)
    tried = answers.filter(F.col("attempt").between(1, ATTEMPTS)).groupBy("page", "chunk").agg(F.array_sort(F.collect_list(F.struct("attempt", "reply"))).alias("tries"))
    got = asked.join(tried, ["page", "chunk"], "left").withColumn("n", F.size("texts"))
    good = F.filter(F.transform("tries", lambda t: F.struct(t["attempt"].alias("attempt"), parsed(t["reply"], F.col("n")).alias("texts"))), lambda t: t["texts"].isNotNull())
    got = got.select("page", "chunk", F.get(good, F.lit(0)).alias("good"))
    whole = got.groupBy("page").agg(
        F.count("good").alias("answered"), F.count(F.lit(1)).alias("chunks"), F.sum("good.attempt").alias("calls"), F.array_sort(F.collect_list(F.struct("chunk", F.col("good.texts").alias("t")))).alias("all")
    )
    texts = F.transform(F.flatten(F.transform("all", lambda x: x["t"])), cleaned)
    whole = whole.filter("answered = chunks").select("page", "calls", texts.alias("texts"))
    # a block takes the texts from its place on: as many as it has, after those of the blocks before it
    taken = blocks.select("page", F.col("pos").cast("long").alias("pos"), template(F.col("body")).alias("t"))
    laid = taken.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("laid"))
    joined = whole.join(laid, "page", "left").withColumn("laid", F.coalesce("laid", F.array().cast(laid.schema["laid"].dataType)))
    sizes = F.transform("laid", lambda x: F.size(x["t"]["texts"]))
    starts = F.aggregate(sizes, F.array(F.lit(1)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    rebuilt = F.transform("laid", lambda x, i: filled(x["t"]["fixed"], F.slice("texts", F.get("starts", i) + 1, F.size(x["t"]["texts"]))))
    title = decode_once(F.regexp_replace(F.col("texts")[0], INLINE, ""))
    return joined.withColumn("starts", starts).select("page", title.alias("title"), F.array_join(rebuilt, "\n").alias("body"), "calls")
