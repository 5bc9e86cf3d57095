"""Hand-wrapped plain text: whether a text is one, and its lines joined to paragraphs, as Column expressions.

Whether a line goes on with the paragraph before it depends on that line and its two
neighbours alone: a paragraph that is open ends with the line before, which has the
paragraph's hanging indent or quote mark, since only lines with that indent or mark
join it. So no state runs through a text, and all of it happens in its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import is_prose

#: White space, and where lines end.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"
#: A heading's underline, list marks, marks that quoted lines repeat, lines of code, columns, boxes; how full a line is before it wraps.
RULE = rf"^{SPACE}*([-=~_*#])\1{{2,}}{SPACE}*$"
BULLET = rf"^{SPACE}*(?:[-*+•]|\d{{1,3}}[.)]){SPACE}+(?=\S)"
QUOTE = rf"^{SPACE}*(?:\*\*|>+|\|)(?:{SPACE}+|$)"
CODE, COLUMNS, BOX = rf"[;{{}}]{SPACE}*$", r"\S {3,}\S", "[─-╿]"
FULL_PERCENT, CODE_PERCENT, COLUMN_PERCENT = 80, 5, 10


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def is_plain_text(text: Column) -> Column:
    """Prose whose lines are neither code, nor columns, nor drawings."""
    lines = F.filter(text_lines(text), lambda x: F.rlike(x, F.lit(r"[^\s\x1C-\x1F\x85\p{Z}]")))
    code = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(CODE))))
    columns = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(COLUMNS))))
    few = (code * 100 <= F.size(lines) * CODE_PERCENT) & (columns * 100 <= F.size(lines) * COLUMN_PERCENT)
    return is_prose(text) & few & ~F.coalesce(F.rlike(text, F.lit(BOX)), F.lit(False))


def without_tabs(line: Column) -> Column:
    """The line with tabs filled up to columns of eight."""
    parts = F.split(line, "\t")

    def fill(done: Column, part: Column) -> Column:
        return F.concat(F.rpad(done, ((F.length(done) / 8).cast("int") + 1) * 8, " "), part)

    return F.when(F.contains(line, F.lit("\t")), F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], fill)).otherwise(line)


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def _matched(x: Column, pattern: str) -> Column:
    """What the pattern matches at the start, or null."""
    return F.when(F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, 0))


def _looked_at(line: Column) -> Column:
    def with_quote(quote: Column) -> Column:
        rest = F.when(quote.isNotNull(), F.substring(line, F.length(quote) + 1, F.length(line))).otherwise(F.ltrim(line, F.lit(SPACES)))
        return once(rest, lambda r: looked(quote, r))

    def looked(quote: Column, rest: Column) -> Column:
        indent = F.length(F.regexp_extract(line, rf"^{SPACE}*", 0))
        return F.struct(
            line.alias("line"),
            F.length(line).alias("n"),
            (line == "").alias("blank"),
            F.rlike(line, F.lit(RULE)).alias("rule"),
            _bare(quote).alias("mark"),
            F.rlike(rest, F.lit(BULLET)).alias("bullet"),
            indent.alias("indent"),
            F.coalesce(F.length(F.coalesce(quote, _matched(line, BULLET))), indent).alias("hang"),
            F.when(quote.isNull(), rest).otherwise(_bare(rest)).alias("rest"),
            F.length(F.regexp_extract(rest, rf"^{SPACE}*([^\s\x1C-\x1F\x85\p{{Z}}]*)", 1)).alias("first"),
        )

    return once(_matched(line, QUOTE), with_quote)


def paragraphs(text: Column) -> Column:
    """An array of kind, hang, body: paragraphs, list items and headings as `text`, underlines as `rule`, and one `blank` for blank lines between them.

    hang is the column where the lines start into which the body wraps. Null and blank texts give an empty array."""
    looked = F.transform(text_lines(text), lambda x: once(without_tabs(F.rtrim(x, F.lit(SPACES))), _looked_at))
    return once(looked, _with_width)


def once(value: Column, then) -> Column:
    """then(value), with value worked out once and not wherever then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with_width(looked: Column) -> Column:
    lengths = F.sort_array(F.filter(F.transform(looked, lambda x: x["n"]), lambda n: n > 0))
    width = F.coalesce(F.get(lengths, (F.size(lengths) * 9 / 10).cast("int")), F.lit(0))
    last = F.array_max(F.transform(looked, lambda x, i: F.when(~x["blank"], i).otherwise(-1)))
    return once(F.struct(width.alias("width"), last.alias("last")), lambda m: _spans(looked, m["width"], m["last"]))


def _spans(looked: Column, width: Column, last: Column) -> Column:
    def role(x: Column, i: Column) -> Column:
        """`start`, `rule` or `blank` where something begins; `on` where a paragraph goes on; null for other blank lines."""
        before, after = F.get(looked, i - 1), F.get(looked, i + 1)
        is_open = before.isNotNull() & ~before["blank"] & ~before["rule"]
        same = F.when(x["mark"].isNotNull() & before["mark"].isNotNull(), x["mark"] == before["mark"]).otherwise(
            x["mark"].isNull() & before["mark"].isNull() & (x["indent"] == before["hang"])
        )
        wrapped = (before["n"] + 1 + x["first"]) * 100 > width * FULL_PERCENT
        underlined = F.coalesce(after["rule"], F.lit(False))
        goes_on = F.coalesce(is_open & same & wrapped & (x["first"] > 0) & ~underlined & ~x["bullet"], F.lit(False))
        between = (i > 0) & (i < last) & ~F.coalesce(before["blank"], F.lit(True))
        return F.when(x["blank"], F.when(between, "blank")).when(x["rule"], "rule").when(goes_on, "on").otherwise("start")

    def built(roles: Column) -> Column:
        begins = F.filter(F.transform(roles, lambda r, i: F.when(r.isNotNull() & (r != "on"), i)), lambda i: i.isNotNull())
        return once(begins, lambda at: F.transform(at, lambda i, k: one(roles, at, i, k)))

    def one(roles: Column, at: Column, i: Column, k: Column) -> Column:
        kind, first = F.get(roles, i), F.get(looked, i)
        until = F.coalesce(F.get(at, k + 1), F.size(roles))
        own = F.filter(F.sequence(i, until - 1), lambda j: (j > i) & (F.get(roles, j) == "on"))
        rest = F.transform(own, lambda j: F.get(looked, j)["rest"])
        body = F.when(kind == "blank", "").otherwise(F.array_join(F.concat(F.array(first["line"]), rest), " "))
        return F.struct(
            F.when(kind == "start", "text").otherwise(kind).alias("kind"), F.when(kind == "start", first["hang"]).otherwise(0).alias("hang"), body.alias("body")
        )

    return once(F.transform(looked, role), built)


def escaped(text: Column) -> Column:
    """Text for HTML, quotes included."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def plain_html(spans: Column) -> Column:
    """The spans of paragraphs() as one block of HTML."""

    def span(s: Column) -> Column:
        hung = F.when(s["hang"] > 0, F.concat(F.lit(' style="--h:'), s["hang"].cast("string"), F.lit('"'))).otherwise("")
        attribute = F.when(s["kind"] == "rule", ' class="rule"').otherwise(hung)
        return F.concat(F.lit("<span"), attribute, F.lit(">"), escaped(s["body"]), F.lit("</span>"))

    return F.concat(F.lit('<div class="plain">'), F.array_join(F.transform(spans, span), ""), F.lit("</div>"))
