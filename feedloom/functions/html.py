"""Plain text, titles and links out of HTML, as Column expressions."""

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.url import joined

#: Entities by name, from the language's own table.
NAMES = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
_TABLE = "map(" + ", ".join(f"'{name}', '\\u{ord(char):04x}'" for name, char in NAMES.items()) + ")"
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(name: Column) -> Column:
    """What an entity stands for; one that isn't known stays as it is."""
    digits = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substring(name, 3, 8), 16, 10)).when(
        F.startswith(name, F.lit("#")), F.substring(name, 2, 8)
    )
    point = digits.cast("long")
    known = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    numeric = F.when(point == 0xA0, " ").when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    return F.coalesce(numeric, F.element_at(F.expr(_TABLE), name), F.concat(F.lit("&"), name, F.lit(";")))


def decode_once(text: Column) -> Column:
    """Entities decoded a single time."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)))
    found = F.array_sort(found, lambda a, b: (a == "amp").cast("int") - (b == "amp").cast("int"))  # what an ampersand opens waits for the next time
    return F.aggregate(found, text, lambda t, e: F.replace(t, F.concat(F.lit("&"), e, F.lit(";")), _character(e)))


def decode(text: Column) -> Column:
    """Entities decoded, three times over at most, since feeds escape what is escaped; marks of CDATA dropped."""
    three = F.aggregate(F.array(*map(F.lit, range(3))), text, lambda t, _: decode_once(t))
    return F.regexp_replace(F.when(F.contains(text, F.lit("&")), three).otherwise(text), r"<!\[CDATA\[|\]\]>", "")


def strip_html(text: Column) -> Column:
    """Text without tags, a tag that is cut off, or zero-width characters; white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(decode(F.coalesce(text, F.lit(""))), "<[^>]*>", " "), "<[^>]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[​‌‍﻿]", ""), r"[ \t\n\r\f]+", " "))


def title(html: Column) -> Column:
    return strip_html(F.regexp_extract(html, "<title>([^<]*)</title>", 1))


def language(html: Column) -> Column:
    return F.regexp_extract(html, '<html lang="([a-z]+)"', 1)


def anchors(html: Column, page: Column | None = None) -> Column:
    """An array of url, text: the page's http(s) links in order, whatever the case, the quotes and other attributes.

    With the page's own address, links that start with a slash are completed by its host."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*>.*?</a\\s*>"), F.lit(0))

    def parsed(tag: Column) -> Column:
        value = F.regexp_extract(tag, "(?is)^<a\\s(?:[^>]*\\s)?href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)", 1)
        inner = F.regexp_replace(tag, "(?is)^<a\\s[^>]*>|</a\\s*>$", "")
        address = decode(F.trim(F.btrim(value, F.lit("\"'"))))
        if page is not None:
            host = F.regexp_extract(page, "(?i)^(https?://[^/?#]+)", 1)
            address = F.when(F.startswith(address, F.lit("/")) & ~F.startswith(address, F.lit("//")), F.concat(host, address)).otherwise(address)
        return F.struct(address.alias("url"), strip_html(inner).alias("text"))

    return F.filter(F.transform(tags, parsed), lambda a: F.lower(a["url"]).rlike("^https?://"))


def meta(html: Column, *keys: str) -> Column:
    """The first non-empty content of a page's meta tags with these keys, in the order of the keys, whatever that of the attributes."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<meta\\s[^>]*>"), F.lit(0))

    def attribute(tag: Column, name: str) -> Column:
        value = F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*')", 1)
        return F.substring(value, F.lit(2), F.length(value) - 2)

    def content(key: str) -> Column:
        named = F.filter(tags, lambda t: (F.lower(attribute(t, "(?:name|property)")) == key) & (attribute(t, "content") != ""))
        return F.nullif(decode(attribute(F.get(named, F.lit(0)), "content")), F.lit(""))

    return F.coalesce(*map(content, keys))


def first_image(html: Column) -> Column:
    """The address of the first image if it is absolute, or null; markup may be escaped."""
    found = F.trim(F.regexp_extract(decode(F.coalesce(html, F.lit(""))), "(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"']([^\"']+)", 1))
    return F.when(F.rlike(found, F.lit("^https?://")), found)


def meta_image(html: Column, page: Column) -> Column:
    """The address of the image that a page's head names, as it is meant on the page; null where it isn't http(s)."""
    return joined(F.trim(meta(html, "og:image", "twitter:image")), page)
