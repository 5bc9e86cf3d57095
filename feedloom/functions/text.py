"""Gates and features of plain text, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.html import decode, strip_html

#: Frequent words of one language, and limits of prose and of cards.
GERMAN = tuple("der die das und ist nicht mit für auf ein eine einen den dem des sich auch von zu im wird sind wie aber oder nach bei über".split())
ENGLISH = tuple("the and is of to that with for on are was this it be have from by not they which but or has were".split())
LEAST_CHARS, LEAST_SENTENCES, MOST_WORDS = 400, 3, 60
CARD_LEAST, CARD_SENTENCES, CARD_MOST = 80, 3, 240
TRAILER = 12
SENTENCE_BREAK = "(?:(?<=[.!?…])|(?<=[.!?…][\"“”»)]))\\s+(?=[\"„“»(]?[A-ZÄÖÜ0-9])"
ELLIPSIS, END_MARK = "\\s*(\\.\\.\\.|…)[\"“”»)]?$", "[.!?…][\"“”»)]?$"
SENTENCE_END = "[.!?…][\"'»«“”)\\]]*(\\s|$)"


def one_line(text: Column, limit: int | None = None) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.substring(flat, 1, limit) if limit else flat


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def detect_lang(text: Column) -> Column:
    """de or en by frequent words: at least five, and twice those of the other; else null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zäöüß]+)"), F.lit(1))
    de, en = (F.size(F.filter(words, lambda w: w.isin(*v))) for v in (GERMAN, ENGLISH))
    return F.when((de >= 5) & (de >= 2 * en) & (de > en), "de").when((en >= 5) & (en >= 2 * de), "en")


def is_prose(text: Column) -> Column:
    """Long enough, with sentences, none too long on average."""
    ends = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SENTENCE_END))
    return (F.length(F.coalesce(text, F.lit(""))) >= LEAST_CHARS) & (ends >= LEAST_SENTENCES) & (word_count(text) <= MOST_WORDS * ends)


def sentences(text: Column) -> Column:
    """Sentences of a line of text: a new one begins with a capital letter or digit, after an end mark and white space."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: s != "")


def _summary(text: Column, may_be_cut: bool) -> Column:
    """Whole sentences, CARD_SENTENCES at most, until CARD_LEAST characters are full. A last one that ends in an ellipsis goes, and in a
    feed's snippet one without an end mark."""

    def whole(all_: Column) -> Column:
        last = F.element_at(all_, -1)
        unfinished = F.rlike(last, F.lit(ELLIPSIS)) | (~F.rlike(last, F.lit(END_MARK)) if may_be_cut else F.lit(False))
        return F.when((F.size(all_) > 0) & unfinished, F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(all_)

    def picked(all_: Column) -> Column:
        first = F.slice(whole(all_), 1, CARD_SENTENCES)
        return F.aggregate(first, F.lit(""), lambda a, s: F.when(F.length(a) >= CARD_LEAST, a).when(a == "", s).otherwise(F.concat(a, F.lit(" "), s)))

    short = F.get(F.transform(F.array(sentences(text)), picked), F.lit(0))
    return F.get(F.transform(F.array(short), lambda p: F.when(F.length(p) <= CARD_MOST, p).otherwise(word_cut(p, CARD_MOST))), F.lit(0))


def card_summary(snippet: Column, description: Column) -> Column:
    """The card's summary, from a feed's snippet or the page's description: the first whose whole sentences fill about two lines, else the longer.

    Where neither has a whole sentence, the longer text is cut at a word. Empty where both are."""

    def chosen(texts: Column) -> Column:
        sums = F.filter(F.array(_summary(texts[0], True), _summary(texts[1], False)), lambda s: s != "")
        return F.get(F.transform(F.array(sums), lambda both: best(both, texts)), F.lit(0))

    def longer(both: Column) -> Column:
        return F.when(F.length(F.get(both, F.lit(1))) > F.length(both[0]), both[1]).otherwise(F.get(both, F.lit(0)))

    def best(both: Column, texts: Column) -> Column:
        long = F.get(F.filter(both, lambda s: F.length(s) >= CARD_LEAST), F.lit(0))
        return F.coalesce(long, longer(both), F.when(longer(texts) != "", word_cut(longer(texts), CARD_MOST)), F.lit(""))

    return F.get(F.transform(F.array(F.array(strip_html(snippet), strip_html(description))), chosen), F.lit(0))


def word_cut(text: Column, limit: int) -> Column:
    """Cut at a word's end where it is too long, with one ellipsis in any case."""
    bare = F.regexp_replace(text, ELLIPSIS, "")
    short = F.regexp_replace(F.regexp_replace(F.substring(bare, 1, limit), " [^ ]*$", ""), "[,;:–-]+$", "")
    return F.concat(F.when(F.length(bare) > limit, short).otherwise(bare), F.lit("…"))


def is_diagram(text: Column) -> Column:
    """A line of over 40 characters, and box-drawing characters or two ASCII boxes."""
    widest = F.array_max(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.rtrim(x))))
    return (widest > 40) & ((F.regexp_count(text, F.lit("[─-╿]")) >= 6) | (F.regexp_count(text, F.lit(r"\+-{2,}\+")) >= 2))


def repeats_title(title: Column, text: Column) -> Column:
    """Whether a text says no more than the title, letters and digits compared: the same, a start of it, or it with a short trailer. Empty ones never do."""
    t, s = (F.regexp_replace(F.lower(decode(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]", "") for x in (title, text))
    return (t != "") & (s != "") & (F.startswith(t, s) | (F.startswith(s, t) & (F.length(s) - F.length(t) <= TRAILER)))


def is_ad(title: Column, patterns: tuple[str, ...] = ("anzeige:", "advertorial", "sponsored")) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(low, F.lit(p.lower()))
    return out
