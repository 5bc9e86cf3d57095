"""Plain text: detection, and lines joined to paragraphs, against a walk line by line."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.functions import plain_text

NOTES = """
Widget 10.6 was released on 2026-10-06. It is available from the
mirrors listed at https://www.widget.example/.

Recently the widget team have received a large number of security
bug reports, many of which are findings from tools or were made with
their assistance. We very much welcome these reports.

** We have seen a number of cases where a security bug identified
** by tools is subsequently independently discovered by a
** different researcher.

Future deprecation notice
-------------------------

 * scp(1): begin deprecating the -R flag, which is used to perform a
   remote-to-remote copy by executing scp on a remote host. This
   option is a fragile optimisation.

 * sshd(8): support for platforms that do not allow file descriptor
   passing will be removed in a future release. It is <rare>.

Checksums:
==========

 - SHA1 (widget-10.6.tar.gz) = 854863c04cd28242d73ac6c3ee9c37fa756f1a2f
 - SHA1 (widget-10.6p1.tar.gz) = 9c78838ec07af14aff54f3755ac56ce6812452a9
"""


def walked(text):
    """Spans by a walk that carries its state from line to line."""
    lines = [x.expandtabs().rstrip() for x in text.splitlines()]
    sizes = sorted(len(x) for x in lines if x)
    width = sizes[len(sizes) * 9 // 10] if sizes else 0
    rule, quote_mark, bullet = (re.compile(p) for p in (r"\s*([-=~_*#])\1{2,}\s*", r"\s*(?:\*\*|>+|\|)(?:\s+|$)", r"\s*(?:[-*+•]|\d{1,3}[.)])\s+(?=\S)"))
    out, state = [], None
    for at, line in enumerate(lines):
        if not line:
            state = None
            if out and out[-1][0] != "blank":
                out.append(("blank", 0, ""))
        elif rule.fullmatch(line):
            state = None
            out.append(("rule", 0, line))
        else:
            quote = quote_mark.match(line)
            rest = line[quote.end() :] if quote else line.lstrip()
            mark, indent = quote and quote.group().strip(), len(line) - len(line.lstrip())
            word = (rest.split() or [""])[0]
            joins = state is not None and word and not bullet.match(rest) and not (at + 1 < len(lines) and rule.fullmatch(lines[at + 1]))
            if joins:
                hang, open_mark, last = state
                joins = (mark == open_mark if mark and open_mark else not mark and not open_mark and indent == hang) and (len(last) + 1 + len(word)) * 10 > width * 8
            if joins:
                out[-1] = (*out[-1][:2], out[-1][2] + " " + rest.strip())
                state = (state[0], state[1], line)
            else:
                begin = quote or bullet.match(line)
                hang = begin.end() if begin else indent
                out.append(("text", hang, line))
                state = (hang, mark, line)
    while out and out[-1][0] == "blank":
        out.pop()
    return out


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", plain_text.paragraphs(F.col("t")))
    return [[(x.kind, x.hang, x.body) for x in r.s] for r in df.orderBy("i").collect()]


def test_notes_become_paragraphs(spark):
    row = spark.createDataFrame([(NOTES,)], "t string").select(plain_text.plain_html(plain_text.paragraphs(F.col("t"))).alias("h"), plain_text.is_plain_text(F.col("t")).alias("p")).first()
    assert row.p
    for line in (
        "<span>Widget 10.6 was released on 2026-10-06. It is available from the mirrors listed at https://www.widget.example/.</span>",
        '<span style="--h:3">** We have seen a number of cases where a security bug identified by tools is subsequently independently discovered by a different researcher.</span>',
        '<span>Future deprecation notice</span><span class="rule">-------------------------</span>',
        '<span style="--h:3"> * scp(1): begin deprecating the -R flag, which is used to perform a remote-to-remote copy by executing scp on a remote host. This option is a fragile optimisation.</span>',
        "It is &lt;rare&gt;.</span>",
        '<span style="--h:3"> - SHA1 (widget-10.6.tar.gz)',
        '<span style="--h:3"> - SHA1 (widget-10.6p1',
        "<span></span>",
    ):
        assert line in row.h
    assert "\n" not in row.h and row.h.endswith("</span></div>") and not row.h.endswith("<span></span></div>")


def test_lines_equal_the_walk(spark):
    r = random.Random(4)
    pieces = ["", "", "a short line", "a much longer line that fills most of the width of text", "  indented line that is long enough to wrap over here now", " * item that goes on for quite a while until it is full",
              "   and its next line goes on for quite a while and is full", "> quoted words that go on until the line is as good as full", ">> deeper", "** marked words that go on until the line is as good as full", "| ", ">",
              "-----", "===", "12. numbered item that is long enough to be wrapped on", "\ttab\tstops and more words so that the line is quite full ok", "x", "  odd space that is long enough to be wrapped about here", "…", "- ", "*** a", "##"]
    texts = [r.choice(["\n", "\r\n", "\n\n", "\x0b", " "]).join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(300)]
    texts += [NOTES, "", "\n\n", " ", "one", "x" * 100_000 + "\ny", "word " * 20_000, "\n".join(["line of text that is long"] * 3000)]
    assert spans(spark, texts) == [walked(t) for t in texts]
    assert spans(spark, [None]) == [[]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (NOTES, True), (None, False), ("", False), ("Too short. Much. So.", False), (NOTES + "┌─┐", False),
        ("".join(f"int f{i}(int x) {{\n    return x + {i}; /* add it. Then return. */\n}}\n" for i in range(20)), False),
        (NOTES + "\n".join(f"a{i}     b{i}     c{i}." for i in range(20)), False),
    ],
)
def test_detection(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(plain_text.is_plain_text(F.col("t"))).first()[0] is want


def test_escape(spark):
    assert spark.createDataFrame([("<a href=\"x\">&'",)], "t string").select(plain_text.escaped(F.col("t"))).first()[0] == html.escape("<a href=\"x\">&'")
