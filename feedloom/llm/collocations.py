"""Phrase collocation mining on a weighted de Bruijn graph of words.

An edge is a longest phrase of `longest` words; it leads from the node of its first
words to that of its last ones, and its weight is how often it occurs. Tasks add up
the edges of their own blocks of text first, then Spark deals them out by node, so the
successors of one node meet in one place. Each position of a piece starts one row: an
edge, or, where fewer words are left, the piece's end after a shorter node. So a
shorter phrase occurs as often as the flow out of all nodes that begin with it, the
ends of pieces included, and no shorter phrase is counted in the text.

Of the edges, those seen `least` times remain. A node through which one edge in and one
edge out carry all its flow is unary; edges that meet in such nodes are compacted to
paths by pointer jumping, a path being one row with its words and its weight. Paths
can't close to a ring, since text enters and leaves every ring. Candidates of the
greatest length are read off the paths, shorter ones off the nodes.

Defined results: a null text is empty, a null language is `und`; rows and ids may
repeat, each row counts; empty tables and texts without words give no rows; ties of
score and count go by the phrase's bytes. Other columns are never read, so their names
can't clash. No phrase, document or language is dropped or capped before the report's
own limit; counts are exact up to 10^16.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize, release, sliced

#: Words that a task adds up before it sends them on.
BLOCK_WORDS = 2_500_000
#: Piece ends become line feeds, white space within pieces spaces.
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\n" * 9 + b" ")
_TOKEN = re.compile(rb"[^ \n]+|\n")
_ROWS = pa.schema([("lang", pa.string()), ("node", pa.binary()), ("next", pa.binary()), ("f", pa.int64())])


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _edges_of(lang: str, texts: list[bytes], longest: int) -> pa.RecordBatch:
    """The graph of some texts: a row per node and successor (null: the piece's end), and one of the empty node with the number of words."""
    numbers = _Numbers({b"\n": 0})
    tokens = _TOKEN.findall(b"\n".join([*texts, b""]).lower().translate(_CUTS))
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    ids = np.concatenate([ids, np.zeros(longest, np.int64)])
    del tokens
    starts = np.flatnonzero(ids)
    words = pa.array(list(numbers), pa.binary())
    size, codes, alive = np.uint64(len(numbers)), ids[starts].astype(np.uint64), np.ones(len(starts), bool)
    for k in range(1, longest):
        if len(codes) and (int(codes.max()) + 1) * len(numbers) >= 1 << 64:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.uint64)
        last = ids[starts + k]
        alive &= last > 0
        codes = codes * size + np.where(alive, last, 0).astype(np.uint64)
    # equal phrases side by side: one row for each, with the place of any of them
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    counts, starts_of = np.diff(np.r_[first, len(codes)]), starts[order[first]]
    parts, ended = [], np.zeros(len(first), bool)
    for j in range(longest):
        at = np.where(ended, 0, ids[starts_of + j])
        ended |= at == 0
        parts.append(words.take(pa.array(at, mask=ended)))
    node = pc.binary_join_element_wise(*parts[:-1], pa.scalar(b" ", pa.binary()), null_handling="skip") if longest > 2 else parts[0]
    rows = [pa.repeat(pa.scalar(lang), len(first)), node, parts[-1], pa.array(counts, pa.int64())]
    total = [pa.array([lang]), pa.array([b""]), pa.nulls(1, pa.binary()), pa.array([len(starts)])]
    table = pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=_ROWS) for x in (rows, total)])
    return table.combine_chunks().to_batches()[0]


def _graph_rows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, texts in held.items():
                made = _edges_of(lang, texts, longest)
                yield from (made.slice(at, 50_000) for at in range(0, made.num_rows, 50_000))
            held.clear()
            release()

        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > BLOCK_WORDS * 6:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


_FLOWS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("f", pa.int64())])
#: Rows of sorted edges that are added up at once.
AT_ONCE = 200_000


def _runs(*columns: pa.Array) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            null = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= null[1:] != null[:-1]
    return np.flatnonzero(new)


def _flows(longest: int, least: int):
    """Sorted rows of edges -> the flow of each frequent edge, of each node that is frequent or shorter than others, and of what begins nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        before = 0

        def added_up(table: pa.Table, last: bool):
            """What is complete in the rows; the last edge and the flow of its node so far stay for the next rows."""
            nonlocal before, held
            lang, node, following, f = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
            edge_at = _runs(lang, node, following)
            sums = np.add.reduceat(f.to_numpy(), edge_at)
            lang, node, following = (c.take(pa.array(edge_at)) for c in (lang, node, following))
            node_at = _runs(lang, node)
            flow = np.add.reduceat(sums, node_at)
            flow[0] += before
            if not last:
                before = int(flow[-1] - sums[-1])
                held = [pa.RecordBatch.from_arrays([lang[-1:], node[-1:], following[-1:], pa.array(sums[-1:])], schema=_ROWS)]
                sums, node_at, flow = sums[:-1], node_at[:-1], flow[:-1]
            often = np.flatnonzero((sums >= least) & following.is_valid().to_numpy(zero_copy_only=False)[: len(sums)])
            take = pa.array(often)
            yield lang.take(take), pc.binary_join_element_wise(node.take(take), following.take(take), pa.scalar(b" ", pa.binary())), longest, sums[often]
            at = pa.array(node_at)
            lang, node = lang.take(at), node.take(at)
            words = np.where(pc.equal(pc.binary_length(node), 0), 0, pc.count_substring(node, b" ").to_numpy(zero_copy_only=False) + 1)
            for k in range(longest):
                own = np.flatnonzero((words == k) & ((flow >= least) | (k < longest - 1)))
                if len(own):
                    yield lang.take(pa.array(own)), node.take(pa.array(own)), k, flow[own]
                longer = np.flatnonzero(words > k)
                if 0 < k < longest - 1 and len(longer):
                    # sorted nodes that begin alike lie together
                    its = lang.take(pa.array(longer))
                    begun = pc.struct_field(pc.extract_regex(node.take(pa.array(longer)), rf"^(?P<b>[^ ]+(?: [^ ]+){{{k - 1}}})"), 0)
                    at = _runs(its, begun)
                    yield its.take(pa.array(at)), begun.take(pa.array(at)), k, np.add.reduceat(flow[longer], at)

        def flush(last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            for lang, phrase, words, f in added_up(table, last):
                if len(f):
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(f), words), pa.int32()), pa.array(f)], schema=_FLOWS)

        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, schema=_ROWS))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield from flush(False)
                size = 1
        if held:
            yield from flush(True)

    return run


@dataclass
class PhraseGraph:
    """The frequent part of the graph: counts has lang, phrase, words, f; every phrase of up to `longest` words
    seen `least` times, with the empty phrase for all words of a language."""

    counts: DataFrame
    longest: int
    least: int

    def edges(self) -> DataFrame:
        """lang, phrase, tail, head, f: the longest phrases between their nodes."""
        return self.counts.filter(F.col("words") == self.longest).select(
            "lang", "phrase", _first("phrase", self.longest - 1).alias("tail"), _last("phrase", self.longest - 1).alias("head"), "f"
        )

    def paths(self) -> DataFrame:
        """lang, path, f: unary paths with all their words, joined by spaces. Every edge lies on one path."""
        nodes = self.counts.filter(F.col("words") == self.longest - 1).select("lang", F.col("phrase").alias("node"), F.col("f").alias("flow"))
        edges = self.edges()
        whole = nodes.join(edges.withColumnRenamed("tail", "node"), ["lang", "node"]).filter("f = flow").select("lang", "node", F.col("phrase").alias("after"))
        links = (
            nodes.join(edges.withColumnRenamed("head", "node"), ["lang", "node"])
            .filter("f = flow")
            .select("lang", "node", F.col("phrase").alias("before"))
            .join(whole, ["lang", "node"])
        )
        # pointers lead back from an edge to the first of its path; each round doubles how far they reach
        reach = materialize(links.select("lang", F.col("after").alias("edge"), F.col("before").alias("to"), F.lit(1).cast("long").alias("steps")), "paths")
        while True:
            ahead = reach.select("lang", F.col("edge").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
            jumped = reach.join(ahead, ["lang", "to"], "left").select(
                "lang",
                "edge",
                F.coalesce("further", "to").alias("to"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("further").isNotNull().alias("moved"),
            )
            jumped = materialize(jumped, "paths")
            moved = jumped.filter("moved").limit(1).count()
            discard(reach)
            reach = jumped.drop("moved")
            if not moved:
                break
        place = (
            edges.join(reach.withColumnRenamed("edge", "phrase"), ["lang", "phrase"], "left")
            .select("lang", F.coalesce("to", "phrase").alias("first"), F.coalesce("steps", F.lit(0)).alias("at"), _last("phrase", 1).alias("word"), "f")
        )
        # all edges of a path weigh the same; a path is no longer than the longest repeated text
        laid = place.groupBy("lang", "first", "f").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own"))
        rest = F.transform(F.filter("own", lambda x: x["at"] > 0), lambda x: x["word"])
        return laid.select("lang", F.array_join(F.concat(F.array("first"), rest), " ").alias("path"), "f")

    def candidates(self) -> DataFrame:
        """lang, phrase, words, a, longer: phrases of two words or more; longer is the count of the most frequent candidate that holds them."""
        n = self.longest
        words = F.split("path", " ")
        longest = self.paths().select(
            "lang",
            F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).alias("phrase"),
            F.lit(n).alias("words"),
            F.col("f").alias("a"),
        )
        shorter = self.counts.filter((F.col("words") >= 2) & (F.col("words") < n)).select("lang", "phrase", "words", F.col("f").alias("a"))
        every = longest.unionByName(shorter)
        inner = F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " ")),
            )
        )
        holders = (
            every.filter("words > 2")
            .select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
            .groupBy("lang", "phrase")
            .agg(F.max("longer").alias("longer"))
        )
        return every.join(holders, ["lang", "phrase"], "left")

    def scored(self, share: int = 50) -> DataFrame:
        """lang, phrase, a, l, r, n, score of all candidates that no longer one covers to `share` percent."""
        kept = self.candidates().filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
        cuts = kept.select("lang", "phrase", "a", "words", cut)
        parts = cuts.select(
            "lang", "phrase", "a", "k", F.explode(F.array(_side(F.lit(0), _take("k")), _side(F.lit(1), _drop("k")))).alias("part")
        ).select("lang", "phrase", "a", "k", "part.side", F.col("part.own").alias("part"))
        known = self.counts.select("lang", F.col("phrase").alias("part"), "f")
        found = parts.join(known, ["lang", "part"])
        sides = found.groupBy("lang", "phrase", "a", "k").agg(
            F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
        )
        best = sides.withColumn("score", exact_score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
        totals = self.counts.filter("words = 0").select("lang", F.col("f").alias("n"))
        # languages are few, and those of the totals are the ones of the counts: a row each
        return best.join(totals, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")

    def top(self, most: int = 2000, share: int = 50) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases."""
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        ranked = self.scored(share).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)) in whole decimals; a is at most left and right, so the quotient is at most 10^6."""
    return F.expr(
        f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * cast(1000000 as decimal(7,0)))"
        f" div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))"
    )


def _first(phrase: str, n: int) -> Column:
    return F.substring_index(F.col(phrase), " ", n)


def _last(phrase: str, n: int) -> Column:
    return F.substring_index(F.col(phrase), " ", -n)


def _take(k: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {k})")


def _drop(k: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {k} - words)")


def _side(side: Column, own: Column) -> Column:
    return F.struct(side.alias("side"), own.alias("own"))


def phrase_graph(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> PhraseGraph:
    """The graph of all texts; longest: words of an edge, 2 at least; least: occurrences below which phrases are left out."""
    if longest < 2:
        raise ValueError("an edge has two words at least")
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sent = source.mapInArrow(_graph_rows(longest), "lang string, node binary, next binary, f long")
    # a node's rows meet, sorted, in one task, which holds a slice of them at a time
    sent = sent.repartition("lang", "node").sortWithinPartitions("node", "lang", "next")
    flows = sent.mapInArrow(_flows(longest, least), "lang string, phrase binary, words int, f long")
    counts = flows.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("f").alias("f"))
    counts = counts.filter((F.col("f") >= least) | (F.col("words") == 0))
    return PhraseGraph(materialize(counts, "phrase-counts"), longest, least)
