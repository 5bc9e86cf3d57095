"""Mixing sources to target weights, by DataFrame functions alone.

Documents of a source are laid end to end in a pseudorandom order and cut into
blocks of a fixed number of words, which is less for a source whose target is but a
few blocks. The mix is a row of slots, cut into output
shards. Every shard draws its slots' sources from a multinomial distribution.
What a source has drawn beyond its quota is dealt again to the sources still
short of theirs, so totals are exact to a block. The r-th slot of a source takes
block perm(r mod blocks) of its epoch r div blocks, perm being a keyed
permutation of the source's block numbers, and slots meet blocks in a join by
source and block number.

Defined results: a null text has no words; null is a source of its own, after
all others; rows without words take part with size 0 and are never taken;
repeated rows and repeated ids are separate documents; an empty table gives an
empty mix. Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, fresh, join_small, materialize, prefix_sums

#: Weights by the order of the sources' names, repeating.
WEIGHTS = (3, 1, 2)
#: About so many rows of all sources have their places summed up in one task.
BUCKET_ROWS = 4_000


@dataclass
class Mix:
    """sizes: row, doc_id, src, size; sources: src, source, source_size, target, block_words, blocks, quota;
    pieces: src, block, row, first_word, words; slots: shard, src, rank, block, epoch."""

    sizes: DataFrame
    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame
    n_sources: int

    def block_counts(self) -> DataFrame:
        """src, block, times: how often the mix takes a block."""
        return self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))

    def taken_pieces(self) -> DataFrame:
        """src, block, row, first_word, words, times: blocks joined with their slots by number."""
        return self.pieces.join(self.block_counts(), ["src", "block"])

    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken; one row per document."""
        taken = self.taken_pieces().groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        out = self.sizes.join(taken, "row", "left")
        return join_small(out, self.sources, ["src"], self.n_sources).select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def fill_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size -> src, source, source_size, target.

    Sources by code point, null last, weigh WEIGHTS and share `share` of all sizes;
    none gets more than `limit` times its size, and the excess goes to the others by
    weight. Sorted by limit over weight, the limited sources come first, so one pass
    over running sums finds them."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("src") % len(WEIGHTS)) + 1).cast("int"))
    before = W.orderBy("ratio", "src").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    total = F.sum("source_size").over(every) * F.lit(share)
    rest = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("rest")
    open_weight = (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight")
    ranked = (
        sizes.withColumn("src", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", F.col("source_size") * F.lit(limit))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .select("*", rest, open_weight)
        .withColumn("held", F.col("ratio") * F.col("open_weight") <= F.col("rest"))
    )
    # the first source that isn't held sets the level for itself and all after it
    first = F.min(F.when(~F.col("held"), F.struct("ratio", "src", (F.col("rest") / F.col("open_weight")).alias("level")))).over(
        W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    target = F.when(F.col("held"), F.col("most")).otherwise(F.col("weight") * first["level"])
    return ranked.select("src", "source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where a keyed permutation of 0..n-1 sends x.

    A Feistel network adds hashes modulo the sides of the smallest near-square
    rectangle that holds n, and numbers outside 0..n-1 are walked on. Fewer than
    sqrt(n) numbers lie outside, so the walk ends within 64 steps for any n up to
    4,096, and beyond that fails to with a chance below n**-32, which raises."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def step(y: Column) -> Column:
        left, right = F.floor(y / b).cast("long"), y % b
        for i in range(2):
            left = (left + F.pmod(F.xxhash64(right, key, F.lit(2 * i)), a)) % a
            right = (right + F.pmod(F.xxhash64(left, key, F.lit(2 * i + 1)), b)) % b
        return left * b + right

    first = step(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda y, _: F.when(y < n, y).otherwise(step(y)))
    found = F.when(first < n, first).otherwise(walked)
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("the permutation's walk did not end")).cast("long"))


def _layout(sizes: DataFrame, rows: int, seed: int) -> DataFrame:
    """Where documents fall in their source's row of blocks: src, block, row, first_word, words."""
    buckets = max(1, rows // BUCKET_ROWS)
    placed = sizes.filter("size > 0").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    placed = placed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    placed = prefix_sums(placed, ["src"], "bucket", ["h", "doc_id", "size", "row"], "size", "start")
    b = F.col("block_words")
    low, end = F.col("block") * b, F.col("start") + F.col("size")
    first = F.greatest(low, F.col("start"))
    return placed.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
    ).select("src", "block", "row", (first - F.col("start")).alias("first_word"), (F.least(low + b, end) - first).alias("words"))


def _slots(spark, sources: DataFrame, n_sources: int, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, src, rank: every slot of the mix with its number within its source."""
    upto = W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    cells = 1024
    width = max(1, -(-slots // cells))
    spans = (
        sources.withColumn("low", F.coalesce(F.sum("quota").over(upto), F.lit(0)))
        .withColumn("high", F.col("low") + F.col("quota"))
        .filter("quota > 0")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
        .select("src", "low", "high", "cell")
    )
    draws = (
        spark.range(slots)
        .select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(slots)).alias("u"))
        .withColumn("cell", F.floor(F.col("u") / width))
    )
    drawn = (
        join_small(draws, spans, ["cell"], n_sources + cells)
        .filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        .groupBy("shard", "src")
        .agg(F.count(F.lit(1)).alias("drawn"))
    )
    drawn = materialize(drawn, "mix-draws")
    ranked = prefix_sums(
        drawn.withColumn("shard_group", F.floor(F.col("shard") / 4096)), ["src"], "shard_group", ["shard"], "drawn", "before"
    )
    ranked = join_small(ranked, sources.select("src", "quota"), ["src"], n_sources)
    kept = ranked.withColumn("keep", F.greatest(F.lit(0), F.least("drawn", F.col("quota") - F.col("before"))))
    own = kept.filter("keep > 0").select(
        "shard", "src", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("keep") - 1)).alias("rank")
    )
    # slots beyond a source's quota, and the ranks that other sources lack, are numbered alike and joined by number
    state = sources.join(drawn.groupBy("src").agg(F.sum("drawn").alias("drawn")), "src", "left").select(
        "src", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn")
    )
    over = F.greatest(F.lit(0), F.col("drawn") - F.col("quota"))
    under = F.greatest(F.lit(0), F.col("quota") - F.col("drawn"))
    state = (
        state.withColumn("over", over)
        .withColumn("under", under)
        .withColumn("over_at", F.coalesce(F.sum("over").over(upto), F.lit(0)))
        .withColumn("under_at", F.coalesce(F.sum("under").over(upto), F.lit(0)))
    )
    spare_at = F.greatest("before", "quota") - F.col("quota") + F.col("over_at")
    spare = (
        join_small(kept.filter("keep < drawn"), state.select("src", "over_at"), ["src"], n_sources)
        .withColumn("number", F.explode(F.sequence(spare_at, spare_at + F.col("drawn") - F.col("keep") - 1)))
        .select("shard", "number")
    )
    short = (
        state.filter("under > 0")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)))
        .select("src", (F.col("drawn") + F.col("k")).alias("rank"), (F.col("under_at") + F.col("k")).alias("number"))
    )
    return own.unionByName(spare.join(short, "number").select("shard", "src", "rank"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    limit: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 20_01,
    row_col: str | None = None,
) -> Mix:
    """Mix all documents; see the module. A source's taken words differ from its target by about a block.

    share: the mix's words over all words; limit: the most epochs of a source;
    block_words: words of a block, or a sixteenth of the source's target if that is less; shard_slots: blocks of an output shard; row_col: a
    column that tells rows apart, else they are numbered."""
    spark = docs.sparkSession
    counted = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    counted = materialize(counted, "mix-sizes")
    by_source = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = fill_targets(by_source.select("source", "source_size"), share, limit)
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / 16))).cast("long")
    sources = sources.withColumn("block_words", words)
    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    most = F.floor(blocks * F.lit(limit)).cast("long")
    sources = sources.select(
        "*", blocks.alias("blocks"), F.least(F.round(F.col("target") / F.col("block_words")).cast("long"), most).alias("quota")
    )
    sources = materialize(sources, "mix-sources")
    totals = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    n_sources, n_slots = int(totals[0]), int(totals[1])
    rows = by_source.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    keyed = F.col("source").eqNullSafe(F.col("its_source"))
    sizes = join_small(
        counted, sources.select("src", "block_words", F.col("source").alias("its_source")), keyed, n_sources
    ).select("row", "doc_id", "src", "size", "block_words")
    pieces = _layout(sizes, int(rows), seed)
    sizes = sizes.drop("block_words")
    ranks = _slots(spark, sources, n_sources, n_slots, shard_slots, seed)
    slots = join_small(ranks, sources.select("src", "blocks"), ["src"], n_sources).select(
        "shard",
        "src",
        "rank",
        permuted(F.col("rank") % F.col("blocks"), F.col("blocks"), F.xxhash64("src", F.lit(seed))).alias("block"),
        F.floor(F.col("rank") / F.col("blocks")).alias("epoch"),
    )
    return Mix(sizes, sources, pieces, slots, n_sources)


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix as rows with the columns of docs: one per document and epoch that takes words of it.

    A row whose document is taken whole keeps its text; of others the taken words
    remain, in their order, with a space between. length_col, where given, becomes the text's length."""
    row, pieces, size, epoch = (fresh(docs, x) for x in ("row", "pieces", "size", "epoch"))
    base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    mix = mix_sources(base, text_col=text_col, row_col=row, **how)
    last = F.array_max(F.transform(pieces, lambda p: p["times"])).cast("int")
    per_doc = (
        mix.taken_pieces()
        .join(mix.sizes.select("row", F.col("size").alias("whole")), "row")
        .groupBy(F.col("row").alias(row), F.col("whole").alias(size))
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "words", "times"))).alias(pieces))
        .withColumn(epoch, F.explode(F.sequence(F.lit(1), last)))
        .withColumn(pieces, F.filter(pieces, lambda p: p["times"] >= F.col(epoch)))
    )
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    # an array of one, so that the words are found once for all pieces
    part = F.transform(
        F.array(words),
        lambda w: F.array_join(
            F.flatten(F.transform(pieces, lambda p: F.slice(w, (p["first_word"] + 1).cast("int"), p["words"].cast("int")))), " "
        ),
    )[0]
    whole = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col(size)
    out = base.join(per_doc, row).withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
