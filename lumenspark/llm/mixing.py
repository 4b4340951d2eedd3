"""Mixing sources to target weights, in DataFrame operations only.

Each source is a stream of words: its documents in a pseudorandom but fixed order, packed into blocks of a fixed
number of words, the last one shorter. A source's quota of slots follows from its target. The slots of all sources
are drawn to output shards: a slot's place in the output is a pseudorandom permutation of all places, so the counts
of sources in a shard are a multinomial draw given the quotas. Within its source a slot has a rank, shard by shard;
rank by rank, each epoch runs through a pseudorandom permutation of the source's blocks of its own, and the block is
joined by its index. The last slot of a source is cut where the target is reached, so targets are met to the word,
and since no target exceeds three times its source, no block is taken more often than that.

Prefix sums go through buckets of a source, so a source with most of the rows burdens no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.common import ROW, identified, once, stored, unused

#: Fixed values of the contract: weights by turns, the most that a source is repeated, and what parts words.
WEIGHTS = (5, 2, 1)
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Words of a block; slots of a shard; slots made in one go, and in a task; rows of a source's bucket, about, and the
#: most buckets; shards of a group; rounds of a permutation.
BLOCK = 128
SHARD = 1024
CHUNK = 1 << 14
TASK = 1 << 16
BUCKET = 256
BUCKETS = 1 << 20
GROUP = 1 << 12
ROUNDS = 24


def permuted(x: Column, n: Column, *keys: Column, inverse: bool = False) -> Column:
    """The place of x, 0 <= x < n, under a pseudorandom permutation of 0 to n - 1 that the keys choose.

    Swap-or-not: in each round x may change places with a partner, as a hash of the greater of the two says. Each
    round is its own inverse, so this permutes any n without walks or tables, and its rounds in reverse undo it.
    """

    def step(at: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*keys, i, F.lit(1)), n) - at, n)
        swap = F.xxhash64(*keys, i, F.greatest(at, partner), F.lit(2)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x.cast("bigint"), step)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, sid, weight, target) from (source, size): one row for each source, null among them.

    Sources by code point, null last, weigh 5, 2, 1 by turns and share all words. A target stops at three times its
    source, and what is over is shared among the others by weight until none is above: the level that fills them all
    is found in one pass over the sources, in order of the share at which each is full. One row for each source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*map(F.lit, WEIGHTS))
    numbered = sums.withColumn("sid", F.row_number().over(order).cast("bigint") - 1)
    numbered = numbered.withColumn("weight", F.element_at(weights, (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    full = (F.col("source_size") * REPEATS).cast("double")
    numbered = numbered.withColumn("full_at", full / F.col("weight"))
    by_level = Window.orderBy("full_at", "sid")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    above = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(every).cast("double")
    # the level if just those before this one are full; right at the first one that it doesn't fill
    level = (whole - F.coalesce(F.sum(full).over(below), F.lit(0.0))) / F.sum("weight").over(above)
    numbered = numbered.withColumn("_level", F.when(level <= F.col("full_at"), level))
    numbered = numbered.withColumn("_level", F.first("_level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(full, F.coalesce(F.col("_level") * F.col("weight"), full))
    return numbered.select("source", "source_size", "sid", "weight", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """``placed``: the documents' kept columns, size, sid and start (the place in the source's stream), a written table;
    ``sources``: the targets, with blocks, whole epochs and the words left for the last one."""

    placed: DataFrame
    sources: DataFrame
    seed: int

    @classmethod
    def of(cls, docs: DataFrame, keep: list[str], source: str = "source", text: str = "text", seed: int = 1) -> Mix:
        """A null text has no words and is taken 0 times; null is a source like any other; repeated rows are documents
        of their own. With no words at all, or no rows, targets are 0 and nothing is taken. Other columns don't matter.
        """
        content = F.col(text)
        sized = docs.select(F.struct(*keep).alias("kept"), F.col(source).alias("source"), F.coalesce(F.regexp_count(content, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.coalesce(content, F.lit("")), F.struct(*keep), F.lit(seed)).alias("mark"))
        sized = stored(sized, "sized")
        sources = stored(source_targets(sized), "sources")
        buckets = min(BUCKETS, max(16, sized.count() // BUCKET))
        dealt = sized.withColumn("bucket", F.pmod("mark", F.lit(buckets)))
        sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        base = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
        bases = sums.select("source", "bucket", base.alias("base")).join(sources.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "sid")
        own = Window.partitionBy("source", "bucket").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = dealt.withColumn("local", F.sum("size").over(own) - F.col("size"))
        placed = local.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("kept", "size", "sid", (F.col("base") + F.col("local")).alias("start"))
        left = F.round("target").cast("bigint")
        epochs = F.when(F.col("source_size") > 0, F.floor(left / F.col("source_size"))).otherwise(0).cast("bigint")
        sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("bigint")).withColumn("epochs", epochs).withColumn("rest", left - F.col("epochs") * F.col("source_size"))
        return cls(stored(placed, "placed"), sources, seed)

    def segments(self) -> DataFrame:
        """(sid, block, start, from, upto): the words of each document's part of each block, counted in the block."""
        first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
        cut = self.placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        origin = F.col("block") * BLOCK
        return cut.select("sid", "block", "start", F.greatest(F.col("start") - origin, F.lit(0)).alias("from"), F.least(F.col("start") + F.col("size") - origin, F.lit(BLOCK)).alias("upto"))

    def slots(self) -> DataFrame:
        """(shard, sid, rank): every slot of the output. Counts of sources are drawn for each shard, then ranked.

        A shard's counts are a multinomial draw given the quotas, made slot by slot; prefix sums go through groups of shards.
        """
        partial = F.when(F.col("rest") > 0, F.least(F.col("blocks"), F.ceil(F.col("rest") / F.lit(BLOCK)) + 1)).otherwise(0).cast("bigint")
        quotas = self.sources.withColumn("quota", F.col("epochs") * F.col("blocks") + partial).where("quota > 0")
        running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        quotas = quotas.withColumn("offset", F.sum("quota").over(running) - F.col("quota")).withColumn("all", F.sum("quota").over(every))
        chunks = quotas.select("sid", "offset", "quota", "all", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / CHUNK))).alias("chunk"))
        # named numbers of tasks: a row here stands for thousands of slots, which planning by bytes can't see
        chunks = chunks.repartition(self._tasks(), F.col("sid"), F.col("chunk"))
        drawn = chunks.select("sid", "all", F.explode(F.sequence(F.col("offset") + F.col("chunk") * CHUNK, F.col("offset") + F.least(F.col("quota"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("place"))
        shard = F.floor(permuted(F.col("place"), F.col("all"), F.lit(self.seed), F.lit(-1)) / F.lit(SHARD))
        counts = stored(drawn.select("sid", shard.alias("shard")).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("count")), "draws")
        counts = counts.withColumn("group", F.floor(F.col("shard") / GROUP))
        sums = counts.groupBy("sid", "group").agg(F.sum("count").alias("inside"))
        first = F.sum("inside").over(Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("inside")
        bases = sums.select(F.col("sid").alias("s"), F.col("group").alias("g"), first.alias("base"))
        local = F.sum("count").over(Window.partitionBy("sid", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
        ranked = counts.withColumn("local", local).join(bases, (F.col("sid") == F.col("s")) & (F.col("group") == F.col("g")))
        ranked = ranked.select("shard", "sid", (F.col("base") + F.col("local")).alias("first"), "count").repartition(self._tasks(), F.col("sid"), F.col("shard"))
        return ranked.select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("rank"))

    def _tasks(self) -> int:
        """For all slots, TASK of them to a task; no fewer than the cluster runs at a time."""
        words = self.sources.agg(F.sum("target").alias("n")).first().n or 0
        return int(max(self.placed.sparkSession.sparkContext.defaultParallelism, words // (BLOCK * TASK) + 1))

    def draws(self) -> DataFrame:
        """(shard, sid, epoch, block, words): the block that fills each slot, and how many of its words are taken.

        Only a source's last slots can be cut or empty, and empty ones are left out. In the last epoch the words
        before a slot are those of its rank, less what the short block lacks if it came earlier.
        """
        size = F.least(F.lit(BLOCK).cast("bigint"), F.col("source_size") - F.col("block") * BLOCK)
        lacking = F.col("blocks") * BLOCK - F.col("source_size")
        joined = self.slots().join(self.sources.select("sid", "source_size", "blocks", "epochs", "rest"), "sid")
        epoch = F.floor(F.col("rank") / F.col("blocks"))
        placed = joined.withColumn("epoch", epoch).withColumn("at", F.col("rank") % F.col("blocks"))
        placed = placed.withColumn("block", permuted(F.col("at"), F.col("blocks"), F.lit(self.seed), F.col("sid"), F.col("epoch")))
        short = self._short_places()
        known = placed.join(short, "sid")
        before = F.col("at") * BLOCK - F.when(F.col("short_at") < F.col("at"), lacking).otherwise(0)
        words = F.when(F.col("epoch") < F.col("epochs"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("rest") - before)))
        return known.select("shard", "sid", "epoch", "block", words.alias("words")).where("words > 0")

    def _short_places(self) -> DataFrame:
        """(sid, short_at): the place of the last, shorter block in a source's last epoch, by the inverse permutation."""
        at = permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(self.seed), F.col("sid"), F.col("epochs"), inverse=True)
        return self.sources.where("blocks > 0").select("sid", at.alias("short_at"))

    def parts(self) -> DataFrame:
        """(sid, start, epoch, from, upto): the words that the mix takes of each document, counted in the document."""
        taken = self.draws().select(F.col("sid").alias("s"), F.col("block").alias("b"), "epoch", "words")
        met = self.segments().join(taken, (F.col("sid") == F.col("s")) & (F.col("block") == F.col("b")))
        origin = F.col("block") * BLOCK - F.col("start")
        return met.where("words > from").select("sid", "start", "epoch", (F.col("from") + origin).alias("from"), (F.least("upto", "words") + origin).alias("upto"))

    def taken(self) -> DataFrame:
        """The kept columns of every document, size, source_size, target and taken, the words the mix takes of it."""
        sums = self.parts().groupBy(F.col("sid").alias("s"), F.col("start").alias("at")).agg(F.sum(F.col("upto") - F.col("from")).alias("taken"))
        met = self.placed.join(sums, (F.col("sid") == F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
        targets = self.sources.select(F.col("sid").alias("k"), "source_size", "target")
        return met.join(targets, F.col("sid") == F.col("k")).select("kept.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))

    def texts(self, docs: DataFrame, text: str) -> DataFrame:
        """The rows of ``docs`` for each epoch, ``text`` cut to the words that the mix takes in that epoch; none, no row.

        A document that an epoch takes whole keeps its text as it is; otherwise words keep the white space behind them.
        The mix must be of ``identified(docs)`` and keep the identity: texts stay where they are until what is taken of
        them is known, and are then dealt once.
        """
        parts, whole, tokens = (unused(docs, x) for x in ("parts", "whole", "tokens"))
        ranges = self.parts().groupBy(F.col("sid").alias("s"), F.col("start").alias("at"), "epoch").agg(F.sort_array(F.collect_list(F.struct("from", "upto"))).alias(parts), F.sum(F.col("upto") - F.col("from")).alias("taken"))
        met = self.placed.join(ranges, (F.col("sid") == F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0))
        taken = met.select(*[F.col(f"kept.{c}").alias(c) for c in ROW], parts, (F.col("taken") == F.col("size")).alias(whole))
        rows = once(identified(docs)).join(taken, ROW)
        rows = rows.withColumn(tokens, F.when(~F.col(whole), F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))))
        some = F.array_join(F.flatten(F.transform(parts, lambda r: F.slice(F.col(tokens), (r["from"] + 1).cast("int"), (r.upto - r["from"]).cast("int")))), "")
        return rows.select(*[F.when(F.col(whole), F.col(text)).otherwise(some).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])

    def blocks(self, text: str) -> DataFrame:
        """(shard, sid, epoch, block, text): the output itself, each slot with the text of its block, cut to its words.

        A line end parts documents that share a block.
        """
        tokens = F.regexp_extract_all(F.concat(F.col(f"kept.{text}"), F.lit("\n")), F.lit(TOKEN), F.lit(0))
        own = self.placed.where("size > 0").select(F.col("sid").alias("s"), F.col("start").alias("at"), tokens.alias("tokens"))
        cut = self.segments().join(own, (F.col("sid") == F.col("s")) & (F.col("start") == F.col("at")))
        first = F.col("block") * BLOCK + F.col("from") - F.col("start") + 1
        parts = cut.select("sid", "block", F.struct("from", F.slice("tokens", first.cast("int"), (F.col("upto") - F.col("from")).cast("int")).alias("tokens")).alias("part"))
        packed = parts.groupBy("sid", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x.tokens)).alias("tokens"))
        return self.draws().join(packed, ["sid", "block"]).select("shard", "sid", "epoch", "block", F.array_join(F.slice("tokens", F.lit(1), F.col("words").cast("int")), "").alias("text"))
