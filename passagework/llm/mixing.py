"""Mixing sources to target weights, in DataFrame operations alone.

Every source's words, documents laid end to end in a pseudorandom order, are packed
into blocks of fixed length.  The mix is a row of slots of one block each, cut into
output shards.  The draw is multinomial by shard with the targets as weights, given
that every source's total is its quota: a keyed permutation of all slots deals them
to the sources' stretches of a line as long as all quotas, which makes the counts of
every shard, the first and the last alike, a sample without replacement.  The k-th
slot of a source takes the block to which a keyed permutation of the source's blocks
sends k, round after round, so that no block is taken more often than the largest
ratio of target to size allows.  Slots and blocks are joined by source and index.

Permutations are swap-or-not shuffles, exact on any number of indexes, and undone by
their rounds in reverse.  Slots are made where they are counted, in chunks of bounded
size, so no source is one task's; only one row per source is ever sorted in one task.

Defined results: null text has size 0; null is a source of its own, the last one.
A source without words has target 0.  Repeated rows are documents of their own, and
each gets a row.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small_or_shuffled

#: About how many documents of a source are ordered in one task.
_PART = 1 << 12
#: Slots that become rows in one go.
_CHUNK = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from one row per source: weights repeat in code point order, null last.

    The share by weight is filled level by level: sources whose cap lies under the
    level stop there, and the rest goes on by weight.  One row per source is sorted
    in one task; the number of sources is that of the crawl's feeds, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int") + 1).cast("double"))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    up = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    # the level at which the sources from this one on share what the earlier caps leave
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = weighted.withColumn("level", level)
    # the level rises up to the last source that its cap stops, and falls after it
    met = levelled.withColumn("final", F.max("level").over(everything))
    return met.select("source", "source_size", F.least(F.col("cap"), F.coalesce("final", F.lit(0.0)) * F.col("weight")).alias("target"))


def mirrors(n: Column, key: Column, rounds: int = 12) -> Column:
    """The keyed points about which the rounds of a permutation of n indexes mirror them."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(key, r), n))


def permuted(k: Column, n: Column, key: Column, points: Column) -> Column:
    """The place of k (0 to n-1) under a keyed permutation of n indexes, with the points of ``mirrors``.

    A swap-or-not shuffle: in each round an index and its mirror image change places
    or not, by a hash of the larger of the two.  Reversed points undo it.
    """

    def step(x: Column, point: Column) -> Column:
        image = F.when(x <= point, point - x).otherwise(point - x + n)
        return F.when(F.xxhash64(key, point, F.greatest(x, image)).bitwiseAND(F.lit(1).cast("long")) == 1, image).otherwise(x)

    return F.aggregate(points, k.cast("long"), step)


def quotas(sources: DataFrame, block: int = 64, cap: float = 3.0) -> DataFrame:
    """(source, source_size, rows, target, blocks, quota, start): slots of each source, and where its stretch of the line begins."""
    plan = targets(sources, cap).join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # whole blocks of a source, its last one may be short; slots to fill by target
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    # counted in the source's mean block, so that whole rounds meet the cap to the word
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("quota", F.least(F.round(share), F.floor(F.lit(cap) * F.col("blocks"))).cast("long"))
    plan = plan.withColumn("quota", F.when((F.col("quota") == 0) & (F.col("target") > 0), F.lit(1).cast("long")).otherwise(F.col("quota")))
    return plan.withColumn("start", F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota"))


def slots(plan: DataFrame, slots_per_shard: int = 4096, seed: int = 1) -> DataFrame:
    """(source, shard, index), one row per slot of the mix: the shard that it is in and the block that it takes; plan as ``quotas`` gives it."""
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    if not total:
        return plan.select("source", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("index")).limit(0)
    n, key = F.lit(total).cast("long"), F.lit(seed).cast("long")
    # a source's slots go round its blocks again and again, each time in another order
    rounds = plan.where("quota > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("blocks")))))
    rounds = rounds.withColumn("size", F.least(F.col("blocks"), F.col("quota") - F.col("round") * F.col("blocks")))
    chunks = rounds.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / _CHUNK))))
    tasks = max(plan.sparkSession.sparkContext.defaultParallelism, int(min(100_000, total // (4 * _CHUNK) + 1)))
    chunks = chunks.repartition(tasks, "source", "round", "chunk")
    own = F.xxhash64("source", "round", F.lit(seed))
    chunks = chunks.withColumn("key", own).withColumn("points", mirrors(F.col("blocks"), F.col("key"))).withColumn("all", F.reverse(mirrors(n, key)))
    last = F.least(F.col("size"), (F.col("chunk") + 1) * _CHUNK) - 1
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * _CHUNK, last)))
    place = permuted(F.col("start") + F.col("round") * F.col("blocks") + F.col("k"), n, key, F.col("all"))
    return each.select("source", F.floor(place / slots_per_shard).alias("shard"), permuted(F.col("k"), F.col("blocks"), F.col("key"), F.col("points")).alias("index"))


def shard_counts(drawn: DataFrame) -> DataFrame:
    """(shard, source, n): how many slots of each shard the sources have."""
    return drawn.groupBy("shard", "source").agg(F.count("*").alias("n"))


def mix(docs: DataFrame, block: int = 64, slots_per_shard: int = 4096, cap: float = 3.0, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard), one row per row of docs.

    block: words in a block.  slots_per_shard: slots of an output shard.  first_shard:
    the first output shard with words of the document, null where it has none.
    """
    rows = cut(sizes(docs).withColumn("order", F.xxhash64("doc_id", F.lit(seed))))
    plan = cut(quotas(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), block, cap))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    known = small_or_shuffled(plan.select("source", "source_size", "target", F.ceil(F.col("rows") / _PART).alias("parts")), 100_000)
    # documents of a source are dealt by hash into parts of about equal size, and ordered in each
    parted = rows.join(known, same(rows, known)).select("doc_id", rows["source"], "size", "order", "source_size", "target", F.pmod("order", "parts").alias("part"))
    in_part = Window.partitionBy("source", "part").orderBy("order", "doc_id", "size")
    starts = parted.groupBy("source", "part").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words"))
    keyed = parted.withColumn("nth", F.row_number().over(in_part)).withColumn("within", F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = keyed.join(starts, same(keyed, starts) & (keyed["part"] == starts["part"])).select(
        keyed["doc_id"], keyed["source"], keyed["part"], "nth", "size", "source_size", "target", (F.col("base") + F.col("within")).alias("start")
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").withColumn("index", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    inside = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("start"), F.col("index") * block)
    pieces = pieces.select("source", "part", "nth", "index", inside.alias("inside"))
    # one row for each block of the corpus: Spark takes what is exploded from the plan's few rows for small and would send it whole through the driver
    taken = slots(plan, slots_per_shard, seed).groupBy("source", "index").agg(F.count("*").alias("times"), F.min("shard").alias("shard")).hint("merge")
    got = pieces.join(taken, same(pieces, taken) & (pieces["index"] == taken["index"])).groupBy(pieces["source"].alias("s"), "part", "nth")
    got = got.agg(F.sum(F.col("inside") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    out = placed.join(got, placed["source"].eqNullSafe(got["s"]) & (placed["part"] == got["part"]) & (placed["nth"] == got["nth"]), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def op3_mixing(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_shard."""
    return mix(docs)
