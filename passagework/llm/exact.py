"""Exact duplicates by a log-structured merge index, in DataFrame operations alone.

Memtables: each task sorts the digests of the texts that it read and flushes them
as a run, a Parquet file sorted by digest with a Bloom filter and row-group bounds
on the digest, in the shared folder.  Compaction merges the runs by digest, keeps
the smallest identifier (or the largest, as asked) and counts; partial sums before
the shuffle take the heat off a digest that many rows share.  A later batch merges
into an index that exists: a bit filter of the batch's digests, sized by their count,
tells which rows of the index it may touch, and all others stay where they are.
Hits, which are rows whose digest others share, are found again through such a filter
and verified byte for byte: the least and the greatest text of a digest must be equal.
Digests that hold different texts are split by the texts themselves.  Lookups of
single digests read only the row groups that the files' own filters leave.

Defined results: null text counts as empty, and empty texts equal each other.
A-Z only are lower-cased.  Rows that repeat a doc_id count in group_size and share
its flags; a null doc_id counts as smaller than all others.  An empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, one_row_each, small_or_shuffled

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str | Column) -> Column:
    """Text with A-Z in lower case and all else as it was; null as empty.

    lower() is far cheaper than translate(), and is the same where all characters are
    in Latin-1 and none of them is one of its capitals outside ASCII.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    other = c.rlike(r"[\x{C0}-\x{DE}\x{100}-\x{10FFFF}]")
    return F.when(other, F.translate(c, _UPPER, _UPPER.lower())).otherwise(F.lower(c))


def digest(norm: Column, bits: int = 256) -> Column:
    """SHA-256 in lower-case hex; fewer bits only to try out digests that collide."""
    return F.sha2(norm.cast("binary"), 256) if bits >= 256 else F.substring(F.sha2(norm.cast("binary"), 256), 1, max(1, bits // 4))


def flush(docs: DataFrame, folder: str, bits: int = 256) -> DataFrame:
    """Write one sorted run per task: (doc_id, text_sha256, digest)."""
    norm = docs.select("doc_id", normalised("text").alias("norm"))
    sha = norm.select("doc_id", digest(F.col("norm")).alias("text_sha256"))
    keyed = sha.withColumn("digest", F.col("text_sha256") if bits >= 256 else F.substring("text_sha256", 1, max(1, bits // 4)))
    columns = ("doc_id", "digest") if bits >= 256 else ("doc_id", "digest", "text_sha256")
    keyed.select(*columns).sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(folder)
    runs = docs.sparkSession.read.parquet(folder)
    return runs.select("doc_id", "digest", (F.col("digest") if bits >= 256 else F.col("text_sha256")).alias("text_sha256"))


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """(digest, keep_id, group_size) of all runs; keep is min or max."""
    best = F.min("doc_id") if keep == "min" else F.max("doc_id")
    return runs.groupBy("digest").agg(best.alias("keep_id"), F.count("*").alias("group_size"))


def _best(keep: str) -> Column:
    return F.min("keep_id") if keep == "min" else F.max("keep_id")


def merge(index: DataFrame, batch: DataFrame, keep: str = "min") -> DataFrame:
    """An index (digest, keep_id, group_size) with that of a later batch merged into it.

    Rows of the index that the batch's filter cannot hold are passed on as they are;
    only the others are grouped with the batch.
    """
    bits, words = bit_filter(batch)
    held = _probed(index, bits, words)
    apart = held.where(~F.col("held")).drop("held")
    both = held.where("held").drop("held").unionByName(batch).groupBy("digest")
    return apart.unionByName(both.agg(_best(keep).alias("keep_id"), F.sum("group_size").alias("group_size")).select(*index.columns))


def written(index: DataFrame, folder: str) -> DataFrame:
    """The index as sorted files of digest ranges, each with a Bloom filter."""
    index.repartitionByRange("digest").sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(folder)
    return index.sparkSession.read.parquet(folder)


def lookup(index: DataFrame, digests: list[str]) -> DataFrame:
    """The index rows of a few digests: bounds and Bloom filters of the files decide which row groups are read."""
    return index.where(F.col("digest").isin(digests))


def _slot(words: int) -> tuple[Column, Column]:
    """The filter's word of a digest, and the bits that it sets there."""
    h = F.xxhash64("digest")
    mask = F.lit(0).cast("long")
    for shift in (0, 6, 12):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(words)), mask


def bit_filter(digests: DataFrame, most_words: int = 1 << 20) -> tuple[DataFrame, int]:
    """(slot, bits) of a filter of the digests and its number of words: four digests a word, at most most_words words.

    That bound is what a task can be sent; a fuller filter holds more that it should
    not, and loses nothing.
    """
    words = 1 << 10
    n = digests.count()
    while words < most_words and words * 4 < n:
        words *= 2
    slot, mask = _slot(words)
    return digests.select(slot.alias("slot"), mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("bits")), words


def _probed(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """rows with a digest, and whether the filter may hold it (column held)."""
    slot, mask = _slot(words)
    out = rows.withColumns({"slot": slot, "mask": mask}).join(F.broadcast(bits), "slot", "left")
    return out.withColumn("held", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("slot", "mask", "bits")


#: Rows of one digest from which on it is joined apart from the others.
_HOT = 100_000


def _flagged(runs: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of the runs with the index's columns; digests of very many rows, which are few, do not go through the shuffle."""
    hot = index.where(F.col("group_size") > _HOT)
    if not hot.limit(1).count():
        return runs.join(index, "digest")
    cold = runs.join(small_or_shuffled(hot.select("digest"), 100_000), "digest", "left_anti").join(index.where(F.col("group_size") <= _HOT), "digest")
    return runs.join(small_or_shuffled(hot, 100_000), "digest").select(*cold.columns).unionByName(cold)


def duplicates(docs: DataFrame, keep: str = "min", bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    keep: whether the smallest or the largest doc_id of equal texts stays.  bits of the
    digest are fewer than 256 only to try out digests that collide.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    runs = flush(docs, folder, bits)
    index = cut(compact(runs, keep))
    shared = index.where("group_size > 1").select("digest")
    texts = docs.select("doc_id", normalised("text").alias("norm")).withColumn("digest", digest(F.col("norm"), bits))
    hits = _probed(texts, *bit_filter(shared)).where("held")
    verified = hits.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    wrong = cut(verified.where("least <> most").select("digest"))
    out = _flagged(runs, index).select("doc_id", "keep_id", "group_size", "text_sha256", "digest")
    if wrong.limit(1).count():
        apart = texts.join(wrong, "digest")
        best = F.min("doc_id") if keep == "min" else F.max("doc_id")
        groups = apart.groupBy("norm").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        apart = apart.join(groups, "norm").select("doc_id", "keep_id", "group_size", digest(F.col("norm")).alias("text_sha256"))
        out = out.join(wrong, "digest", "left_anti").drop("digest").unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest doc_id of equal texts), group_size, kept, text_sha256."""
    return duplicates(docs, keep="max")


def keep_last_copy(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, of those with the largest doc_id; columns stay as they are."""
    kept = duplicates(docs, keep="max").where("kept").select("doc_id", F.col("text_sha256").alias("mark")).distinct()
    return one_row_each(docs, kept, digest(normalised("text")))


OP9_SQL = f"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
