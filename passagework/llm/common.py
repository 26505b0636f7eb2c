"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one that the session names in spark.checkpoint.dir.

    Where it names none, only a local master may go on, with a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="passagework-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 where the id is null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(-1))


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast df where its counted rows are at most max_rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table to the shared checkpoint folder, and its path for ``discard``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ``scratch`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame):
    """Rows of bounded number as a pandas frame, by way of Arrow, which holds them far more compactly than rows do."""
    return df.toArrow().to_pandas()


def one_row_each(docs: DataFrame, kept: DataFrame, mark: Column) -> DataFrame:
    """One row of docs for each row of kept (doc_id, mark), which has none twice; columns stay as they are.

    mark tells apart the rows of docs that repeat a doc_id; where none does, the doc_id alone will do.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        ids = kept.select("doc_id")
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    name = fresh(docs, "row_")
    key = lambda m: F.concat(m.cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit("")))
    # repeats are dropped first, and in each task before the shuffle, so that a row repeated often is no heat
    rows = docs.withColumn(name, key(mark)).dropDuplicates([name])
    return rows.join(kept.select(key(F.col("mark")).alias(name)), name, "left_semi").drop(name)
