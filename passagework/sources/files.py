"""Files of texts, JSON lines, metrics and models.  Parquet, CSV, ORC and JDBC come with Spark.

Paths are those of Spark, on any file system that the session knows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def training_texts(spark: SparkSession, data: str | list[str], max_samples: int | None = None) -> DataFrame:
    """(text) from a list, a .jsonl.gz file (records with text; bad lines are skipped) or a plain file (``lines_with_ends``)."""
    if not isinstance(data, str):
        rows = spark.createDataFrame([(t,) for t in data], "text string")
    elif data.endswith(".jsonl.gz"):
        rows = spark.read.schema("text string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(data).where("text is not null").select("text")
    else:
        rows = lines_with_ends(spark, data)
    return rows.limit(max_samples) if max_samples is not None else rows


def lines_with_ends(spark: SparkSession, path: str) -> DataFrame:
    """(text): the lines of plain files with their ends, which are "\\n" whatever stands there (\\n, \\r\\n or \\r); a last line without an end has none.

    Files are split like any text source, however large.  Whether a file's last line has
    an end follows from the bytes of all of its lines against its size, and which line
    is the last from the file's last block; one more scan finds out.  Compressed files,
    which cannot be split and do not tell their size, are read whole.
    """
    if path.rsplit(".", 1)[-1] in ("gz", "bz2", "zst", "deflate", "lz4", "snappy"):
        rows = spark.read.text(path, wholetext=True).withColumn("_end", F.lit(""))
    else:
        m = "_metadata"
        rows = spark.read.text(path, lineSep="\n").select(
            "value", F.monotonically_increasing_id().alias("_id"), F.col(f"{m}.file_path").alias("_file"), F.col(f"{m}.file_size").alias("_size"),
            (F.col(f"{m}.file_block_start") + F.col(f"{m}.file_block_length")).alias("_upto"),
        )
        # the last line of a file may have begun in a block before the last: ids grow along a file's blocks in a task, blocks by their ends
        files = rows.groupBy("_file").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size"), F.max_by("_id", F.struct("_upto", "_id")).alias("_id"))
        bare = files.where("_bytes > _size").select("_file", "_id", F.lit("").alias("_end"))
        rows = rows.join(bare, ["_file", "_id"], "left").withColumn("_end", F.coalesce("_end", F.lit("\n")))
    text = F.regexp_replace(F.concat("value", "_end"), "\r\n?", "\n")
    return rows.select(F.explode(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))).alias("text"))


def load_jsonl(spark: SparkSession, path: str, key: str = "text", max_samples: int | None = None) -> DataFrame:
    """(text) of one key, empty where it is missing; bad lines fail."""
    lines = spark.read.text(path)
    lines = lines.limit(max_samples) if max_samples is not None else lines
    parsed = lines.select(F.from_json("value", f"`{key}` string", {"mode": "FAILFAST"}).alias("r"))
    return parsed.select(F.coalesce(F.col("r")[key], F.lit("")).alias("text"))


def save_jsonl(rows: DataFrame, path: str, compress: bool = True) -> None:
    rows.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def read_text_file(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(text) of whole files, one row each; encodings are those of Spark's decode."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("text"))


def write_text_file(rows: DataFrame, path: str, column: str = "text", encoding: str = "utf-8") -> None:
    """One line per row, in a folder of part files."""
    rows.select(column).write.mode("overwrite").option("encoding", encoding).csv(path, quote="", escape="", sep="\x01", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def evaluation_texts(spark: SparkSession, data: str | list[str], max_samples: int | None = None) -> DataFrame:
    """Annotated texts to evaluate on, read as ``training_texts`` are."""
    return training_texts(spark, data, max_samples)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """One row of figures as indented JSON, in a folder."""
    write_document(metrics.sparkSession, json.dumps(metrics.first().asDict(), indent=2), path)


def write_document(spark: SparkSession, document: str, path: str) -> None:
    """A short document as one part file of a folder; replaces what was there."""
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def registered(spark: SparkSession, models: str, name: str) -> str:
    """Folder of a named model below a folder of models."""
    path = f"{models.rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no model {name!r} in {models}")
    return path
