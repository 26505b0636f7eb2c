"""Abbreviation lists as one-column tables; stateless, so no cache outlives an edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A short default; a full list is a table or file of the user's.
DEFAULT = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Sr.", "Jr.", "St.", "vs.", "etc.", "e.g.", "i.e.", "Inc.", "Ltd.", "Corp.", "Co.", "No.", "U.S.", "D.C.", "v.", "Fig.", "al.")


def table(spark: SparkSession, entries: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(e,) for e in dict.fromkeys(DEFAULT if entries is None else entries)], "abbr string")


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """One abbreviation a line."""
    return spark.read.text(path).select(F.col("value").alias("abbr")).where("abbr <> ''").distinct()


def add(abbreviations: DataFrame, entry: str) -> DataFrame:
    """With one more entry, to which a full stop is added if it has none."""
    entry = entry if entry.endswith(".") else entry + "."
    return abbreviations.unionByName(abbreviations.sparkSession.createDataFrame([(entry,)], "abbr string")).distinct()


def remove(abbreviations: DataFrame, entry: str) -> tuple[DataFrame, bool]:
    """Without the entry, and whether it was there."""
    there = bool(abbreviations.where(F.col("abbr") == entry).limit(1).count())
    return abbreviations.where(F.col("abbr") != entry), there


#: Characters of a table that is sent to the tasks; a larger one is joined by a shuffle.
SENT = 32_000_000


def marked(places: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Rows of ``surroundings`` (with a reach of the longest entry) with _known: 1 where a full stop ends a run in the table, of any size.

    Only the runs of full stops take part in the join.  The table is sent to the tasks
    if its characters, counted first, are few; otherwise distinct runs meet it in a
    shuffle, so that a run that stands everywhere is no heat, and only those known go
    back to the places.
    """
    entries = abbreviations.select(F.col("abbr").alias("_run")).where("_run is not null").distinct()
    size = entries.agg(F.coalesce(F.max(F.length("_run")), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.octet_length("_run")), F.lit(0)).alias("bytes")).first()
    run = F.when(F.col("c") == ".", F.concat(F.regexp_extract(F.right("before", F.lit(size["longest"])), r"[\p{L}\p{N}.]*\z", 0), F.col("c")))
    rows = places.withColumn("_run", run)
    if size["bytes"] <= SENT:
        known = F.broadcast(entries)
    else:
        known = rows.select("_run").where("_run is not null").distinct().join(entries, "_run", "left_semi")
    return rows.join(known.withColumn("_known", F.lit(1)), "_run", "left").drop("_run").withColumn("_known", F.coalesce("_known", F.lit(0)))


def longest(abbreviations: DataFrame) -> int:
    return abbreviations.agg(F.coalesce(F.max(F.length("abbr")), F.lit(0))).first()[0]


def listed(abbreviations: DataFrame, most: int = 20_000) -> list[str]:
    """Sorted entries, for expressions; a list beyond the bound has to be joined instead."""
    rows = [r["abbr"] for r in abbreviations.select("abbr").distinct().orderBy("abbr").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} abbreviations")
    return rows
