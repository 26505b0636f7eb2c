"""Annotated texts: in-band tags to clean text and boundaries, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import running, surroundings
from .features import reach, with_features

SENTENCE_TAG, PARAGRAPH_TAG = "<|sentence|>", "<|paragraph|>"
_TAG = r"<\|(?:sentence|paragraph)\|>"


def _pieces(annotated: str | Column) -> Column:
    c = F.col(annotated) if isinstance(annotated, str) else annotated
    return F.split(F.coalesce(c, F.lit("")), _TAG, -1)


def clean_text(annotated: str | Column) -> Column:
    return F.array_join(_pieces(annotated), "")


def boundaries(annotated: str | Column) -> Column:
    """Sorted distinct places right after a tagged character; tags before any text mark nothing."""
    pieces = _pieces(annotated)
    inner = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    # an empty piece stands between two tags and repeats a place
    return F.filter(F.array_distinct(running(inner)), lambda at: at > 0)


def annotate(sentences: str | Column) -> Column:
    """Each sentence of an array with a sentence tag, and one paragraph tag at the end; nothing for none."""
    c = F.col(sentences) if isinstance(sentences, str) else sentences
    tagged = F.array_join(F.transform(c, lambda s: F.concat(s, F.lit(SENTENCE_TAG))), "")
    return F.when(F.size(c) > 0, F.concat(tagged, F.lit(PARAGRAPH_TAG))).otherwise("")


def character_labels(annotated: str | Column) -> Column:
    """1 for every character of the clean text that a tag follows, else 0."""
    pieces = _pieces(annotated)
    ends = lambda p, i: F.when(i < F.size(pieces) - 1, 1).otherwise(0)
    return F.flatten(F.transform(pieces, lambda p, i: F.when(F.length(p) > 0, F.concat(F.array_repeat(F.lit(0), F.length(p) - 1), F.array(ends(p, i)))).otherwise(F.array().cast("array<int>"))))


def labelled_characters(docs: DataFrame, abbreviations: list[str], left: int = 5, right: int = 5, annotated: str = "text", mode: str = "full") -> DataFrame:
    """Every character of the clean text: the other columns of docs, pos, c, label, features."""
    others = [c for c in docs.columns if c != annotated]
    clean = docs.select(*others, clean_text(annotated).alias("_text"), character_labels(annotated).alias("_labels"))
    places = surroundings(clean, "_text", True, left, right, mode, reach(abbreviations), F.col("_labels")).drop("_labels").withColumnRenamed("mark", "label")
    return with_features(places, abbreviations, left, right)
