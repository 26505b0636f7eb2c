"""Features of a place, from its surroundings: a window of codes and eight flags."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import BULLETS, CANDIDATES, CLOSING_QUOTES, LIST_CONJUNCTIONS, LIST_INTROS, LIST_MARKERS, OPENING_QUOTES, PADDING, PRIMARY, SECONDARY, SENTENCE_MARKS, SPACE, _PUNCTUATION, encode

FLAGS = ("abbreviation", "terminator", "balanced", "complete", "lower_next", "list_item", "semicolon_list", "near_colon")
_MARKER = "(?:" + "|".join(re.escape(m) for m in LIST_MARKERS) + ")"
_INTRO = "(?:" + "|".join(map(re.escape, LIST_INTROS)) + ")"
_CONJUNCTION = "(?:" + "|".join(map(re.escape, LIST_CONJUNCTIONS)) + ")"


@dataclass(frozen=True)
class Place:
    """The columns of one place: from rows of ``surroundings``, or from a struct of ``seen``."""

    before: Column
    after: Column
    c: Column
    quotes: dict[str, Column]

    @classmethod
    def of(cls, struct: Column | None = None) -> Place:
        get = F.col if struct is None else struct.getField
        return cls(get("before"), get("after"), get("c"), {n: get(n) for n in ("straight", "opened", "closed", "single", "single_opened", "single_closed")})

    def last(self, n: int | Column) -> Column:
        return F.right(self.before, F.lit(n) if isinstance(n, int) else n)

    @property
    def prev(self) -> Column:
        return F.substring(self.before, -1, 1)

    @property
    def next(self) -> Column:
        return F.substring(self.after, 2, 1)


def window(left: int, right: int, at: Place | None = None, code: Callable[[Column], Column] = encode) -> Column:
    """Codes, by any encoder, of the characters from left before to right after, padded as white space."""
    at = at or Place.of()
    padded = F.concat(
        F.transform(F.sequence(F.lit(-left), F.lit(right)), lambda k: F.when(k < 0, F.substring(at.before, F.length(at.before) + k + 1, F.lit(1))).otherwise(F.substring(at.after, k + 1, F.lit(1))))
    )
    inside = F.transform(padded, lambda c, i: F.when((i - left < -F.length(at.before)) | (i - left >= F.length(at.after)), F.lit(PADDING)).otherwise(code(c)))
    return inside


def abbreviation(entries: list[str] | Column, at: Place) -> Column:
    """1 where a full stop ends a run of letters, digits and stops that is a known abbreviation.

    entries: a list, an array column, or an integer column with the answer itself, as
    ``abbreviations.marked`` joins it from a table of any size.
    """
    if isinstance(entries, Known):
        return entries.flag
    run = F.concat(F.regexp_extract(at.last(longest(entries)), r"[\p{L}\p{N}.]*\z", 0), at.c)
    known = F.array_contains(entries, run) if isinstance(entries, Column) else run.isin(*entries) if entries else F.lit(False)
    return F.when((at.c == ".") & known, 1).otherwise(0)


@dataclass(frozen=True)
class Known:
    """Stands for a list of abbreviations where the answer is a column already."""

    flag: Column


def longest(entries: list[str] | Column) -> int | Column:
    """Characters of the longest entry, and so enough before a full stop to see that a run is longer than any."""
    return F.coalesce(F.array_max(F.transform(entries, F.length)), F.lit(0)) if isinstance(entries, Column) else max(map(len, entries), default=0)


def reach(entries: list[str]) -> int:
    """Characters around a place that its flags look at."""
    return max(50, longest(entries))


def terminator(at: Place) -> Column:
    return F.when(at.c.isin(*PRIMARY), 1).when(at.c.isin(*SECONDARY), -1).otherwise(0)


def balanced(at: Place) -> Column:
    even = (at.quotes["straight"] % 2 == 0) & (at.quotes["opened"] == at.quotes["closed"]) & (at.quotes["single"] % 2 == 0) & (at.quotes["single_opened"] == at.quotes["single_closed"])
    return F.when(~at.c.isin(*OPENING_QUOTES, *CLOSING_QUOTES) | even, 1).otherwise(0)


def complete(at: Place) -> Column:
    open_end = at.next.rlike(f"^(?:{SPACE}|{_PUNCTUATION})") | at.next.isin(*SENTENCE_MARKS)
    return F.when(at.c.isin(*CLOSING_QUOTES) & (at.next != "") & ~open_end & at.next.rlike(r"^\p{javaLowerCase}"), 0).otherwise(1)


def lower_next(at: Place) -> Column:
    return F.when(at.next.rlike(r"^\p{javaLowerCase}"), 1).otherwise(0)


def _among(c: Column, chars: str) -> Column:
    """Whether a character, possibly none, is one of chars; an empty string is not."""
    return c.isin(*chars)


def list_item(at: Place) -> Column:
    before = at.last(20)
    typical = _among(at.c, "()0123456789abcdefghijklmnopqrstuvwxyz." + BULLETS)
    inner = (at.before != "") & (F.length(at.after) > 1) & (_among(at.c, ".,;:") | _among(at.prev, ".,;:"))
    marked = at.before.rlike(_MARKER + r"\z") | at.after.rlike("^" + _MARKER)
    edge = _among(at.c, ".,;:()[]") | _among(at.prev, ".,;:()") | _among(at.next, ".,;:()[]")
    introduced = (F.length(before) >= 5) & F.substring(before, -5, 5).contains(":") & before.rlike(_INTRO)
    first = lambda conj: F.instr(F.substring(at.after, 1, 20), conj) - 1
    joined = F.lit(False)
    for conj in LIST_CONJUNCTIONS:
        where = first(conj)
        joined = joined | (where.between(1, 4) & F.substring(at.after, where, F.lit(1)).isin(";", ","))
    joined = (_among(at.c, ";,") | _among(at.prev, ";,")) & joined
    reachable = edge | _among(at.c, "0123456789abcdefghijklmnopqrstuvwxyz" + BULLETS)
    return F.when(reachable & (typical | inner) & (marked | (edge & (introduced | joined))), 1).otherwise(0)


def semicolon_list(at: Place) -> Column:
    before, after = at.last(50), F.substring(at.after, 1, 50)
    both = F.concat(before, after)
    several = F.length(both) - F.length(F.replace(both, F.lit(";"), F.lit(""))) >= 2
    return F.when((at.c == ";") & (several | both.rlike(_MARKER) | before.rlike(_INTRO) | after.rlike(_CONJUNCTION)), 1).otherwise(0)


def near_colon(at: Place, gated: bool = True) -> Column:
    """1 with a colon among the ten characters before; gated asks for one at or beside the place, too."""
    seen = at.last(10).contains(":")
    beside = (at.c == ":") | (at.prev == ":") | (at.next == ":")
    return F.when(seen & beside if gated else seen, 1).otherwise(0)


def flags(abbreviations: list[str] | Column, variant: str = "array", at: Place | None = None) -> list[Column]:
    """The eight flags in order; variant ``array`` gates the colon flag, ``list`` does not."""
    at = at or Place.of()
    found = (abbreviation(abbreviations, at), terminator(at), balanced(at), complete(at), lower_next(at), list_item(at), semicolon_list(at), near_colon(at, variant == "array"))
    return [f.alias(name) for f, name in zip(found, FLAGS, strict=True)]


def feature_count(left: int, right: int) -> int:
    return left + right + 1 + len(FLAGS)


def features(abbreviations: list[str] | Column, left: int = 5, right: int = 5, variant: str = "array", at: Place | None = None, code: Callable[[Column], Column] = encode) -> Column:
    """The window's codes, then the flags, as one array."""
    return F.concat(window(left, right, at, code), F.array(*flags(abbreviations, variant, at)))


def with_features(places: DataFrame, abbreviations: list[str] | Column | Known, left: int = 5, right: int = 5, variant: str = "array") -> DataFrame:
    """places with column features: the window's codes, then the flags."""
    keep = [c for c in places.columns if c not in ("before", "after", "straight", "opened", "closed", "single", "single_opened", "single_closed", "_known")]
    return places.select(*keep, features(abbreviations, left, right, variant).alias("features"))


def analysis(docs: DataFrame, abbreviations: list[str], left: int = 5, right: int = 5) -> tuple[DataFrame, DataFrame]:
    """A text analysis report: every character with its features and label, and one row of totals."""
    from .labels import labelled_characters

    rows = labelled_characters(docs, abbreviations, left, right)
    return rows, rows.agg(F.count("*").alias("characters"), F.coalesce(F.sum("label"), F.lit(0)).alias("boundaries"), F.count_if(F.col("c").isin(*CANDIDATES)).alias("candidates"))
