"""Features of places over whole Arrow batches: what ``features`` gives row by row, by arrays over all characters of many texts.

A table of classes of all code points, which Spark's own expressions fill once in a
session, decides about characters; windows, counts and flags are gathers and searches
among sorted places.  Only flags that look for words go place by place, and only where
a mark nearby lets them.  A test holds all of it to the expressions of ``features``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .chars import BULLETS, CANDIDATES, CLOSING_QUOTES, LIST_CONJUNCTIONS, LIST_INTROS, LIST_MARKERS, OPENING_QUOTES, PADDING, PRIMARY, SECONDARY, SENTENCE_MARKS, SPACE, _PUNCTUATION, _QUOTES, encode
from .features import _CONJUNCTION, _INTRO, _MARKER, FLAGS

#: About how many characters are described at once; a longer text alone.
CHARACTERS = 1 << 19
_POINTS = 0x110000
_TAIL = max(map(len, LIST_MARKERS))
#: Fixed sets of characters, a bit each; those of _BY_SPARK are added by Spark's expressions.
_SETS = {
    "candidate": CANDIDATES, "primary": PRIMARY, "secondary": SECONDARY, "quote": (*OPENING_QUOTES, *CLOSING_QUOTES), "closing": CLOSING_QUOTES, "stops": ".,;:", "around": ".,;:()[]", "before": ".,;:()",
    "listing": ";,", "typical": "()0123456789abcdefghijklmnopqrstuvwxyz." + BULLETS, "item": "0123456789abcdefghijklmnopqrstuvwxyz" + BULLETS, "bullet": BULLETS,
    "marker_begins": {m[0] for m in LIST_MARKERS}, "marker_ends": {m[-1] for m in LIST_MARKERS},
}
_BY_SPARK = ("run", "lower", "goes_on")
_BIT = {name: np.uint32(1 << i) for i, name in enumerate((*_SETS, *_BY_SPARK))}


@dataclass(frozen=True, eq=False)
class Classes:
    """Code and sets of every code point."""

    code: np.ndarray
    sets: np.ndarray


_made: dict[str, object] = {}


def classes(spark: SparkSession):
    """Broadcast of the classes, made once in a session."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        points = spark.range(_POINTS).where(~F.col("id").between(0xD800, 0xDFFF)).select("id", c.alias("c"))
        lower = F.col("c").rlike(r"^\p{javaLowerCase}")
        shut = F.col("c").rlike(f"^(?:{SPACE}|{_PUNCTUATION})") | F.col("c").isin(*SENTENCE_MARKS)
        told = points.select("id", encode(F.col("c")).alias("code"), F.col("c").rlike(r"^[\p{L}\p{N}.]").alias("run"), lower.alias("lower"), (lower & ~shut).alias("goes_on")).toArrow()
        at = told["id"].to_numpy()
        code, sets = np.full(_POINTS, -5, dtype=np.int32), np.zeros(_POINTS, dtype=np.uint32)
        code[at] = told["code"].to_numpy()
        for name in _BY_SPARK:
            sets[at] |= np.where(told[name].to_numpy(), _BIT[name], np.uint32(0))
        for name, chars in _SETS.items():
            sets[[ord(x) for x in chars]] |= _BIT[name]
        _made.clear()
        _made[app] = spark.sparkContext.broadcast(Classes(code, sets))
    return _made[app]


@dataclass(frozen=True)
class Look:
    """How places are seen, as in ``seen`` and ``features``; without flags, features are the window alone."""

    left: int
    right: int
    mode: str = "full"
    reach: int = 50
    abbreviations: tuple[str, ...] = ()
    variant: str = "array"
    flags: bool = True
    everywhere: bool = False

    @property
    def width(self) -> int:
        return self.left + self.right + 1 + (len(FLAGS) if self.flags else 0)


class Texts:
    """The characters of some texts, end to end."""

    def __init__(self, texts: list[str | None], known: Classes):
        each = [t or "" for t in texts]
        self.whole = "".join(each)
        self.points = np.frombuffer(self.whole.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.code, self.sets = known.code[self.points], known.sets[self.points]

    def places(self, everywhere: bool, also: np.ndarray | None = None) -> np.ndarray:
        """Candidates, and the places of also, or all characters; counted from the first text's start."""
        if everywhere:
            return np.arange(len(self.points))
        kept = (self.sets & _BIT["candidate"]) > 0
        if also is not None:
            kept[also] = True
        return np.flatnonzero(kept)

    def where(self, c: str) -> np.ndarray:
        return np.flatnonzero(self.points == ord(c)) if c in self.whole else np.zeros(0, dtype=np.int64)


def described(texts: Texts, look: Look, at: np.ndarray, carried: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text of each place, its features); carried as in ``seen``, an array for each name."""
    if look.mode not in ("reference", "full"):
        raise ValueError(f"unknown context mode {look.mode!r}")
    of = np.searchsorted(texts.ends, at, side="right")
    start, end, last = texts.starts[of], texts.ends[of], max(len(texts.points) - 1, 0)
    number = np.bincount(of, minlength=len(texts.ends)) if carried is None else carried["candidates"]
    clipped = (number <= 50)[of] if look.mode == "reference" else np.zeros(len(at), dtype=bool)
    far = np.where(clipped, 2 * max(look.left, look.right), 1 << 30)
    p, near = at - start, np.minimum(far, look.reach)
    n, m = np.minimum(p, near), np.minimum(near + 1, end - at)  # characters before, and from the place on
    out = np.empty((len(at), look.width), dtype=np.int32)
    for i, k in enumerate(range(-look.left, look.right + 1)):
        out[:, i] = np.where((k >= -n) & (k < m), texts.code[np.clip(at + k, 0, last)], PADDING) if len(at) else 0
    if not look.flags or not len(at):
        return of, out
    back, on = np.maximum(at - 1, 0), np.minimum(at + 1, last)
    c, kind = texts.points[at], texts.sets[at]
    previous, ahead = np.where(n > 0, texts.sets[back], 0), np.where(m > 1, texts.sets[on], 0)
    has = lambda sets, name: (sets & _BIT[name]) > 0
    colons = texts.where(":")
    colon = lambda k: np.searchsorted(colons, at) > np.searchsorted(colons, at - np.minimum(n, k))
    flag = dict(zip(FLAGS, out[:, look.left + look.right + 1 :].T, strict=True))
    flag["abbreviation"][:] = _abbreviations(texts, look, at, c, n)
    flag["terminator"][:] = np.where(has(kind, "primary"), 1, np.where(has(kind, "secondary"), -1, 0))
    flag["balanced"][:] = 1
    quoted = np.flatnonzero(has(kind, "quote"))
    flag["balanced"][quoted] = _balanced(texts, at[quoted], of[quoted], (at - np.where(clipped, np.minimum(p, far), p))[quoted], clipped[quoted], carried)
    flag["complete"][:] = ~(has(kind, "closing") & has(ahead, "goes_on"))
    flag["lower_next"][:] = has(ahead, "lower")
    flag["list_item"][:] = _items(texts, at, n, m, kind, previous, ahead, colon(5) & (n >= 5))
    flag["semicolon_list"][:] = _semicolons(texts, at, c, n, m)
    beside = (c == ord(":")) | ((n > 0) & (texts.points[back] == ord(":"))) | ((m > 1) & (texts.points[on] == ord(":")))
    flag["near_colon"][:] = colon(10) & beside if look.variant == "array" else colon(10)
    return of, out


def _abbreviations(texts: Texts, look: Look, at: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    found, longest, known = np.zeros(len(at), dtype=bool), max(map(len, look.abbreviations), default=0), frozenset(look.abbreviations)
    stops = np.flatnonzero(c == ord("."))
    breaks = np.concatenate(([-1], np.flatnonzero((texts.sets & _BIT["run"]) == 0)))
    here = at[stops]
    begin = np.maximum(breaks[np.searchsorted(breaks, here) - 1] + 1, here - np.minimum(n[stops], longest))
    short = here - begin < longest
    for i, a, b in zip(stops[short].tolist(), begin[short].tolist(), here[short].tolist(), strict=True):
        found[i] = texts.whole[a : b + 1] in known
    return found


def _balanced(texts: Texts, at: np.ndarray, of: np.ndarray, begin: np.ndarray, clipped: np.ndarray, carried: dict[str, np.ndarray] | None) -> np.ndarray:
    n = {}
    for name, q in _QUOTES.items():
        places = texts.where(q)
        n[name] = np.searchsorted(places, at + 1) - np.searchsorted(places, begin) + (np.where(clipped, 0, carried[name][of]) if carried else 0)
    return (n["straight"] % 2 == 0) & (n["opened"] == n["closed"]) & (n["single"] % 2 == 0) & (n["single_opened"] == n["single_closed"])


def _items(texts: Texts, at: np.ndarray, n: np.ndarray, m: np.ndarray, kind: np.ndarray, previous: np.ndarray, ahead: np.ndarray, colon: np.ndarray) -> np.ndarray:
    has = lambda sets, name: (sets & _BIT[name]) > 0
    edge = has(kind, "around") | has(previous, "before") | has(ahead, "around")
    inner = (n > 0) & (m > 1) & (has(kind, "stops") | has(previous, "stops"))
    may = (edge | has(kind, "item")) & (has(kind, "typical") | inner)
    found, whole = np.zeros(len(at), dtype=bool), texts.whole
    left = lambda i, k: whole[at[i] - min(n[i], k) : at[i]]
    right = lambda i, k: whole[at[i] : at[i] + min(m[i], k)]
    for i in np.flatnonzero(may & has(previous, "marker_ends")).tolist():
        found[i] = left(i, _TAIL).endswith(LIST_MARKERS)
    # a marker that is no bullet and has no bracket ends in a full stop
    stops = np.concatenate((texts.where("."), [1 << 60]))
    soon = stops[np.searchsorted(stops, at, side="right")] - at < _TAIL
    begins = has(kind, "marker_begins") & (soon | has(kind, "bullet") | (texts.points[at] == ord("(")))
    for i in np.flatnonzero(may & begins & ~found).tolist():
        found[i] = right(i, _TAIL).startswith(LIST_MARKERS)
    for i in np.flatnonzero(may & edge & colon & ~found).tolist():
        before = left(i, 20)
        found[i] = any(x in before for x in LIST_INTROS)
    for i in np.flatnonzero(may & edge & (has(kind, "listing") | has(previous, "listing")) & ~found).tolist():
        after = right(i, 20)
        found[i] = any(1 <= (k := after.find(x)) <= 4 and after[k - 1] in ";," for x in LIST_CONJUNCTIONS)
    return found


def _semicolons(texts: Texts, at: np.ndarray, c: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    found = np.zeros(len(at), dtype=bool)
    for i in np.flatnonzero(c == ord(";")).tolist():
        before, after = texts.whole[at[i] - min(n[i], 50) : at[i]], texts.whole[at[i] : at[i] + min(m[i], 50)]
        both = before + after
        found[i] = both.count(";") >= 2 or bool(re.search(_MARKER, both) or re.search(_INTRO, before) or re.search(_CONJUNCTION, after))
    return found


def groups(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows in groups of about CHARACTERS, in order."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + CHARACTERS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def placed(docs: DataFrame, look: Look, text: str | Column = "text", also: Column | None = None, truth: Column | None = None) -> DataFrame:
    """One row per place: the columns of docs but text, pos, features and, with truth, label.

    also: an array of places that are described besides candidates.  truth: the array of
    a text's boundaries; their places are described, too, and have label 1, others 0.
    """
    others = [c for c in docs.columns if c != text]
    none = F.array().cast("array<int>")
    given = docs.select(*others, (F.col(text) if isinstance(text, str) else text).alias("_text"), (none if also is None else also).alias("_also"), (none if truth is None else truth).alias("_truth"))
    known, k = classes(docs.sparkSession), len(others)
    label = [] if truth is None else [StructField("label", IntegerType(), False)]
    schema = StructType([*docs.select(*others).schema.fields, StructField("pos", IntegerType(), False), StructField("features", ArrayType(IntegerType(), False), False), *label])
    # features stand in few enough rows that their offsets fit
    names, most = [f.name for f in schema.fields], 1 << 16

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch, k):
                texts = Texts(rows.column(k).to_pylist(), known.value)
                ends = _absolute(texts, rows.column(k + 2)) - 1
                places = texts.places(look.everywhere, np.concatenate((ends, _absolute(texts, rows.column(k + 1)))))
                of, x = described(texts, look, places)
                right = np.zeros(len(texts.points), dtype=np.int32)
                right[ends] = 1
                for a in range(0, len(places), most):
                    part, whose = slice(a, a + most), pa.array(of[a : a + most])
                    n = len(whose)
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * look.width)
                    columns = [pa.array((places - texts.starts[of])[part].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(x[part].ravel()))]
                    yield pa.RecordBatch.from_arrays([*(rows.column(i).take(whose) for i in range(k)), *columns, *([pa.array(right[places[part]])] if label else [])], names)

    return given.mapInArrow(step, schema)


def _absolute(texts: Texts, lists: pa.ListArray) -> np.ndarray:
    """Places in each text as places among the characters of all."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(texts.starts, size)
