"""Benchmark decontamination by the q-gram lemma over diagonal bands.

A benchmark passage of n characters that stands in a document with at most e edits
shares at least n + 1 - q * (e + 1) of its q-grams with it, and all of them lie on
diagonals (position in the document less position in the passage) at most e apart.
Shared q-grams are counted in overlapping bands of 2 (e + 1) diagonals, so some
band holds them all; bands that reach the bound are kept and verified by a banded
alignment, which gives the least number of edits of the whole passage.

Characters are compared in lower case, with runs of white space as one space.
The benchmark travels to the tasks in blocks of bounded size; a benchmark of many
blocks makes one pass over the documents for each, and only one block is held at once.
Very long texts are searched in pieces that overlap by all that a passage can take up.

Defined results: null and empty texts hold nothing; null and blank passages are not
searched for, passages shorter than q characters are found where they stand exactly
and no letter or digit touches them, and passages too short for their edit budget get the largest budget that the lemma can bound.  Passages that repeat under several
item ids are each reported.  An empty benchmark leaves every document clean.  Other
columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import fresh, scratch, small_or_shuffled

Q = 8
HITS = "array<struct<item_id: long, start: long, end: long, edits: int>>"
_SLOTS = 20
#: Postings that a task counts at once.
_POSTINGS = 1 << 20
#: Lower case of each code point of the basic plane that has one of a single code point.
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], dtype=np.uint32)


def _plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compared characters of the texts, where each stood, and the texts' offsets among them.

    A text ends in a line feed, which stays as it is and so matches nothing inside.
    """
    code, offsets = tokens.codes(texts)
    low = np.where(code < len(_LOWER), _LOWER[np.minimum(code, len(_LOWER) - 1)], code)
    white = (low == 32) | ((low >= 9) & (low <= 13)) | (low == 0xA0)
    end = np.zeros(len(low), dtype=bool)
    end[offsets[1:] - 1] = True
    white &= ~end
    low = np.where(white, 32, low).astype(np.uint32)
    low[end] = 10
    keep = ~(white & np.concatenate(([False], white[:-1])))
    at = np.flatnonzero(keep)
    return low[at], at, np.searchsorted(at, offsets)


def _written(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class Index:
    """A block of the benchmark: sorted q-gram hashes with (item, position) postings, and the passages."""

    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    slots: np.ndarray
    passages: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    ids: np.ndarray
    short: dict[str, list[int]]

    @property
    def reach(self) -> int:
        """Compared characters that a passage with its edits can take up."""
        return max([int((self.budget * 2 + [len(p) for p in self.passages]).max()) + 8 if self.passages else 0, Q + 2])


def build(rows: list[tuple[int, str]], rate: float) -> Index | None:
    ids, passages, hashes, item, position = [], [], [], [], []
    short: dict[str, list[int]] = {}
    for i, text in rows:
        code, _, _ = _plain([text.strip()])
        code = code[:-1]
        if len(code) < Q:
            if len(code):
                short.setdefault(_written(code), []).append(i)
            continue
        h = tokens.gram_hashes(code, Q)
        hashes.append(h)
        item.append(np.full(len(h), len(ids)))
        position.append(np.arange(len(h)))
        ids.append(i)
        passages.append(code)
    if not ids and not short:
        return None
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    item, position = (np.concatenate(a) if a else np.zeros(0, dtype=np.int64) for a in (item, position))
    order = np.argsort(h, kind="stable")
    n = np.array([len(p) for p in passages], dtype=np.int64)
    budget = np.maximum(0, np.minimum((n * rate).astype(int), (n - Q) // Q))
    slots = np.zeros(1 << _SLOTS, dtype=bool)
    slots[h >> np.uint64(64 - _SLOTS)] = True
    return Index(h[order], item[order], position[order], slots, passages, budget, n + 1 - Q * (budget + 1), np.array(ids, dtype=np.int64), short)


def _regions(code: np.ndarray, offsets: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first diagonal of the band) of the bands that reach their bound."""
    h = tokens.gram_hashes(code, Q)
    some = np.flatnonzero(x.slots[h >> np.uint64(64 - _SLOTS)])
    low = np.searchsorted(x.hashes, h[some], "left")
    n = np.searchsorted(x.hashes, h[some], "right") - low
    some, low, n = some[n > 0], low[n > 0], n[n > 0]
    none = np.zeros(0, dtype=np.int64)
    if not len(some):
        return none, none, none
    upto = np.cumsum(n)
    # a window is counted with all that a passage which begins in it can reach
    reach = int((x.budget + [len(p) for p in x.passages]).max()) + 1
    found, a = [], 0
    while a < len(some):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] - n[a] + _POSTINGS, "right")))
        e = int(np.searchsorted(some, some[z - 1] + reach, "right"))
        found.append(_bands(some[a:e], low[a:e], n[a:e], offsets, x))
        a = z
    text, item, first = (np.concatenate(part) for part in zip(*found, strict=True))
    return text, item, first


def _bands(some: np.ndarray, low: np.ndarray, n: np.ndarray, offsets: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bands of ``_regions`` among the grams at some; their n postings each begin at low."""
    at = np.repeat(some, n)
    post = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    item = x.item[post]
    text = np.searchsorted(offsets, at, "right") - 1
    shift = np.int64(1 << 20)
    diagonal = at - offsets[text] - x.position[post] + shift
    step = x.budget[item] + 1
    band = diagonal // step
    # each diagonal lies in the band that starts at its step and in the one before
    key = text * len(x.ids) + item
    both = np.concatenate((key, key)), np.concatenate((band, band - 1))
    order = np.lexsort((both[1], both[0]))
    k, b = both[0][order], both[1][order]
    edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]), [True])))
    count = np.diff(edge)
    k, b = k[edge[:-1]], b[edge[:-1]]
    item = k % len(x.ids)
    good = count >= x.bound[item]
    return k[good] // len(x.ids), item[good], b[good] * (x.budget[item[good]] + 1) - shift


def _align(passage: np.ndarray, text: np.ndarray, first: int, width: int) -> tuple[int, int, int]:
    """Least edits of the passage against the text near the diagonals first .. first + width - 1, and the span.

    Banded dynamic programming, a cell per diagonal; the text's ends are free.
    """
    band = width + 2
    lo = first - 1
    big = 1 << 28
    start = lo + np.arange(band)
    cost = np.where((start >= 0) & (start <= len(text)), 0, big)
    padded = np.full(len(passage) + band + 2, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(0, lo), min(len(text), lo + len(padded))
    if b > a:
        padded[a - lo : b - lo] = text[a:b]
    begin = start.copy()
    ramp = np.arange(band)
    for i, c in enumerate(passage.tolist()):
        here = cost + (padded[i : i + band] != c)
        down = np.concatenate((cost[1:], [big])) + 1
        take = down < here
        here = np.where(take, down, here)
        origin = np.where(take, np.concatenate((begin[1:], [0])), begin)
        # skipped characters of the text: a running minimum along the row
        packed = ((here - ramp) << 32) + ramp
        source = np.minimum.accumulate(packed) & 0xFFFFFFFF
        cost, begin = here[source] + ramp - source, origin[source]
        if cost.min() > width:
            return int(cost.min()), 0, 0
    ends = lo + ramp + len(passage)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, big)
    j = int(cost.argmin())
    return int(cost[j]), int(begin[j]), int(ends[j])


def search(texts: list[str], x: Index) -> list[list[tuple[int, int, int, int]]]:
    """(item_id, start, end, edits) of the passages in each text; each passage once, at its best place."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    code, where, offsets = _plain(texts)
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, first in zip(*(a.tolist() for a in _regions(code, offsets, x)), strict=True):
        passage, e = x.passages[i], int(x.budget[i])
        if best.get((t, i), (1,))[0] == 0:
            continue
        text = code[offsets[t] : offsets[t + 1] - 1]
        a, b = max(0, first - 1), min(len(text), first + 2 * (e + 1) + len(passage) + 1)
        piece = text[a:b]
        name = (i, first - a, piece.tobytes())
        if name not in known:
            at = piece.tobytes().find(passage.tobytes())
            while at > 0 and at % 4:
                at = piece.tobytes().find(passage.tobytes(), at + 1)
            known[name] = (0, at // 4, at // 4 + len(passage)) if at >= 0 else _align(passage, piece, first - a, 2 * (e + 1))
        edits, s, f = known[name]
        if edits <= e and edits < best.get((t, i), (1 << 30,))[0]:
            best[t, i] = (edits, s + a, f + a)
    for (t, i), (edits, s, f) in sorted(best.items()):
        place = where[offsets[t] : offsets[t + 1]] - base[t]
        out[t].append((int(x.ids[i]), int(place[s]), int(place[f - 1]) + 1 if f > s else int(place[s]), edits))
    if x.short:
        for t in range(len(texts)):
            place = where[offsets[t] : offsets[t + 1]] - base[t]
            plain = _written(code[offsets[t] : offsets[t + 1] - 1])
            for word, names in x.short.items():
                if (m := re.search(rf"(?<![^\W_]){re.escape(word)}(?![^\W_])", plain)) is not None:
                    out[t] += [(name, int(place[m.start()]), int(place[m.end() - 1]) + 1, 0) for name in names]
    return out


def search_long(text: str, x: Index, limit: int = tokens.BLOCK) -> list[tuple[int, int, int, int]]:
    """``search`` of one text, by pieces that overlap by all that a passage can take up; each passage at its best place."""
    if len(text) <= 2 * limit:
        return search([text], x)[0]
    best: dict[int, tuple[int, int, int]] = {}
    at = 0
    while True:
        end = min(len(text), at + limit)
        # white space counts as one space, so the overlap is measured without it
        back = x.reach
        while end < len(text) and end - back > at and len(text[end - back : end].split()) + sum(map(len, text[end - back : end].split())) < x.reach:
            back *= 2
        for item, start, stop, edits in search([text[at:end]], x)[0]:
            if edits < best.get(item, (1 << 30,))[0]:
                best[item] = (edits, start + at, stop + at)
        if end == len(text):
            return [(item, start, stop, edits) for item, (edits, start, stop) in best.items()]
        at = max(end - back, at + 1) if end - back > at else end


def _blocks(benchmark: DataFrame, chars: int) -> int:
    """In how many blocks the benchmark is dealt, by its counted characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // chars))


def contaminated(docs: DataFrame, benchmark: DataFrame, into: str, rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """docs with one more column: the passages found in each text, an empty array where it is clean.

    rate: edits allowed per character of a passage.  block_chars: characters of the
    benchmark that are on the driver and in a task at once, by counted size; a passage
    is in one block, by its hash.  A benchmark of one block is searched for inside the
    row.  Of more blocks, each makes one pass whose finds are written to the shared
    folder by digest of the text before the next block is read.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    numbers = _blocks(benchmark, block_chars)

    def block(k: int) -> Index | None:
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(numbers)) == k).orderBy("item_id", "text").collect()
        return build([(r["item_id"], r["text"]) for r in rows], rate)

    empty = F.array().cast(HITS)
    if numbers == 1:
        index = block(0)
        return docs.withColumn(into, _found("text", spark.sparkContext.broadcast(index)) if index else empty)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    finds = None
    for k in range(numbers):
        index = block(k)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(index)
        rows = docs.select("text").withColumn("hits", _found("text", sent)).where(F.size("hits") > 0)
        part, _ = scratch(rows.select(digest.alias("digest"), "hits").dropDuplicates(["digest"]))
        sent.unpersist()
        finds = part if finds is None else finds.unionByName(part)
    if finds is None:
        return docs.withColumn(into, empty)
    name = fresh(docs, "digest_")
    finds = finds.groupBy(F.col("digest").alias(name)).agg(F.flatten(F.collect_list("hits")).alias(into))
    out = docs.withColumn(name, digest).join(small_or_shuffled(finds, 200_000), name, "left").drop(name)
    return out.withColumn(into, F.coalesce(into, empty))


def _found(text: str, sent):
    @F.pandas_udf(HITS)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "start", "end", "edits")
        for part in parts:
            out: list[list[dict]] = []
            for _, texts in tokens.blocks(list(part)):
                rows = search(texts, sent.value) if max(map(len, texts)) <= 2 * tokens.BLOCK else [search_long(t, sent.value) for t in texts]
                out += [[dict(zip(names, hit, strict=True)) for hit in hits] for hits in rows]
            yield pd.Series(out, dtype=object)

    return found(text)


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per passage found: doc_id, item_id, start and end (code points), edits."""
    found = contaminated(docs.select("doc_id", "text"), benchmark, "found").where(F.size("found") > 0)
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.start", "f.end", "f.edits")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage; columns stay as they are."""
    name = fresh(docs, "passages_")
    return contaminated(docs, benchmark, name).where(F.size(name) == 0).drop(name)
