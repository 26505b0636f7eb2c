"""Near duplicates by SimHash, found through an anchor-point covering.

A fingerprint has 64 bits in two halves of 32.  Two fingerprints at most 3 bits
apart agree in one half up to 1 bit.  The anchors of a half are a covering code:
the perfect Hamming code on 31 bits, whose covering radius is 1, times both values
of the last bit.  Each fingerprint is at home with its nearest anchor and visits
every anchor within the radius plus the half's threshold of 1, at most 17 in a
half.  So of two linked fingerprints each visits the other's home in some half, and
comparing per anchor finds every link.

The work runs over distinct fingerprints.  An anchor with many home fingerprints
is dealt in chunks of bounded size: visitors go to all of its chunks and stream
past the held home fingerprints, and only the links that join something new leave
the task.  No link between groups is lost, and no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, one_row_each
from .graph import components

#: Bit j of a position's number 1..31, as a mask over the 31 positions (bit i holds position i + 1).
_CHECKS = [sum(1 << i for i in range(31) if (i + 1) >> j & 1) for j in range(5)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """The contract's SimHash of one text: unsigned, 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        m = min(n, k + (1 << 16))
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[k:m].tolist(), ends[k + size - 1 : m + size - 1].tolist(), strict=True)], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(total * 2 > n).tolist())


def fingerprints(text: str | Column) -> Column:
    """SimHash of a text column as a signed long with the fingerprint's bits; null counts as empty."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t) for t in part], dtype=np.uint64).view(np.int64))

    return of(F.col(text) if isinstance(text, str) else text)


def _one_at(i: Column) -> Column:
    """A long with the bit of position i (1..31) set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int"))


def _anchors(part: Column) -> tuple[Column, Column]:
    """Home anchor of a half (a long of 32 bits), and all anchors that it visits."""
    syndrome = F.lit(0)
    for j, mask in enumerate(_CHECKS):
        syndrome = syndrome + (F.bit_count(part.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << j)
    home = F.when(syndrome == 0, part).otherwise(part.bitwiseXOR(_one_at(syndrome)))
    # codewords two steps away: flip i and j with i xor j equal to the syndrome
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (syndrome > 0) & (i < i.bitwiseXOR(syndrome))),
        lambda i: part.bitwiseXOR(_one_at(i)).bitwiseXOR(_one_at(i.bitwiseXOR(syndrome))),
    )
    return home, F.concat(F.array(home, home.bitwiseXOR(F.lit(1 << 31).cast("long"))), pairs)


def _visit(home: Column, tag: int):
    return lambda a: F.struct((a + F.lit(tag).cast("long")).alias("anchor"), (a == home).alias("home"))


def homes(prints: DataFrame) -> DataFrame:
    """(anchor) of the home of each half of the distinct fingerprints fp."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    return prints.select(F.explode(F.array(_anchors(low)[0], _anchors(high)[0] + F.lit(1 << 32).cast("long"))).alias("anchor"))


def visits(prints: DataFrame) -> DataFrame:
    """(anchor, fp, home) for the distinct fingerprints fp: each anchor that one visits, home for its nearest."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    rows = []
    for half, part in ((0, low), (1, high)):
        home, all_ = _anchors(part)
        rows.append(F.transform(all_, _visit(home, half << 32)))
    return prints.select("fp", F.explode(F.concat(*rows)).alias("a")).select("a.anchor", "fp", "a.home")


def _runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1), [True])))
    return edge[:-1], edge[1:]


class _Anchor:
    """The home fingerprints of one chunk of an anchor, with the sets already joined."""

    def __init__(self) -> None:
        self.home = np.zeros(0, dtype=np.uint64)
        self.root = np.zeros(0, dtype=np.int64)

    def hold(self, fps: np.ndarray) -> None:
        self.root = np.concatenate((self.root, np.arange(len(self.home), len(self.home) + len(fps))))
        self.home = np.concatenate((self.home, fps))

    def meet(self, fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        if not len(self.home):
            return out
        for x in fps:
            near = np.flatnonzero(np.bitwise_count(self.home ^ x) <= bits)
            if not len(near):
                continue
            roots, at = np.unique(self.root[near], return_index=True)
            out.extend((int(x), int(self.home[near[i]])) for i in at.tolist() if self.home[near[i]] != x)
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
        return out


def _compare(bits: int):
    """Links of a partition sorted by anchor, chunk and home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        held = _Anchor()
        for b in batches:
            key = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], axis=1)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            home = np.asarray(b.column(3).to_numpy(zero_copy_only=False), dtype=bool)
            starts, ends = _runs_of(key) if len(key) else (np.zeros(0, int), np.zeros(0, int))
            found: list[tuple[int, int]] = []
            wide = ends - starts
            wide_enough = np.flatnonzero(wide > 1).tolist()
            if len(starts):
                wide_enough = sorted({0, len(starts) - 1, *wide_enough})
            for r in wide_enough:
                s, e = starts[r], ends[r]
                this = (int(key[s, 0]), int(key[s, 1]))
                if this != last:
                    held, last = _Anchor(), this
                h = home[s:e]
                if h.any():
                    held.hold(fp[s:e][h])
                found += held.meet(fp[s:e], bits)
            got = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["u", "v"])

    return run


def links(prints: DataFrame, bits: int = 3, chunk: int = 4096) -> DataFrame:
    """Links (u, v) of distinct fingerprints fp that join all that are at most bits apart (3 or fewer).

    chunk bounds the home fingerprints that a task holds at once; an anchor with
    more is dealt in chunks that every visitor meets.
    """
    if bits > 3:
        raise ValueError("the covering holds for thresholds up to 3 bits")
    # a fingerprint becomes many visits, so the fingerprints are dealt over the cores first
    prints = prints.repartition(max(prints.sparkSession.sparkContext.defaultParallelism, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "fp")
    spread = visits(prints)
    # anchors with many homes, counted from each fingerprint's own two
    crowded = homes(prints).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    spread = spread.join(crowded, "anchor", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    spread = spread.select("anchor", "fp", "home", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    spread = spread.select("anchor", "chunk", "fp", (F.col("home") & (F.col("mine") == F.col("chunk"))).alias("home"))
    spread = spread.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"), "fp")
    return spread.mapInArrow(_compare(bits), "u long, v long").distinct()


def _labelled(prints: DataFrame, bits: int, chunk: int) -> DataFrame:
    """(fp, least, root): the distinct fingerprints, the smallest doc_id of each, and what names its group."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct.select("fp"), bits, chunk))
    return distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(prints: DataFrame, bits: int = 3, chunk: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) from one fingerprint per document.

    component_id is the smallest doc_id reachable over links of at most bits.  Rows
    that repeat a doc_id keep one row each; a null doc_id counts as larger than all
    others, and is null where nothing else is in its component.
    """
    prints = cut(prints.select("doc_id", "fp"))
    labelled = _labelled(prints, bits, chunk)
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str | Column) -> Column:
    """Sixteen lower-case hex digits of a fingerprint held in a long."""
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = docs.select("doc_id", fingerprints("text").alias("fp"))
    return near_duplicates(prints).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, bits: int = 3, chunk: int = 4096) -> DataFrame:
    """One document of each near-duplicate group, of those with the smallest doc_id (null is larger than all others); columns stay as they are."""
    prints = cut(docs.select("doc_id", fingerprints("text").alias("fp")))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    kept = _labelled(prints, bits, chunk).groupBy("root").agg(first.alias("first")).select(F.col("first.least").alias("doc_id"), F.col("first.fp").alias("mark"))
    return one_row_each(docs, cut(kept), fingerprints("text"))
