"""Quality classifier on supervised subword embeddings.

Words, pairs of words and character n-grams are hashed into a table of learned
vectors; a document is the mean of its vectors, and a softmax over it gives the
class.  The table and the softmax are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.  Scoring folds table and
softmax into one number per hashed feature: the mean of products is the product of
the mean.

Defined results: null counts as empty; an empty text scores the softmax of its bias
alone.  Without labels of both classes every text scores the base rate (0 without
any label).  A document labelled more than once counts as good if any label says so.
A text of more than a million characters is read in pieces, and n-grams across their
borders do not count.  Repeated rows are scored alike.  Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import fold, table

#: Orders of the character n-grams.
ORDERS = (1, 3, 4)


@dataclass(frozen=True)
class QualityModel:
    """Per hashed feature, the part of the class-1 logit that it brings; then the bias."""

    weight: np.ndarray
    bias: float
    bits: int


def _features(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and the text that each belongs to, one kind of feature after another."""
    code, offsets = tokens.codes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    shift = np.uint64(64 - bits)
    last = offsets[1:][of] - 1
    at = np.arange(len(code))
    for n in ORDERS:
        h = tokens.gram_hashes(code, n)
        inside = at[: len(h)] + n <= last[: len(h)]
        yield (h[inside] >> shift).astype(np.int64), of[: len(h)][inside]
    space = (code == 32) | ((code >= 9) & (code <= 13))
    starts, ends = tokens.runs(~space)
    if not len(starts):
        return
    h = tokens.span_hashes(code, starts, ends)
    yield (h >> shift).astype(np.int64), of[starts]
    same = of[starts[1:]] == of[starts[:-1]]
    with np.errstate(over="ignore"):
        pair = tokens.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    # a word that follows itself is one feature, whatever the word
    pair = np.where(h[1:] == h[:-1], np.uint64(1), pair)
    yield (pair[same] >> shift).astype(np.int64), of[starts[1:]][same]


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, dim: int, epochs: int, rate: float, seed: int) -> QualityModel:
    """Stochastic gradient descent over (feature ids, their shares, label)."""
    y = np.array([r[2] for r in rows], dtype=float)
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        return QualityModel(np.zeros(1 << bits, dtype=np.float32), float(np.log((base + 1e-9) / (1 - base + 1e-9))), bits)
    rng = np.random.default_rng(seed)
    vector = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.log(np.array([1 - base, base], dtype=np.float32))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share, label = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            vectors = vector[ids]
            h = share @ vectors
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            # the classic rule spreads the error over all features of the text alike
            vector[ids] = vectors - lr * (share * len(ids))[:, None] * back
    delta = out[:, 1] - out[:, 0]
    return QualityModel((vector @ delta).astype(np.float32), float(bias[1] - bias[0]), bits)


def train(labelled: DataFrame, max_rows: int = 2500, bits: int = 16, dim: int = 8, epochs: int = 6, rate: float = 0.1, seed: int = 5) -> QualityModel:
    """Fit from rows (text, y); max_rows bounds the labelled rows that are learned from (about, drawn by hash).

    The tasks hash whole texts into features; only those of the bounded sample go to the driver.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, label in zip(b["text"], b["y"], strict=True):
                n = np.zeros(1 << bits, dtype=np.int64)
                for _, piece, _ in tokens.bounded([text]):
                    for ids, _ in _features(piece, bits):
                        n += np.bincount(ids, minlength=1 << bits)
                ids = np.flatnonzero(n)
                n = n[ids]
                yield pd.DataFrame({"i": [ids.astype(np.int32).tobytes()], "s": [(n / max(n.sum(), 1)).astype(np.float32).tobytes()], "y": [int(label)], "k": [hash_of(text)]})

    total = labelled.count()
    if total > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 40)) < F.lit(int((1 << 40) * max_rows / total)))
    rows = table(labelled.mapInPandas(hashed, "i binary, s binary, y int, k long")).sort_values(["k", "y"])
    cases = [(np.frombuffer(i, dtype=np.int32), np.frombuffer(s, dtype=np.float32), int(y)) for i, s, y in zip(rows["i"], rows["s"], rows["y"], strict=True)]
    return _train([c for c in cases if len(c[0])], bits, dim, epochs, rate, seed)


def hash_of(text: str) -> int:
    """A hash that orders the sample the same way in every run."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def score(text: str | Column, model: QualityModel, spark) -> Column:
    """Probability of label 1 for a text column."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for part in parts:
            total, n = np.zeros(len(part)), np.zeros(len(part))
            for at, texts, _ in tokens.bounded(list(part)):
                upto = at + len(texts)
                for ids, owner in _features(texts, m.bits):
                    total[at:upto] += np.bincount(owner, weights=m.weight[ids], minlength=len(texts))
                    n[at:upto] += np.bincount(owner, minlength=len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + m.bias, -500, 500))))

    return of(F.col(text) if isinstance(text, str) else text)


def op10_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 2500) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learned from at most about max_rows labelled rows whose crc32(doc_id) mod 3 is not 1.
    """
    docs = docs.select("doc_id", "text")
    y = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    y = y.where(fold("doc_id", 3) != 1)
    n = y.count()
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < F.lit(int((1 << 40) * max_rows / n)))
    labelled = docs.join(F.broadcast(y), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")
    model = train(labelled, max_rows)
    out = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score("text", model, docs.sparkSession).alias("score"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
