"""Toxicity by class-conditional Kneser-Ney models.

Word bigrams are counted over every labelled training text, by class, once in a text;
no count is left out.  Each class has an interpolated, discounted model of its own:

    P(w | v) = f(v, w) + L(v) P(w),   P(w) = g(w) + L Q(w),   Q(w) = h(w) + M S(w)

where f and g are discounted relative frequencies in the class, h those of both classes
together, S(w) is the share of w among the Kneser-Ney continuation counts of both, and
L(v), L and M are what the discounts leave, so that all sums over all words are 1.

Rare expressions are smoothed through the shared model Q: the discount is the same
relative frequency in both classes, so that a count at or below it tells nothing, and
a word whose classes then differ by less than a factor has no g, in either class.  A
bigram that says no more than its word backs off to it.  Each distinct text counts
once.  Discount and factor are chosen, and the logistic that makes a score of the
length-normalised difference of log-likelihoods is fitted, on a fold of the training
rows that the counts then leave out; held-out rows have no part in it.

Only what is above the discount differs from plain backoff, so only that has to reach
the texts: as a broadcast where its counted rows are few, and by a join on the texts'
words where they are not.  Both ways give the same scores.

Defined results: null and empty texts, and texts without a word, score the base rate
of toxic labels.  Without labels of both classes every text scores that base rate (0
without any label).  A document labelled more than once counts as toxic if any label
says so.  Repeated rows are scored alike.  Labels, language, source and id are never
inputs of a score.  Words are known by 32 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import discard, fold, scratch, small_or_shuffled
from .common import table as collected

_LOW = (1 << 32) - 1
_FLUSH = 4_000_000
#: Rows of a model that may travel to every task.
MOST_ROWS = 4_000_000


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of the lower-cased words (runs of letters) of the texts, and each text's first word."""
    code, offsets = tokens.codes([t.lower() for t in texts])
    inside = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code < 0x2C00)) & ~((code >= 0x3000) & (code < 0x3040)))
    starts, ends = tokens.runs(inside)
    ids = (tokens.span_hashes(code, starts, ends) >> np.uint64(32)).astype(np.int64)
    return np.maximum(ids, 1), np.searchsorted(starts, offsets)


def _bigrams(ids: np.ndarray, first: np.ndarray, before: int = 0) -> np.ndarray:
    """Keys of the bigrams that end at each word; ``before`` stands before the first word of a text, 0 at its beginning."""
    previous = np.concatenate(([before], ids[:-1]))
    previous[first[:-1][np.diff(first) > 0]] = before
    return (previous << 32) | ids


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bigrams, the text of each bigram) of texts in blocks; a very long text goes piece by piece."""
    for at, held in tokens.blocks(texts):
        if len(held) == 1 and len(held[0]) > 2 * tokens.BLOCK:
            last, parts = 0, []
            for piece in tokens.split(held[0]):
                ids, first = words([piece])
                if len(ids):
                    parts = [np.concatenate((*parts, _bigrams(ids, first, last)))]
                    last = int(ids[-1])
            pairs = parts[0] if parts else np.zeros(0, dtype=np.int64)
            yield at, pairs, np.zeros(len(pairs), dtype=np.int64)
            continue
        ids, first = words(held)
        yield at, _bigrams(ids, first), np.repeat(np.arange(len(held)), np.diff(first))


def gather(labelled: DataFrame) -> DataFrame:
    """(key, o_a, t_a, o_b, t_b): bigram counts by class (0 or 1 in y) and part (0 for a, 1 for b in part)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def table() -> pd.DataFrame:
            parts = []
            for kind, keys in held.items():
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                parts.append(pd.DataFrame({"key": k, "kind": kind, "n": n}))
            return pd.concat(parts)

        for b in batches:
            y, part = b["y"].to_numpy(np.int64), b["part"].to_numpy(np.int64)
            for at, pairs, owner in _blocks(list(b["text"])):
                # a bigram counts once in a text, so that repeated lines weigh no more
                _, first = np.unique(tokens.mix(pairs.view(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                kind = y[at + owner[first]] * 2 + part[at + owner[first]]
                for k in np.unique(kind).tolist():
                    held.setdefault(k, []).append(pairs[first][kind == k])
                size += len(first)
                if size > _FLUSH:
                    yield table()
                    held, size = {}, 0
        if held:
            yield table()

    got = labelled.select("text", "y", "part").mapInPandas(count, "key long, kind int, n long")
    sums = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(("o_a", "o_b", "t_a", "t_b"))]
    return got.groupBy("key").agg(*sums)


@dataclass(frozen=True)
class Counts:
    """Counts of a part set in the shared folder: words (w, o, t, types), bigrams (v, w, o, t), contexts (v, o, t), and totals."""

    words: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    ordinary: float
    toxic: float
    types: float

    def limits(self, discount: float) -> tuple[float, float]:
        """The discount of each class in counts: the same relative frequency in both, discount in the smaller class."""
        least = max(min(self.ordinary, self.toxic), 1.0)
        return discount * self.ordinary / least, discount * self.toxic / least


def counts_of(table: DataFrame, parts: tuple[str, ...], least: float) -> tuple[Counts, list[str]]:
    """The counts of some parts of ``gather``, of bigrams those above the least discount in a class; and their folders for ``discard``."""
    o, t = (sum((F.col(f"{c}_{p}") for p in parts), F.lit(0)) for c in "ot")
    rows = table.select(F.shiftright("key", 32).bitwiseAND(F.lit(_LOW)).alias("v"), F.col("key").bitwiseAND(F.lit(_LOW)).alias("w"), o.alias("o"), t.alias("t")).where("o + t > 0")
    sums = F.sum("o").alias("o"), F.sum("t").alias("t")
    vocabulary, p1 = scratch(rows.groupBy("w").agg(*sums, F.count("*").alias("types")))
    contexts, p2 = scratch(rows.groupBy("v").agg(*sums))
    n = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("o", "t", "types"))).first()
    made = Counts(vocabulary, rows, contexts, n["o"], n["t"], n["types"])
    over_o, over_t = made.limits(least)
    pairs, p3 = scratch(rows.where((F.col("o") > over_o) | (F.col("t") > over_t)))
    return Counts(vocabulary, pairs, contexts, n["o"], n["t"], n["types"]), [p1, p2, p3]


@dataclass(frozen=True)
class Model:
    """What differs from plain backoff: log-likelihood ratios, toxic to ordinary.

    table: (kind, key, r); kind 0: words with a count of the class; 1: bigrams; 2: what a context leaves
    to its words.  rest: the ratio of all other words.
    """

    table: DataFrame
    rest: float


def kneser_ney(c: Counts, discount: float, factor: float) -> Model:
    """The two models for one discount and one factor, as ratios."""
    over_o, over_t = c.limits(discount)
    n_o, n_t, types = max(c.ordinary, 1.0), max(c.toxic, 1.0), max(c.types, 1.0)
    above = lambda x, over, n: F.greatest(F.col(x) - F.lit(over), F.lit(0.0)) / F.lit(n)
    pooled = (F.greatest(F.col("o") + F.col("t") - F.lit(over_o + over_t), F.lit(0.0)) / F.lit(n_o + n_t)).alias("gp")
    words_ = c.words.select("w", above("o", over_o, n_o).alias("go"), above("t", over_t, n_t).alias("gt"), pooled, (F.col("types") / F.lit(types)).alias("s"))
    sums = words_.agg(*(F.coalesce(F.sum(g), F.lit(0.0)).alias(g) for g in ("go", "gt", "gp"))).first()
    left, left_p = max(1 - sums["go"], 1 - sums["gt"]), 1 - sums["gp"]
    shared = words_.select("w", "go", "gt", (F.col("gp") + left_p * F.col("s")).alias("q"), (left * F.col("s")).alias("s"))
    free = F.abs(F.log((F.col("gt") + F.col("s")) / (F.col("go") + F.col("s")))) >= F.lit(float(np.log(factor)))
    own = shared.where("go > 0 OR gt > 0").where(free)
    used = own.agg(*(F.coalesce(F.sum(g), F.lit(0.0)).alias(g) for g in ("go", "gt"))).first()
    left_o, left_t = max(1 - used["go"], 1e-9), max(1 - used["gt"], 1e-9)
    words_ = own.select("w", (F.col("go") + left_o * F.col("q")).alias("po"), (F.col("gt") + left_t * F.col("q")).alias("pt"))
    # all other words have the shared model alone
    plain = shared.select("w", "q")
    contexts = c.contexts.select("v", F.col("o").alias("vo"), F.col("t").alias("vt"))
    share = lambda x, over, n: F.when(F.col(n) > 0, F.greatest(F.col(x) - F.lit(over), F.lit(0.0)) / F.col(n)).otherwise(0.0)
    pairs = c.pairs.where((F.col("o") > over_o) | (F.col("t") > over_t)).join(contexts, "v").select("v", "w", share("o", over_o, "vo").alias("fo"), share("t", over_t, "vt").alias("ft"))
    pairs = pairs.join(plain, "w").join(words_, "w", "left")
    pairs = pairs.select("v", "w", "fo", "ft", F.coalesce("po", left_o * F.col("q")).alias("po"), F.coalesce("pt", left_t * F.col("q")).alias("pt"))
    sums = lambda rows: rows.groupBy("v").agg(F.sum("fo").alias("so"), F.sum("ft").alias("st"))
    ratio = F.log((F.col("ft") + (1 - F.col("st")) * F.col("pt")) / (F.col("fo") + (1 - F.col("so")) * F.col("po")))
    told = pairs.join(sums(pairs), "v").where(F.abs(ratio - F.log(F.col("pt") / F.col("po"))) >= F.lit(float(np.log(factor)))).select(*pairs.columns)
    leaves = sums(told).where("so < 1 and st < 1")
    told = told.join(leaves, "v")
    table = words_.select(F.lit(0).alias("kind"), F.col("w").alias("key"), F.log(F.col("pt") / F.col("po")).alias("r"))
    table = table.unionByName(told.select(F.lit(1).alias("kind"), F.shiftleft("v", 32).bitwiseOR(F.col("w")).alias("key"), ratio.alias("r")))
    table = table.unionByName(leaves.select(F.lit(2).alias("kind"), F.col("v").alias("key"), F.log((1 - F.col("st")) / (1 - F.col("so"))).alias("r")))
    return Model(table, float(np.log(left_t / left_o)))


@dataclass(frozen=True)
class Sent:
    """A model as sorted arrays by kind, to travel to the tasks."""

    keys: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]
    rest: float

    @classmethod
    def of(cls, m: Model) -> Sent:
        rows = collected(m.table).sort_values("key")
        kinds = [rows[rows["kind"] == k] for k in range(3)]
        return cls(tuple(k["key"].to_numpy(np.int64) for k in kinds), tuple(k["r"].to_numpy(float) for k in kinds), m.rest)

    def look(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and which of them are there."""
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(key)), np.zeros(len(key), dtype=bool)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return self.values[kind][at], keys[at] == key

    def ratios(self, pairs: np.ndarray) -> np.ndarray:
        """The ratio of each bigram."""
        word, known = self.look(0, pairs & _LOW)
        out = np.where(known, word, self.rest)
        left, some = self.look(2, (pairs >> 32) & _LOW)
        # few words are contexts of a bigram with counts of its own
        at = np.flatnonzero(some)
        both, told = self.look(1, pairs[at])
        out[at] = np.where(told, both, out[at] + left[at])
        return out


def _normalised(texts: list[str | None], models: list[Sent]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-ratio per word of each text by each model, and the texts' numbers of words."""
    total, n = np.zeros((len(texts), len(models))), np.zeros(len(texts), dtype=np.int64)
    for at, pairs, owner in _blocks(texts):
        if not len(pairs):
            continue
        size = int(owner[-1]) + 1
        n[at : at + size] += np.bincount(owner, minlength=size)
        for k, m in enumerate(models):
            total[at : at + size, k] += np.bincount(owner, weights=m.ratios(pairs), minlength=size)
    return total / np.maximum(n, 1)[:, None], n


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that predicts y from x, by Newton steps with a small ridge."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(w[0] / scale), float(w[1])


@dataclass(frozen=True)
class ToxicityModel:
    """The chosen model over all training rows, the logistic, and the base rate; sent is None where the model is too large to travel."""

    model: Model
    sent: Sent | None
    slope: float
    offset: float
    base: float
    discount: float
    factor: float


def train(labelled: DataFrame, max_calibration: int = 10_000, discounts: tuple[float, ...] = (10.0, 20.0, 40.0), factors: tuple[float, ...] = (4.0,), most_rows: int = MOST_ROWS) -> ToxicityModel:
    """Fit from rows (text, y, part): the settings and the logistic on at most about max_calibration rows of part a (0), which the counts of that step leave out; then counts of all rows.

    Where part a has labels of one class alone, all rows stand for it.
    """
    spark = labelled.sparkSession
    table, path = scratch(gather(labelled))
    in_a = F.when(F.col("part") == 0, 1).otherwise(0)
    sums = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(in_a).alias("n_a"), F.sum(in_a * F.col("y")).alias("y_a")).first()
    base = sums["y"] / sums["n"] if sums["n"] else 0.0
    apart = 0 < (sums["y_a"] or 0) < (sums["n_a"] or 0)
    held_back = (labelled.where("part = 0") if apart else labelled).select("text", "y")
    n = sums["n_a"] if apart else sums["n"]
    if n > max_calibration:
        held_back = held_back.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.lit(int((1 << 40) * max_calibration / n)))
    counts, folders = counts_of(table, ("b",), min(discounts))
    settings = list(product(discounts, factors))
    tried = [_delivered(kneser_ney(counts, d, f), most_rows) for d, f in settings]
    seen = measured(held_back, tried)
    for folder in folders:
        discard(spark, folder)
    y = seen["y"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.0
    best = (np.inf, 0.0, float(np.log((base + 1e-9) / (1 - base + 1e-9))), settings[-1])
    for i, setting in enumerate(settings):
        if not 0 < share < 1:
            break
        x = seen[f"x{i}"].to_numpy(float)
        slope, offset = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))), 1e-12, 1 - 1e-12)
        loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        best = min(best, (loss, slope, offset, setting))
    _, slope, offset, (discount, factor) = best
    smaller = max(min(counts.ordinary, counts.toxic), 1.0)
    counts, folders = counts_of(table, ("a", "b"), discount)
    # the same relative frequency as where it was chosen, so that the logistic still fits
    discount *= max(min(counts.ordinary, counts.toxic) / smaller, 1.0)
    model = kneser_ney(counts, discount, factor)
    kept, _ = scratch(model.table)
    model, sent = _delivered(Model(kept, model.rest), most_rows)
    for folder in (*folders, path):
        discard(spark, folder)
    return ToxicityModel(model, sent, slope, offset, base, discount, factor)


def _delivered(model: Model, most_rows: int) -> tuple[Model, Sent | None]:
    """The model, and its arrays if its counted rows are few enough to travel."""
    rows = model.table.persist()
    few = rows.limit(most_rows + 1).count() <= most_rows
    sent = Sent.of(Model(rows, model.rest)) if few else None
    rows.unpersist()
    return model, sent


def measured(rows: DataFrame, models: list[tuple[Model, Sent | None]]) -> pd.DataFrame:
    """(y, x0, x1, ...) of a bounded number of rows (text, y) that have a word: mean log-ratio by each model."""
    out = rows.select("y", "text").withColumn("m", ratios("text", [s for _, s in models], rows.sparkSession)) if all(s for _, s in models) else _joined(rows, [m for m, _ in models])
    return collected(out.where("m.n > 0").select("y", *(F.col("m.x")[i].alias(f"x{i}") for i in range(len(models)))))


def ratios(text: str | Column, sent: list[Sent], spark: SparkSession) -> Column:
    """(x, n) of a text column: the mean log-ratio by each model, and the number of words."""
    models = spark.sparkContext.broadcast(sent)

    @F.pandas_udf("x array<double>, n long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, n = _normalised(list(part), models.value)
            yield pd.DataFrame({"x": list(x), "n": n})

    return of(F.col(text) if isinstance(text, str) else text)


def _joined(rows: DataFrame, models: list[Model]) -> DataFrame:
    """rows (text and others) with column m as ``ratios`` gives it, by joins of the texts' bigrams to the models' tables.

    Texts go by their digest, a bigram of a text as one row with its number; a word that
    very many texts share is a hot key of the large side, which AQE splits.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["name"], b["text"], strict=True):
                last = 0
                for piece in tokens.split(text if isinstance(text, str) else ""):
                    ids, first = words([piece])
                    if len(ids):
                        key, n = np.unique(_bigrams(ids, first, last), return_counts=True)
                        last = int(ids[-1])
                        yield pd.DataFrame({"name": name, "key": key, "n": n})

    named = rows.withColumn("_name", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    pairs = named.select(F.col("_name").alias("name"), "text").dropDuplicates(["name"]).mapInPandas(spread, "name string, key long, n long")
    pairs = pairs.groupBy("name", "key").agg(F.sum("n").alias("n"))
    word, context = F.col("key").bitwiseAND(F.lit(_LOW)), F.shiftright("key", 32).bitwiseAND(F.lit(_LOW))
    sums = []
    for i, m in enumerate(models):
        for kind, key in ((0, word), (1, F.col("key")), (2, context)):
            of = m.table.where(F.col("kind") == kind).select(F.col("key").alias(f"k{kind}_{i}"), F.col("r").alias(f"r{kind}_{i}"))
            pairs = pairs.join(of, key == F.col(f"k{kind}_{i}"), "left")
        ratio = F.coalesce(f"r1_{i}", F.coalesce(f"r0_{i}", F.lit(m.rest)) + F.coalesce(f"r2_{i}", F.lit(0.0)))
        sums.append(F.sum(ratio * F.col("n")))
    by_text = pairs.groupBy("name").agg(F.array(*sums).alias("x"), F.sum("n").alias("n"))
    by_text = by_text.select("name", F.struct(F.transform("x", lambda x: x / F.col("n")).alias("x"), "n").alias("m"))
    return named.join(by_text, named["_name"] == by_text["name"], "left").drop("_name", "name")


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (with a text) with column score, the probability of label 1."""
    if model.sent is not None:
        rows = docs.withColumn("m", ratios("text", [model.sent], docs.sparkSession))
    else:
        rows = _joined(docs, [model.model])
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(model.slope) * F.col("m.x")[0] + F.lit(model.offset)))
    return rows.withColumn("score", F.when(F.col("m.n") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(model.base))).drop("m")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learned from labelled rows whose crc32(doc_id) mod 5 is not 0; of these, remainder
    1 is the part that the settings and the logistic are fitted on.
    """
    docs = docs.select("doc_id", "text")
    part = fold("doc_id", 5)
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    y = small_or_shuffled(y.where(part != 0), 1_000_000)
    labelled = docs.where(part != 0).join(y, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", F.when(part == 1, 0).otherwise(1).alias("part"), "doc_id")
    # of equal texts one row counts: the least id of each digest is found without moving texts
    once = labelled.groupBy(F.xxhash64("text").alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    out = scored(docs, train(labelled.join(once, "doc_id", "left_semi").select("text", "y", "part")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
