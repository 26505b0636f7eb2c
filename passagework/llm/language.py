"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character n-grams, learned from
labelled texts.  A document is a mixture of languages at the level of words: the
likelihood of a word under a language is that of its n-grams, and expectation
maximisation estimates the document's language proportions.  The set of languages
is grown from the best single one while the penalised likelihood improves.

Defined results: null text, empty text and text without any letter give ``und``
with score 0 and no proportions; letters outside every alphabet that is read speak for
all languages alike; if nothing can be learned (no labelled row) every
text gives ``und``.  Ties between languages fall to the smaller name.  Repeated
rows are scored alike, and columns of the input are passed through untouched.
A text of more than a million characters is inferred piece by piece, and its proportions
are those of its pieces, weighed by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import fold, fresh

UNDETERMINED = "und"
#: Languages that a model can hold.
MOST_LANGUAGES = 1_000
RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>"


@dataclass(frozen=True)
class LanguageModel:
    """languages: sorted names; log_p: per hashed n-gram and language, bits ** 2 rows."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    bits: int
    orders: tuple[int, ...]


def _grams(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams at each code point (one column per order), the code points, the texts' offsets.

    Digits count as one digit, and everything that is neither a letter nor a digit as
    a space, so that marks and numbers say little about the language.
    """
    lowered = [t.lower() for t in texts]
    code, offsets = tokens.codes(lowered)
    code = _plain(code)
    out = np.zeros((len(code), len(orders)), dtype=np.int32)
    for k, n in enumerate(orders):
        h = tokens.gram_hashes(code, n)
        out[: len(h), k] = (h >> np.uint64(64 - bits)).astype(np.int32)
    return out, code, offsets


def _plain(code: np.ndarray) -> np.ndarray:
    code = code.copy()
    code[(code < 97) | ((code > 122) & (code < 0xAA)) | (code == 0xD7) | (code == 0xF7) | ((code >= 0x2000) & (code < 0x2C00)) | ((code >= 0x3000) & (code < 0x3040))] = 32
    return code


def even_share(sizes: list[int], most: int) -> float:
    """The level at which sizes (sorted) that are cut to it add up to most."""
    left = most
    for i, n in enumerate(sizes):
        level = left / (len(sizes) - i)
        if n > level:
            return level
        left -= n
    return float(sizes[-1]) if sizes else 0.0


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_rows: int = 12_000,
    bits: int = 16,
    orders: tuple[int, ...] = (2, 3, 4),
    seed: int = 7,
    most: int = MOST_LANGUAGES,
) -> LanguageModel:
    """Learn from about max_rows labelled rows, drawn by a hash of the text, whole texts each.

    max_rows bounds what is learned from: all rows where there are no more, and else
    the same number of each language, or all that a language has.  More than ``most``
    languages fail, as a model holds a column for each.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages")
    if sum(sizes.values()) > max_rows:
        level = even_share(sorted(sizes.values()), max_rows)
        limits = [x for l, n in sorted(sizes.items()) for x in (F.lit(l), F.lit(int((1 << 40) * min(1.0, level / n))))]
        rows = rows.where(F.pmod(F.xxhash64("t", "l", F.lit(seed)), F.lit(1 << 40)) < F.element_at(F.create_map(*limits), F.col("l")))
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, part in b.groupby("l"):
                for _, texts, _ in tokens.bounded(list(part["t"])):
                    g, code, _ = _grams(texts, orders, bits)
                    keep = code != 32
                    if name not in held:
                        held[name] = np.zeros((len(orders), size), dtype=np.int64)
                    for k in range(len(orders)):
                        held[name][k] += np.bincount(g[keep, k], minlength=size)
        for name, c in held.items():
            yield pd.DataFrame({"l": [name], "c": [c.tobytes()]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        c = sum(np.frombuffer(x, dtype=np.int64) for x in part["c"])
        return pd.DataFrame({"l": [part["l"].iloc[0]], "c": [c.astype(np.float32).tobytes()]})

    got = rows.repartition(8).mapInPandas(count, "l string, c binary").groupBy("l").applyInPandas(total, "l string, c binary").collect()
    got = sorted(got, key=lambda r: r["l"])
    if not got:
        return LanguageModel((), np.zeros((len(orders), size, 0), dtype=np.float32), bits, orders)
    counts = np.stack([np.frombuffer(r["c"], dtype=np.float32).reshape(len(orders), size) for r in got], axis=2)
    counts = counts + 0.1
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(tuple(r["l"] for r in got), log_p, bits, orders)


def _word_likelihoods(texts: list[str], m: LanguageModel, temper: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word by language, and each text's first word (one more than texts)."""
    g, code, offsets = _grams(texts, m.orders, m.bits)
    starts, ends = tokens.runs(code != 32)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros((0, len(m.languages))), first
    per = m.log_p[0][g[:, 0]]
    for k in range(1, len(m.orders)):
        per = per + m.log_p[k][g[:, k]]
    # a gram that starts outside words carries nothing
    per[code == 32] = 0
    sums = np.add.reduceat(per, starts, axis=0, dtype=np.float64)
    return sums * (temper / len(m.orders)), first


def _em(like: np.ndarray, first: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text after so many steps; like: word likelihoods, largest 1."""
    n = np.diff(first)
    some = n > 0
    at = first[:-1][some]
    of = np.repeat(np.arange(len(n)), n)
    for _ in range(steps):
        w = like * pi[of]
        w /= w.sum(axis=1, keepdims=True)
        pi = pi.copy()
        pi[some] = np.add.reduceat(w, at, axis=0) / n[some, None]
        pi = np.maximum(pi, 1e-9) * (pi > 0)
    ll = np.zeros(len(n))
    ll[some] = np.add.reduceat(np.log((like * pi[of]).sum(axis=1)), at)
    return pi, ll


def infer(texts: list[str], m: LanguageModel, penalty: float = 3.0, temper: float = 0.5, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text under its chosen language set, and the number of words."""
    ll, first = _word_likelihoods(texts, m, temper)
    n, k = np.diff(first), len(m.languages)
    pi = np.zeros((len(n), k))
    some = np.flatnonzero(n > 0)
    if not k or not len(some):
        return pi, n
    at = first[:-1][some]
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -30.0))
    single = np.zeros((len(n), k))
    single[some] = np.add.reduceat(np.log(like), at, axis=0)
    best = single.argmax(axis=1)
    pi[some, best[some]] = 1.0
    value = single[np.arange(len(n)), best]
    price = penalty * np.log1p(n)
    # the likelihood over all languages bounds that of every set, so most texts end here
    _, full = _em(like, first, np.full((len(n), k), 1.0 / k), steps)
    chosen = pi > 0
    open_ = np.flatnonzero((n > 0) & (full - value > price))
    while len(open_):
        sub = np.concatenate([np.arange(first[i], first[i + 1]) for i in open_])
        of = np.concatenate(([0], np.cumsum(n[open_])))
        gain = np.full(len(open_), -np.inf)
        grown = pi[open_].copy()
        pick = np.full(len(open_), -1)
        for j in range(k):
            trial = chosen[open_].copy()
            fits = ~trial[:, j]
            trial[:, j] = True
            p, v = _em(like[sub], of, trial / trial.sum(axis=1, keepdims=True), steps)
            more = np.where(fits, v - value[open_], -np.inf)
            better = more > gain
            gain, pick = np.where(better, more, gain), np.where(better, j, pick)
            grown[better] = p[better]
        yes = gain > price[open_]
        took = open_[yes]
        value[took] += gain[yes]
        pi[took] = grown[yes]
        chosen[took, pick[yes]] = True
        open_ = took[chosen[took].sum(axis=1) < k]
    return pi, n


def _inferred(texts: list[str | None], m: LanguageModel, penalty: float, temper: float) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts in blocks with ``infer``'s results; the proportions of a very long text are those of its pieces, weighed by their words."""
    held: list[tuple[str, np.ndarray, int]] = []
    last = -1
    for at, block, piece in tokens.bounded(texts):
        if held and at != last:
            yield _together(held, m)
            held = []
        pi, n = infer(block, m, penalty, temper)
        if piece:
            held.append((block[0], pi[0], int(n[0])))
            last = at
        else:
            yield block, pi, n
    if held:
        yield _together(held, m)


def _together(held: list[tuple[str, np.ndarray, int]], m: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = sum(k for _, _, k in held)
    pi = sum((p * k for _, p, k in held), np.zeros(len(m.languages))) / max(n, 1)
    letters = next((t for t, _, _ in held if any(map(str.isalpha, t))), "")
    return [letters], pi[None, :], np.array([n])


def identify(text: str | Column, model: LanguageModel, penalty: float = 3.0, temper: float = 0.5) -> Column:
    """A struct column (lang_pred, score, languages, proportions) for a text column.

    score is the share of the document that the named language has; languages and
    proportions list the chosen set, largest share first.
    """
    names = np.array(model.languages, dtype=object)
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for part in parts:
            rows: list[tuple] = []
            for texts, pi, n in _inferred(list(part), m, penalty, temper):
                for t, p, words in zip(texts, pi, n, strict=True):
                    if not len(names) or not any(map(str.isalpha, t)):
                        rows.append((UNDETERMINED, 0.0, [], []))
                        continue
                    if not words:
                        # letters of no known alphabet speak for every language alike
                        p = np.full(len(names), 1 / len(names))
                    order = [i for i in np.lexsort((np.arange(len(p)), -p)) if p[i] > 0]
                    rows.append((names[order[0]], float(min(1.0, p[order[0]])), list(names[order]), [float(x) for x in p[order]]))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "proportions"])

    c = F.col(text) if isinstance(text, str) else text
    return label(c)


def with_language(docs: DataFrame, model: LanguageModel, into: str, text: str = "text") -> DataFrame:
    """docs with one more column, the struct of ``identify``."""
    return docs.withColumn(into, identify(text, model))


def op7_language(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score and the language set.

    Learned from rows whose crc32(doc_id) mod 4 is not 2; those with 2 are held out.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 4) != 2))
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), identify("text", model).alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score", F.array_join("r.languages", "+").alias("languages"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; ``und`` ones go.  Columns stay as they are."""
    model = train(docs.where(fold("doc_id", 4) != 2))
    name = fresh(docs, "language_")
    return with_language(docs, model, name).where(F.col(name)["lang_pred"] != UNDETERMINED).drop(name)
