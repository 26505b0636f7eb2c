"""Documents that arrive in pieces: whole documents in micro-batches, or pieces of documents larger than a row.

Scoring is a projection of a row, so a stream of whole documents needs no state.  For
documents cut into pieces, a boundary depends on some characters before and after it
(``rule_reach``, ``forest_reach``), and for a forest also on the quotes before the
piece and the number of candidates in the whole document.  Each piece is scored with
what it needs of its neighbours, and only decisions on its own characters count, so
nothing is lost or found twice at the cuts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import CANDIDATES, exploded, once, quotes_in, running
from ..functions.features import reach
from ..operators import forest
from ..operators.abbreviations import DEFAULT
from ..plans import rules

#: Parts whose counts are summed up in one group of the prefix scan.
BLOCK = 1024
_QUOTES = ("straight", "opened", "closed", "single", "single_opened", "single_closed")
_ANY = "[" + "".join(CANDIDATES) + "]"


def rule_reach(abbreviations: Iterable[str] = DEFAULT) -> tuple[int, int]:
    """Characters before and after a piece that the rule looks at."""
    return rules.reach(abbreviations), rules.AHEAD


def forest_reach(config: forest.Config) -> tuple[int, int]:
    """Characters before and after a piece that the features of a forest look at."""
    near = max(2 * config.left, 2 * config.right, reach(list(config.abbreviations)))
    return near, near


def _counts(text: str | Column) -> Column:
    """Struct of quotes by kind and candidates of a piece."""
    t = F.col(text) if isinstance(text, str) else text
    return F.struct(*(quotes_in(t)[q].alias(q) for q in _QUOTES), F.regexp_count(t, F.lit(_ANY)).alias("candidates"))


def cut(docs: DataFrame, size: int = 10_000, key: str = "doc_id", text: str = "text", around: tuple[int, int] | None = None, carry: bool = False) -> DataFrame:
    """(key, part, offset, text, before, after): pieces of at most so many characters with those around them; with carry also carried, as ``seen`` takes it.

    A text is cut in one pass by a regular expression, and the pieces find their
    surroundings among their neighbours in the same row, so that nothing is shuffled.
    """
    behind, ahead = around or rule_reach()
    whole = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))

    def with_neighbours(w: Column, carried: Column | None) -> Column:
        def one(p: Column, i: Column) -> Column:
            back, on = -(-behind // size), -(-ahead // size)
            before = F.array_join(F.slice(w, F.greatest(i + 1 - back, F.lit(1)), F.least(i, F.lit(back))), "")
            after = F.array_join(F.slice(w, i + 2, F.lit(on)), "")
            more = [] if carried is None else [F.element_at(carried, i + 1).alias("carried")]
            return F.struct(i.alias("part"), (i * size).alias("offset"), p.alias("text"), F.right(before, F.lit(behind)).alias("before"), F.left(after, F.lit(ahead)).alias("after"), *more)

        return F.transform(w, one)

    def summed(w: Column) -> Column:
        field = lambda q: lambda x: x[q]
        return once(F.transform(w, _counts), lambda n: once(F.struct(*(running(F.transform(n, field(q))).alias(q) for q in (*_QUOTES, "candidates")), n.alias("n")), carried_by_part))

    def carried_by_part(sums: Column) -> Column:
        upto = lambda q, i: F.element_at(sums[q], i + 1) - F.element_at(sums["n"], i + 1)[q]
        return F.transform(sums["n"], lambda _, i: F.struct(*(upto(q, i).alias(q) for q in _QUOTES), F.element_at(sums["candidates"], -1).alias("candidates")))

    row = once(whole, lambda w: once(summed(w), lambda c: with_neighbours(w, c)) if carry else with_neighbours(w, None))
    parts = docs.select(key, F.explode(row).alias("_p"))
    return parts.select(key, "_p.part", "_p.offset", F.col("_p.text").alias(text), "_p.before", "_p.after", *(["_p.carried"] if carry else []))


def adjoined(pieces: DataFrame, key: str = "doc_id", text: str = "text", around: tuple[int, int] | None = None, carry: bool = False) -> DataFrame:
    """Pieces (key, part, offset, text) that came without their surroundings, with before and after from their neighbours, and carried where asked.

    The parts of a key are numbered from 0, without gaps or repeats, and hold text.  A
    document may be as large as it likes: its pieces are joined by (key, part) with
    ends that their neighbours send, and counts are summed up in two passes, over
    blocks of BLOCK parts and inside them, so that no task holds a document's text or
    all of its counts.
    """
    behind, ahead = around or rule_reach()
    at, part = [key, "part"], pieces.schema["part"].dataType
    # an end may reach over several short pieces, so each sends its ends to as many neighbours as can need them; nothing reaches over a last piece, however short
    sizes = pieces.select(key, "part", F.length(text).alias("n"))
    sizes = sizes.join(sizes.select(key, (F.col("part") - 1).cast(part).alias("part")), at, "left_semi").agg(F.max("part").alias("last"), F.min("n").alias("n")).first()
    hops = max(1, min(-(-max(behind, ahead) // max(sizes["n"] or 1, 1)), (sizes["last"] or 0) + 1))

    def sent(side: int, name: str, end: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(hops)), lambda k: F.struct((F.col("part") + side * k).cast(part).alias("part"), (-side * k).alias("k"), F.lit(name).alias("side"), end.alias("t")))

    notes = pieces.select(key, F.explode(F.concat(sent(1, "before", F.right(text, F.lit(behind))), sent(-1, "after", F.left(text, F.lit(ahead))))).alias("_n")).select(key, "_n.*")
    joined = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("k", "t")))), lambda x: x["t"]), "")
    found = notes.groupBy(*at).agg(F.right(joined("before"), F.lit(behind)).alias("before"), F.left(joined("after"), F.lit(ahead)).alias("after"))
    if carry:
        found = found.join(_carried(pieces, key, text), at, "right")
    return pieces.join(found, at, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})


def _carried(pieces: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, carried) by a prefix scan: sums by block, running sums over blocks, running sums inside blocks."""
    names = (*_QUOTES, "candidates")
    counts = pieces.select(key, "part", F.floor(F.col("part") / BLOCK).alias("_block"), _counts(F.coalesce(F.col(text), F.lit(""))).alias("_c")).select(key, "part", "_block", "_c.*")
    blocks = counts.groupBy(key, "_block").agg(*(F.sum(n).alias(n) for n in names))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(key, "_block", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in _QUOTES), F.sum("candidates").over(Window.partitionBy(key)).alias("_candidates"))
    inside = Window.partitionBy(key, "_block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select(key, "part", "_block", *(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in _QUOTES))
    carried = F.struct(*((F.col(n) + F.col(f"_{n}")).alias(n) for n in _QUOTES), F.col("_candidates").alias("candidates"))
    return rows.join(base, [key, "_block"]).select(key, "part", carried.alias("carried"))


def _own(found: Column, text: str) -> Column:
    """Boundaries of before + text + after that belong to the text, as places of the document."""
    row = F.struct(found.alias("at"), F.length("before").alias("b"), F.length(text).alias("n"), F.col("offset").alias("offset"))
    return once(row, lambda r: F.transform(F.filter(r["at"], lambda x: (x > r["b"]) & (x <= r["b"] + r["n"])), lambda x: r["offset"] + x - r["b"]))


def chunked_boundaries(pieces: DataFrame, abbreviations: list[str] | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bound): boundaries of whole documents by the rule, found piece by piece; pieces as ``cut`` or ``adjoined`` gives them with the reach of these abbreviations."""
    found = rules.boundaries(F.concat("before", text, "after"), abbreviations, threshold)
    return pieces.select(key, F.explode(_own(found, text)).alias("bound"))


def chunked_forest(pieces: DataFrame, config: forest.Config, trees: forest.Trees, threshold: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bound): boundaries of whole documents by a forest, found piece by piece; pieces as ``cut`` or ``adjoined`` gives them with ``forest_reach`` and carry."""
    ahead = quotes_in(F.col("before"))
    carried = F.struct(*((F.col("carried")[q] - ahead[q]).alias(q) for q in _QUOTES), F.col("carried")["candidates"].alias("candidates"))
    found = forest.boundaries(pieces.select(key, "offset", text, "before", "after", "carried"), config, trees, threshold, F.concat("before", text, "after"), "_found", carried)
    return exploded(found.select(key, _own(F.col("_found"), text).alias("_own")), "_own", "bound").drop("_own")


def sentence_stream(docs: DataFrame, abbreviations: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Sentences of a stream (or table) of whole documents, without state."""
    return rules.rule_sentences(docs, list(DEFAULT) if abbreviations is None else abbreviations, threshold)
