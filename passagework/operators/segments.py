"""From boundaries to tagged texts, sentences, paragraphs and spans.

All operators work inside a document's row on arrays of characters and boundaries, so
none of them shuffles; the exploded forms give one row per segment.  Null and empty
texts have no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import PARAGRAPH_MARKS, SPACE, characters, once
from ..functions.labels import PARAGRAPH_TAG, SENTENCE_TAG

_EDGE = rf"^{SPACE}+|{SPACE}+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _cuts(bounds: Column, n: Column) -> Column:
    """0, the boundaries inside, and the end."""
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(bounds, lambda b: (b > 0) & (b < n)), F.array(n))))


def _spans(bounds: Column, n: Column) -> Column:
    cuts = _cuts(bounds, n)
    size = F.size(cuts)
    pairs = F.zip_with(F.slice(cuts, F.lit(1), size - 1), F.slice(cuts, F.lit(2), size - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<start: int, end: int>>"))


def sentence_spans(docs: DataFrame, bounds: str = "bounds", text: str = "text", blank: bool = True) -> DataFrame:
    """One row per sentence: other columns of docs, ord, start, end, sentence.

    With blank, spans cover the whole text; without, sentences of white space alone
    are left out and leave gaps.
    """
    others = [c for c in docs.columns if c not in (bounds, text)]
    row = F.struct(characters(text).alias("ch"), F.col(bounds).alias("b"))
    named = once(row, lambda r: F.transform(_spans(r["b"], F.size(r["ch"])), lambda s: _sentence(r["ch"], s)))
    if not blank:
        named = F.filter(named, lambda s: ~s["sentence"].rlike(rf"^{SPACE}*\z"))
    return docs.select(*others, F.posexplode(named).alias("ord", "_s")).select(*others, "ord", "_s.*")


def _sentence(ch: Column, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array_join(F.slice(ch, s["start"] + 1, s["end"] - s["start"]), "").alias("sentence"))


def tagged(docs: DataFrame, bounds: str = "bounds", text: str = "text", into: str = "tagged") -> DataFrame:
    """docs with the text in which tags follow the boundary characters.

    A line end gets a paragraph tag as well; a straight quote that touches the next
    word gets none.
    """
    row = F.struct(characters(text).alias("ch"), F.col(bounds).alias("b"))
    return docs.withColumn(into, once(row, lambda r: _tagged(r["ch"], r["b"])))


def _tagged(ch: Column, bounds: Column) -> Column:
    n = F.size(ch)
    at_end = F.array_contains(bounds, n)

    def written(s: Column) -> Column:
        piece = F.array_join(F.slice(ch, s["start"] + 1, s["end"] - s["start"]), "")
        last, following = F.element_at(ch, s["end"]), F.try_element_at(ch, s["end"] + 1)
        glued = (last == '"') & following.isNotNull() & ~following.isin(" ", "\n", "\t")
        paragraph = F.when(last.isin(*PARAGRAPH_MARKS), F.lit(PARAGRAPH_TAG)).otherwise("")
        return F.when((s["end"] < n) | at_end, F.concat(piece, F.when(glued, F.lit("")).otherwise(SENTENCE_TAG), paragraph)).otherwise(piece)

    return F.array_join(F.transform(_spans(bounds, n), written), "")


def sentences(docs: DataFrame, bounds: str = "bounds", text: str = "text") -> DataFrame:
    """One row per sentence of the list form: cut at sentence tags, lone quotes given to a neighbour."""
    others = [c for c in docs.columns if c not in (bounds, text)]
    rows = tagged(docs, bounds, text, "_tagged")
    parts = F.transform(F.split("_tagged", r"<\|sentence\|>", -1), lambda s, i: F.when(i > 0, F.replace(s, F.lit(PARAGRAPH_TAG), F.lit(""))).otherwise(s))
    listed = rows.withColumn("_parts", F.filter(parts, lambda s: F.length(s) > 0))
    return listed.select(*others, F.posexplode(repair_quotes(F.col("_parts"))).alias("ord", "sentence"))


def repair_quotes(parts: Column) -> Column:
    """Lone quotes between segments joined to the segment that they belong to."""
    quote = lambda s: strip(s) == '"'

    def step(acc: Column, _: Column) -> Column:
        arr, i = acc["arr"], acc["i"]
        n = F.size(arr)
        here, nxt, after = (F.try_element_at(arr, i + k) for k in (1, 2, 3))
        first = (i < n - 1) & here.endswith('"') & F.coalesce(quote(nxt), F.lit(False)) & after.isNotNull()
        second = (i < n - 1) & quote(here)
        upto = F.slice(arr, F.lit(1), i)
        rest = lambda k: F.slice(arr, i + k, F.greatest(n - i - k + 1, F.lit(0)))
        return F.struct(
            F.when(first, F.concat(upto, F.array(here, F.concat(F.lit('" '), after)), rest(4))).when(second, F.concat(upto, F.array(F.concat(here, nxt)), rest(3))).otherwise(arr).alias("arr"),
            F.when(first | second, i).otherwise(i + 1).alias("i"),
        )

    start = F.struct(parts.alias("arr"), F.lit(0).alias("i"))
    done = F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, step)["arr"]
    return F.when(F.exists(parts, quote), done).otherwise(parts)


def paragraph_spans(docs: DataFrame, bounds: str = "bounds", text: str = "text") -> DataFrame:
    """One row per paragraph: other columns, ord, start, end, paragraph (stripped).

    A boundary ends a paragraph if a blank line starts at most three characters after
    it.  Spans cover the text; a paragraph of white space joins the one before.
    """
    others = [c for c in docs.columns if c not in (bounds, text)]
    row = F.struct(characters(text).alias("ch"), F.col(bounds).alias("b"))
    whole = once(row, lambda r: _paragraphs(r["ch"], r["b"]))
    return docs.select(*others, F.posexplode(whole).alias("ord", "_s")).select(*others, "ord", "_s.*")


def _paragraphs(ch: Column, bounds: Column) -> Column:
    n = F.size(ch)
    piece = lambda a, b: F.array_join(F.slice(ch, a + 1, b - a), "")
    ahead = rf"^(?s:.{{0,3}})\n{SPACE}*\n"
    ends = F.filter(bounds, lambda p: (p < n) & piece(p, F.least(p + 10, n)).rlike(ahead))
    parts = F.transform(_spans(ends, n), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), strip(piece(s["start"], s["end"])).alias("paragraph")))
    # a text without any boundary is one paragraph, be it blank
    full = F.filter(parts, lambda s: (s["paragraph"] != "") | (F.size(bounds) == 0))

    def joined(f: Column) -> Column:
        return F.transform(
            f,
            lambda s, i: F.struct(
                F.when(i == 0, 0).otherwise(s["start"]).alias("start"), F.when(i == F.size(f) - 1, n).otherwise(F.try_element_at(f, i + 2)["start"]).alias("end"), s["paragraph"].alias("paragraph")
            ),
        )

    return once(full, joined)


def corpus_statistics(segments: DataFrame, column: str, *by: str) -> DataFrame:
    """Count and mean length of segments by the given columns."""
    return segments.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.length(column)).alias("mean_length"))
