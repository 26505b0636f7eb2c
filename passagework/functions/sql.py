"""SQL names for the engine: temporary functions over the rule at its default threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..operators.abbreviations import DEFAULT
from ..plans.rules import sentence_end
from .chars import SPACE


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _sums(sizes: str) -> str:
    """Sums up to each element of an array of integers, in two levels."""
    total = "aggregate({}, 0, (a, x) -> a + x)".format
    chunk = "slice(n, c * 64 + 1, 64)"
    chunks = "sequence(0, cast(floor((size(n) - 1) / 64) as int))"
    inner = f"transform({chunk}, (x, i) -> element_at(w, c + 1) + {total(f'slice({chunk}, 1, i + 1)')})"
    starts = f"transform({chunks}, c -> {total('slice(n, 1, c * 64)')})"
    some = f"element_at(transform(array({starts}), w -> flatten(transform({chunks}, c -> {inner}))), 1)"
    return f"element_at(transform(array({sizes}), n -> if(size(n) > 0, {some}, array())), 1)"


def register(spark: SparkSession, abbreviations: Sequence[str] = DEFAULT) -> None:
    """Scalar functions split_sentences(text) and sentence_bounds(text), and table functions sentence_rows(text) and paragraph_rows(text).

    They give the sentences of ``sentence_spans``, the places of ``rule_boundaries``, and
    the rows (ord, start, end, and sentence or paragraph) of ``sentence_spans`` and
    ``paragraph_spans``; table functions follow a table as LATERAL.  The text is cut once
    by the expression of its ends; places are sums of lengths in two levels.  Null and
    empty texts have no rows.
    """
    end = sentence_end(abbreviations)
    cut = f"split(coalesce(t, ''), {_literal(end)}, -1)"
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    # the last piece is what follows the last boundary
    spark.sql(f"{create} split_sentences(t STRING) RETURNS ARRAY<STRING> RETURN filter({cut}, x -> x <> '')")
    spark.sql(f"{create} sentence_bounds(t STRING) RETURNS ARRAY<INT> RETURN element_at(transform(array({_sums(f'transform({cut}, x -> length(x))')}), s -> slice(s, 1, size(s) - 1)), 1)")
    # pieces with their places, as one array, so that each row of a table function is an element
    placed = lambda pieces: f"element_at(transform(array(filter({pieces}, x -> x <> '')), p -> zip_with(p, {_sums('transform(p, x -> length(x))')}, (x, e) -> named_struct('start', e - length(x), 'end', e, 'piece', x))), 1)"
    spark.sql(
        f"""{create} sentence_rows(t STRING) RETURNS TABLE(ord INT, `start` INT, `end` INT, sentence STRING)
        RETURN SELECT s.pos, s.col.start, s.col.`end`, s.col.piece FROM posexplode({placed(cut)}) AS s"""
    )
    blank = rf"{end}(?=(?s:.{{0,3}})\n{SPACE}*\n)"
    edges = _literal(rf"^{SPACE}+|{SPACE}+\z")
    parts = f"transform({placed(f'split(coalesce(t, {chr(39) * 2}), {_literal(blank)}, -1)')}, x -> named_struct('start', x.start, 'end', x.`end`, 'text', regexp_replace(x.piece, {edges}, '')))"
    # a text without any boundary is one paragraph, be it blank
    whole = f"filter({parts}, (x, i) -> x.text <> '' OR size({cut}) = 1)"
    spans = f"transform(f, (x, i) -> named_struct('start', if(i = 0, 0, x.start), 'end', if(i = size(f) - 1, length(t), try_element_at(f, i + 2).start), 'text', x.text))"
    spark.sql(
        f"""{create} paragraph_rows(t STRING) RETURNS TABLE(ord INT, `start` INT, `end` INT, paragraph STRING)
        RETURN SELECT s.pos, s.col.start, s.col.`end`, s.col.text FROM posexplode(element_at(transform(array({whole}), f -> {spans}), 1)) AS s"""
    )
