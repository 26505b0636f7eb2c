"""A fixed rule that scores candidates, in place of a trained forest.

A terminator before white space or the end is a boundary unless it ends a known
abbreviation; so is a closing quote right after such a terminator, unless the next
word goes on in lower case.  Everything else scores too low for the default threshold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import CANDIDATES, CLOSING_QUOTES, PRIMARY, SPACE, once, pieces, places, running
from ..operators.segments import sentence_spans

THRESHOLD = 0.5
#: Characters after a candidate that decide about it.
AHEAD = 2


def reach(abbreviations: Iterable[str]) -> int:
    """Characters up to a candidate, itself included, that decide about it: the longest entry, one to see that the run is no longer, and a quote."""
    return max(map(len, abbreviations), default=0) + 2


def passes(p: Column, threshold: float) -> Column:
    """Whether a probability makes a boundary: more than an even chance at 0.5, else at least the threshold."""
    return p > 0.5 if threshold == 0.5 else p >= threshold


def score(c: Column, ends: Column, known: Column, closes: Column) -> Column:
    """Probability of a boundary at a character, from conditions that are looked at only where they matter.

    ends: white space or nothing follows; known: a full stop ends an abbreviation;
    closes: a quote closes a sentence, which then ended right before it.
    """
    return (
        F.when(c == "\n", 0.4)
        .when(~c.isin(*PRIMARY), F.when(c.isin(*CLOSING_QUOTES) & ends, F.when(closes, 0.9).when(c.isin('"', "”"), 0.3).otherwise(0.1)).otherwise(0.1))
        .when((c == ".") & known, 0.2)
        .when(ends, 0.9)
        .otherwise(0.3)
    )


def scored(docs: DataFrame, abbreviations: list[str], text: str = "text") -> DataFrame:
    """docs with array _scores: (pos, p) of every candidate, inside the row."""
    return docs.withColumn("_scores", _scores(text, abbreviations))


def _scores(text: str | Column, abbreviations: Sequence[str]) -> Column:
    """The text is cut after every candidate, so that the work goes by candidates and not by characters."""
    longest = max(map(len, abbreviations), default=0)

    def by_piece(cut: Column) -> Column:
        row = F.struct(cut.alias("cut"), places(cut).alias("at"))
        return once(row, lambda r: F.transform(r["at"], lambda pos, i: one(r["cut"], pos, i)))

    def known_at(cut: Column, i: Column) -> Column:
        """Whether the run that ends piece i, a full stop at its end, is an abbreviation; full stops are candidates, so a run such as "U.S." may begin some pieces before."""
        if not longest:
            return F.lit(False)
        piece = F.element_at(cut, i + 1)
        own = F.regexp_extract(piece, _RUN, 0)
        whole = F.array_join(F.slice(cut, F.greatest(i + 1 - longest, F.lit(1)), F.least(i + 1, F.lit(longest + 1))), "")
        run = F.when(own != piece, own).otherwise(F.regexp_extract(F.right(whole, F.lit(longest + 1)), _RUN, 0))
        return run.isin(*abbreviations)

    def one(cut: Column, pos: Column, i: Column) -> Column:
        piece, nxt = F.element_at(cut, i + 1), F.element_at(cut, i + 2)
        following = F.when(nxt != "", F.left(nxt, F.lit(1)))
        ends = following.isNull() | following.isin(" ", "\n", "\t")
        goes_on = F.substring(F.concat(nxt, F.coalesce(F.try_element_at(cut, i + 3), F.lit(""))), 2, 1).rlike(r"\p{Ll}")
        last = F.when((i > 0) & (F.length(piece) == 1), F.right(F.element_at(cut, F.greatest(i, F.lit(1))), F.lit(1)))
        closes = F.coalesce(last.isin(*PRIMARY), F.lit(False)) & ~goes_on & ~((last == ".") & known_at(cut, F.greatest(i - 1, F.lit(0))))
        p = once(F.right(piece, F.lit(1)), lambda c: score(c, ends, known_at(cut, i), closes))
        return F.struct(pos.alias("pos"), p.alias("p"))

    return once(pieces(text), by_piece)


def spoken_places(text: str, begin: int, upto: int, abbreviations: frozenset[str], threshold: float = THRESHOLD) -> Iterator[int]:
    """The boundaries at characters begin to upto of one text, for streams, where a text is at hand piece by piece; a test holds it to ``boundaries``."""
    longest = max(map(len, abbreviations), default=0)
    for m in _MARK.finditer(text, begin, upto):
        i, c = m.start(), m.group()
        ends = text[i + 1 : i + 2] in ("", " ", "\n", "\t")
        known = lambda at: text[at] == "." and _run_before(text, at, longest) in abbreviations
        if c == "\n":
            p = 0.4
        elif c in PRIMARY:
            p = 0.2 if known(i) else 0.9 if ends else 0.3
        elif c in CLOSING_QUOTES and ends:
            closes = i > 0 and text[i - 1] in PRIMARY and unicodedata.category(text[i + 2 : i + 3] or " ") != "Ll" and not known(i - 1)
            p = 0.9 if closes else 0.3 if c in '"”' else 0.1
        else:
            p = 0.1
        if p > 0.5 if threshold == 0.5 else p >= threshold:
            yield i + 1


def _run_before(text: str, i: int, longest: int) -> str:
    start = i
    while start > max(i - longest, 0) and (text[start - 1] == "." or unicodedata.category(text[start - 1])[0] in "LN"):
        start -= 1
    return text[start : i + 1]


_MARK = re.compile("[" + "".join(CANDIDATES) + "]")


def sentence_end(abbreviations: Sequence[str]) -> str:
    """A regular expression of the empty place after every boundary at the default threshold."""
    known = "|".join(re.escape(a) for a in abbreviations if a.endswith("."))
    quotes = "[" + "".join(CLOSING_QUOTES) + "]"
    free = (rf"(?<!(?<![\p{{L}}\p{{N}}.])(?:{known}){q})" if known else "" for q in ("", quotes))
    return rf"(?:(?<=[.!?]){next(free)}(?=[ \n\t]|\z)|(?<=[.!?]{quotes}){next(free)}(?=\z|[ \n\t](?!\p{{Ll}})))"


_RUN = r"[\p{L}\p{N}.]*\z"


#: A list of more entries is looked up candidate by candidate and not put into one pattern.
IN_PATTERN = 500


def _parts(text: str | Column, abbreviations: Sequence[str]) -> Column:
    """The text between its boundaries at the default threshold, by one split; the last part is what follows the last boundary, be it empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(c, F.lit("")), sentence_end(abbreviations), -1)


def boundaries(text: str | Column, abbreviations: list[str] | None = None, threshold: float = THRESHOLD) -> Column:
    """Array of the boundaries of a text by the rule."""
    known = abbreviations or []
    if threshold == THRESHOLD and len(known) <= IN_PATTERN:
        ends = running(F.transform(_parts(text, known), F.length))
        return once(ends, lambda e: F.slice(e, F.lit(1), F.size(e) - 1))
    kept = F.filter(_scores(text, known), lambda s: passes(s["p"], threshold))
    return F.transform(kept, lambda s: s["pos"] + 1)


def rule_sentences(docs: DataFrame, abbreviations: list[str] | None = None, threshold: float = THRESHOLD, text: str = "text", blank: bool = True) -> DataFrame:
    """``sentence_spans`` of the rule's boundaries; at the default threshold one split gives the sentences themselves, and places are sums of their lengths."""
    known = abbreviations or []
    if threshold != THRESHOLD or len(known) > IN_PATTERN:
        return sentence_spans(rule_boundaries(docs, known, threshold, text), "bounds", text, blank)
    parts = F.filter(_parts(text, known), lambda x: x != "")
    placed = once(parts, lambda p: F.zip_with(p, running(F.transform(p, F.length)), lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("sentence"))))
    if not blank:
        placed = F.filter(placed, lambda s: ~s["sentence"].rlike(rf"^{SPACE}*\z"))
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(placed).alias("ord", "_s")).select(*others, "ord", "_s.*")


def rule_boundaries(docs: DataFrame, abbreviations: list[str] | None = None, threshold: float = THRESHOLD, text: str = "text", into: str = "bounds") -> DataFrame:
    """docs with the array of boundaries (places after the boundary characters) by the rule."""
    return docs.withColumn(into, boundaries(text, abbreviations, threshold))
