"""Characters: fixed sets, integer codes, candidate positions and their surroundings.

Places are code points from 0.  Null text is treated as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PRIMARY = (".", "!", "?")
SECONDARY = ('"', "”", "'", "’", ";", ":")
SENTENCE_MARKS = (*PRIMARY, *SECONDARY)
PARAGRAPH_MARKS = ("\n", "\r")
CANDIDATES = (*SENTENCE_MARKS, *PARAGRAPH_MARKS)
OPENING_QUOTES = ('"', "“", "'", "‘")
CLOSING_QUOTES = ('"', "”", "'", "’")
BULLETS = "•·○●■□▪▫"
LIST_CONJUNCTIONS = (" and ", " or ", " and/or ", " as well as ")
LIST_INTROS = ("following:", "as follows:", "include:", "including:", "such as:", "namely:", "listed below:", "items below:", "the following items:")
PADDING = -3
#: Code points that count as punctuation; fixed values, too.
PUNCTUATION = (
    0x26, 0x29, 0x2C, 0x2D, 0x2E, 0x3A, 0x3B, 0x5D, 0x5F, 0x7D, 0xBB, 0x5BE, 0x5BF, 0xF3B, 0xF3D, 0x1400, 0x169C, 0x1806, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2019, 0x201C, 0x201D,
    0x203A, 0x203F, 0x2040, 0x2046, 0x2054, 0x207E, 0x208E, 0x2309, 0x230B, 0x2769, 0x276B, 0x276D, 0x276F, 0x2771, 0x2773, 0x2775, 0x27C6, 0x27E7, 0x27E9, 0x27EB, 0x27ED, 0x27EF, 0x2984, 0x2986,
    0x2988, 0x298A, 0x298C, 0x298E, 0x2990, 0x2992, 0x2994, 0x2996, 0x2998, 0x29D9, 0x29DB, 0x29FD, 0x2E03, 0x2E05, 0x2E0A, 0x2E0D, 0x2E17, 0x2E1A, 0x2E1D, 0x2E21, 0x2E23, 0x2E25, 0x2E27, 0x2E29,
    0x2E3A, 0x2E3B, 0x2E40, 0x2E56, 0x2E58, 0x2E5A, 0x2E5C, 0x2E5D, 0x3009, 0x300B, 0x300D, 0x300F, 0x3011, 0x3015, 0x3017, 0x3019, 0x301B, 0x301C, 0x301E, 0x301F, 0x3030, 0x30A0, 0xFD3E, 0xFE18,
    0xFE31, 0xFE32, 0xFE33, 0xFE34, 0xFE36, 0xFE38, 0xFE3A, 0xFE3C, 0xFE3E, 0xFE40, 0xFE42, 0xFE44, 0xFE48, 0xFE4D, 0xFE4E, 0xFE4F, 0xFE58, 0xFE5A, 0xFE5C, 0xFE5E, 0xFE63, 0xFF09, 0xFF0D, 0xFF3D,
    0xFF3F, 0xFF5D, 0xFF60, 0xFF63, 0x10E2D,
)

_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
_COUNTED = [*map(str, range(1, 11)), *_ROMAN, *"abcdefghij"]
LIST_MARKERS = (*dict.fromkeys([*(f"({x})" for x in _COUNTED), *(f"{x}." for x in _COUNTED), *BULLETS]),)

#: White space as the engine strips it; Java's own \s and trim() know less.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
_BLANK = r"[\x20\t\xA0  -    　]"
_PUNCTUATION = "[" + "".join(rf"\x{{{p:X}}}" for p in PUNCTUATION) + "]"
#: Digits that are no decimal digits, such as superscripts and circled ones: first and last of each run of code points.
OTHER_DIGITS = (
    (0xB2, 0xB3), (0xB9, 0xB9), (0x1369, 0x1371), (0x19DA, 0x19DA), (0x2070, 0x2070), (0x2074, 0x2079), (0x2080, 0x2089), (0x2460, 0x2468), (0x2474, 0x247C), (0x2488, 0x2490), (0x24EA, 0x24EA),
    (0x24F5, 0x24FD), (0x24FF, 0x24FF), (0x2776, 0x277E), (0x2780, 0x2788), (0x278A, 0x2792), (0x10A40, 0x10A43), (0x10E60, 0x10E68), (0x11052, 0x1105A), (0x1F100, 0x1F10A),
)
_DIGITS = "".join(chr(c) for a, b in OTHER_DIGITS for c in range(a, b + 1))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, also where filters repeat the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def exploded(rows: DataFrame, array: Column | str, name: str, place: str | None = None) -> DataFrame:
    """One row per element, with its place where asked; unlike a plain explode of a column, never computes the array twice.

    Spark infers a filter on the size of an array column that is exploded, and pushes
    it down as the whole expression; outer explodes infer none.
    """
    out = rows.select("*", F.posexplode_outer(array).alias(place, name) if place else F.explode_outer(array).alias(name))
    return out.where(F.col(name).isNotNull())


def characters(text: str | Column) -> Column:
    """The text as an array of characters; empty for null and empty texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > 0, F.split(c, "", -1)).otherwise(F.array().cast("array<string>"))


def pieces(text: str | Column) -> Column:
    """The text cut after every candidate: each piece but the last ends in one.  [""] for null and empty texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(c, F.lit("")), "(?<=[" + "".join(CANDIDATES) + "])", -1)


def running(sizes: Column, width: int = 64) -> Column:
    """Sums up to each element of an array of integers, in two levels, so that many elements cost little more than few."""

    def sums(a: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int"))
        whole = F.transform(chunks, lambda c: F.aggregate(F.slice(a, c * width + 1, F.lit(width)), F.lit(0), lambda t, x: t + x))
        return once(whole, lambda w: F.flatten(F.transform(chunks, lambda c: inside(F.slice(a, c * width + 1, F.lit(width)), F.aggregate(F.slice(w, F.lit(1), c), F.lit(0), lambda t, x: t + x)))))

    def inside(part: Column, before: Column) -> Column:
        row = F.struct(part.alias("p"), before.alias("b"))
        return once(row, lambda r: F.transform(r["p"], lambda x, i: r["b"] + F.aggregate(F.slice(r["p"], F.lit(1), i + 1), F.lit(0), lambda t, y: t + y)))

    return once(sizes, lambda a: F.when(F.size(a) > 0, sums(a)).otherwise(F.array().cast("array<int>")))


def places(cut: Column) -> Column:
    """The places of the candidates of ``pieces``."""
    ends = running(F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), F.length))
    return F.transform(ends, lambda e: e - 1)


def encode(c: Column) -> Column:
    """The integer class of a character; plain integer tests decide for ASCII."""
    n = F.ascii(c)
    high = (
        F.when(c.rlike(r"^\p{L}"), F.ascii(F.lower(c)) - 96)
        .when(c.rlike(r"^\p{Nd}") | c.isin(*_DIGITS), 0)
        .when(c.isin("”", "’"), -1)
        .when(c.rlike("^" + _BLANK), -3)
        .when(c.rlike("^" + _PUNCTUATION), -4)
        .otherwise(-5)
    )
    return (
        F.when(n > 127, high)
        .when(n.between(97, 122), n - 96)
        .when(n.between(65, 90), n - 64)
        .when(n.between(48, 57), 0)
        .when(n.isin(*(ord(x) for x in SENTENCE_MARKS if ord(x) < 128)), -1)
        .when(n.isin(10, 13), -2)
        .when(n.isin(32, 9), -3)
        .when(n.isin(*map(ord, ")]},_&-")), -4)
        .otherwise(-5)
    )


def encode_one_hot(c: Column) -> Column:
    """The code point of a character."""
    return F.ascii(c)


def candidate_positions(text: str | Column) -> Column:
    """Array of the places of possible boundaries."""
    return once(pieces(text), places)


def _piece(ch: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(ch, start + 1, size), "")


def surroundings(docs: DataFrame, text: str = "text", everywhere: bool = False, left: int = 5, right: int = 5, mode: str = "reference", reach: int = 50, marks: Column | None = None) -> DataFrame:
    """One row per candidate, or per character: the columns of docs but text, and pos, c, before, after and quote counts.

    before and after hold up to ``reach`` characters, after from the place on.  In mode
    ``reference`` a text of at most 50 places is seen through a clipped context of
    2 * max(left, right) characters on both sides; ``full`` never clips.  marks: an
    array with a value for every character, of which column mark takes the place's.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.explode(seen(text, everywhere, left, right, mode, reach, marks)).alias("_s"))
    return rows.select(*others, "_s.*")


#: Quotes whose numbers up to a place count, with their names.
_QUOTES = {"straight": '"', "opened": "“", "closed": "”", "single": "'", "single_opened": "‘", "single_closed": "’"}


def quotes_in(text: Column) -> Column:
    """Struct of the numbers of quotes of each kind in a text."""
    return F.struct(*(_number(q)(text).alias(name) for name, q in _QUOTES.items()))


def seen(
    text: str | Column = "text", everywhere: bool = False, left: int = 5, right: int = 5, mode: str = "reference", reach: int = 50, marks: Column | None = None, carried: Column | None = None,
) -> Column:
    """The structs of ``surroundings`` as an array in the text's row.

    carried: for a text that is a piece of a longer one, a struct of the quotes before
    it (as ``quotes_in``) and ``candidates``, their number in the whole.
    """
    if mode not in ("reference", "full"):
        raise ValueError(f"unknown context mode {mode!r}")
    ch = characters(text)
    cut, at = (ch, F.transform(ch, lambda c, i: i)) if everywhere else (pieces(text), candidate_positions(text))
    # the quotes of each piece that ends in a place, summed up
    whole = F.col(text) if isinstance(text, str) else text
    counts = {name: F.when(F.contains(whole, F.lit(q)), running(F.transform(cut, _number(q)))).alias(name) for name, q in _QUOTES.items()}
    more = [x.alias(name) for x, name in ((marks, "marks"), (carried, "carried")) if x is not None]
    row = F.struct(ch.alias("ch"), at.alias("at"), *counts.values(), *more)
    return once(row, lambda r: _around(r, left, right, mode, reach, marks is not None, carried is not None))


def _number(q: str):
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(q), F.lit("")))


def _around(r: Column, left: int, right: int, mode: str, reach: int, marked: bool, carried: bool) -> Column:
    ch = r["ch"]
    candidates = r["carried"]["candidates"] if carried else F.size(r["at"])
    clipped = candidates <= 50 if mode == "reference" else F.lit(False)
    clip = F.when(clipped, F.lit(2 * max(left, right))).otherwise(F.lit(1 << 30))

    def count(name: str, p: Column, i: Column, c: Column) -> Column:
        # in a clipped context, over the few characters that are seen
        few = F.slice(ch, F.greatest(p - clip, F.lit(0)) + 1, F.least(p, clip) + 1)
        near = F.size(F.filter(few, lambda x: x == _QUOTES[name]))
        upto = F.coalesce(F.try_element_at(r[name], i + 1), F.lit(0)) + (r["carried"][name] if carried else 0)
        return F.when(c.isin(*_QUOTES.values()), F.when(clipped, near).otherwise(upto)).otherwise(0).alias(name)

    def around(p: Column, i: Column) -> Column:
        n = F.least(p, F.lit(reach), clip)
        c = F.element_at(ch, p + 1)
        more = [F.element_at(r["marks"], p + 1).alias("mark")] if marked else []
        return F.struct(
            p.alias("pos"), c.alias("c"), _piece(ch, p - n, n).alias("before"), _piece(ch, p, F.least(F.lit(reach), clip) + 1).alias("after"),
            *(count(name, p, i, c) for name in _QUOTES), *more,
        )

    return F.transform(r["at"], around)
