"""Fill-in-middle transformation over a run-length encoding of character classes.

A text is stored as its maximal runs of white space (space, U+0009 to U+000D) and of
other characters, with the units that end in each run counted up.  A cut after so
many units is found by a binary search for the run that holds it, and its offset
follows from the run's start by arithmetic; no unit is ever written out.  Units are
tokens (a run of other characters with the white space before it; white space at the
end is a token) or single characters.  The runs are found in numpy from the code
points; texts stay in Spark, which cuts, joins and rebuilds them.

Defined results: null counts as empty and stays plain; a null doc_id hashes as an
empty text.  Every row is treated alone, so repeated rows and ids give equal rows.
Whole texts are read, one at a time per task.  Other columns stay and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("token", "character")


@dataclass(frozen=True)
class Runs:
    """Starts of the maximal runs (and the end of the text), and how many units end before each of them."""

    start: np.ndarray
    before: np.ndarray

    @property
    def units(self) -> int:
        return int(self.before[-1])

    def offset(self, units: int) -> int:
        """Characters before the end of so many units."""
        if units <= 0:
            return 0
        # the first run by whose end the units are complete
        run = int(np.searchsorted(self.before[1:], units))
        held, size = self.before[run + 1] - self.before[run], self.start[run + 1] - self.start[run]
        return int(self.start[run] + (units - self.before[run]) * (size // held))


def encoded(text: str, unit: str = "token") -> Runs:
    """The runs of a text; a run holds one token, none, or as many characters as it is long."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return Runs(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    space = (code == 32) | ((code >= 9) & (code <= 13))
    start = np.concatenate(([0], np.flatnonzero(space[1:] != space[:-1]) + 1, [len(code)]))
    if unit == "character":
        held = np.diff(start)
    else:
        held = (~space[start[:-1]]).astype(np.int64)
        held[-1] = 1
    return Runs(start, np.concatenate(([0], np.cumsum(held))))


def cuts(text: Column, low: Column, high: Column, unit: str = "token") -> Column:
    """Struct (n, a, b): units of a text, and the characters before its two cuts at low % (n + 1) and high % (n + 1) units, in order."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")

    @F.pandas_udf("n long, a long, b long")
    def of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in parts:
            rows = []
            for t, x, y in zip(texts, one.tolist(), two.tolist(), strict=True):
                runs = encoded(t, unit)
                n = runs.units
                rows.append((n, *map(runs.offset, sorted((x % (n + 1), y % (n + 1))))))
            yield pd.DataFrame(rows, columns=["n", "a", "b"], dtype="int64")

    return of(text, low, high)


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token", into: str = "fim") -> DataFrame:
    """docs with a column (replaced if it is there): struct of n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, the text transformed.

    rate of 100 texts that are neither empty nor hold a sentinel are transformed, spm
    of 100 of these with the suffix first; seed and key decide.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.withColumn(into, F.struct(cuts(t, h[0], h[1], unit).alias("at"), form.alias("form")))
    at, form = F.col(into)["at"], F.col(into)["form"]
    a, b = at["a"].cast("int"), at["b"].cast("int")
    prefix, middle, suffix = F.left(t, a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t))
    output = (
        F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(t)
    )
    counted = lambda c, name: F.when(form != "plain", c).cast("long").alias(name)
    return rows.withColumn(into, F.struct(at["n"].alias("n"), form.alias("form"), counted(a, "prefix_chars"), counted(b - a, "middle_chars"), output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from it and its form alone."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op13_fim(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    f = F.col("fim")
    rows = transformed(docs.select("doc_id", "text")).select("doc_id", *(f[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_WS = "\\x20\\x09-\\x0D"
OP13_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[{_WS}]*[^{_WS}]+|[{_WS}]+') AS u, {", ".join(f"CAST('0x' || substr(s, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
