"""Search over windows, trees, depths and thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import labelled_characters
from ..operators import forest, growth
from .rules import passes

#: Combinations that are fitted at the same time, at most.
TOGETHER = 4


def narrowed(rows: DataFrame, left: int, right: int, to_left: int, to_right: int) -> DataFrame:
    """Rows whose features have a window of left and right, with those of a window inside it: a slice, then the flags."""
    flags = F.slice("features", left + right + 2, F.size("features") - (left + right + 1))
    return rows.withColumn("features", F.concat(F.slice("features", left - to_left + 1, to_left + to_right + 1), flags))


def figures_by_threshold(scored: DataFrame, thresholds: Sequence[float]) -> list[dict]:
    """Metrics of rows (label, p) at every threshold, from one pass: a probability passes some of the thresholds, and counts of rows by these add up from the strictest one down."""
    # the place of a threshold among all, from the one that most pass
    order = sorted(range(len(thresholds)), key=lambda i: (thresholds[i], i))
    passed = sum((F.when(passes(F.col("p"), thresholds[i]), 1).otherwise(0) for i in order), F.lit(0))
    n = {(r["label"], r["passed"]): r["n"] for r in scored.groupBy((F.col("label") == 1).cast("int").alias("label"), passed.alias("passed")).agg(F.count("*").alias("n")).collect()}
    of = lambda label, least: sum(v for (y, k), v in n.items() if y == label and k >= least)
    out: list[dict] = [{}] * len(thresholds)
    for place, i in enumerate(order):
        tp, fp = of(1, place + 1), of(0, place + 1)
        fn, tn = of(1, 0) - tp, of(0, 0) - fp
        part = lambda a, b: a / b if b else 0.0
        out[i] = {
            "accuracy": part(tp + tn, tp + tn + fp + fn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1_score": part(2 * tp, 2 * tp + fp + fn),
            "boundary_accuracy": part(tp, tp + fp + fn), "binary_mode": True,
        }
    return out


def best_model(
    annotated: DataFrame, validation: DataFrame | None = None, left: Sequence[int] = (3, 5, 7), right: Sequence[int] = (3, 5, 7), trees: Sequence[int] = (50, 100, 200),
    depth: Sequence[int] = (8, 16, 24), thresholds: Sequence[float] = (0.3, 0.5, 0.7), base: forest.Config | None = None, together: int = TOGETHER,
) -> tuple[forest.Segmenter, list[dict]]:
    """The first segmenter of the largest F1, and the figures of all combinations.

    Features are computed once, with the widest windows, and those of every pair of
    windows are slices of them, kept as vectors for all forests of that pair.  A forest
    is fitted once for all thresholds, whose figures come from one pass over its scores;
    forests of a pair are fitted at the same time, fewer the more rows there are.  A
    combination that cannot be trained is passed over, with its error among the figures.
    """
    base = base or forest.Config()
    widest = max(left), max(right)
    spark, results = annotated.sparkSession, []
    rows = forest.training_rows(annotated, replace(base, left=widest[0], right=widest[1])).persist()
    judged = rows if validation is None else labelled_characters(validation.select("text"), list(base.abbreviations), *widest).select("label", "features").persist()
    # trees that are grown one by one score features as they are
    more = ["features"] if any(forest.one_by_one(replace(base, depth=d)) for d in depth) else []

    def as_vectors(all_rows: DataFrame, a: int, b: int) -> DataFrame:
        own = forest.sliced(narrowed(all_rows, *widest, a, b), None)
        return own.select("label", "vector", *more, *(c for c in ("key",) if c in own.columns)).persist()

    def tried_out(own: DataFrame, seen: DataFrame, a: int, b: int, n: int, d: int) -> tuple[forest.Segmenter | None, list[dict]]:
        names = {"left": a, "right": b, "trees": n, "depth": d}
        config = replace(base, **names)
        try:
            made = forest.segmenter_of(own, config)
        except (ValueError, IllegalArgumentException) as e:
            return None, [{**names, "error": str(e)}]
        got = figures_by_threshold(forest.probabilities(seen, made), thresholds)
        return made, [{**names, "threshold": t, **f} for t, f in zip(thresholds, got, strict=True)]

    with ThreadPoolExecutor(growth.side_by_side(spark, rows.count(), together)) as pool:
        for a, b in product(left, right):
            own = as_vectors(rows, a, b)
            seen = own if judged is rows else as_vectors(judged, a, b)
            call = inheritable_thread_target(spark)(lambda x, own=own, seen=seen, a=a, b=b: tried_out(own, seen, a, b, *x))
            results += pool.map(call, product(trees, depth))
            own.unpersist()
            seen.unpersist()
    rows.unpersist()
    judged.unpersist()
    best = None
    for made, figures in results:
        for f in figures if made else []:
            if best is None or f["f1_score"] > best[0]:
                best = f["f1_score"], replace(made, config=replace(made.config, threshold=f["threshold"]))
    if best is None:
        raise ValueError("no combination could be trained")
    return best[1], [f for _, figures in results for f in figures]
