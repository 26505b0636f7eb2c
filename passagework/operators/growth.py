"""Forests grown tree by tree with Spark's own trees: a weighted bootstrap for each, pruning by rows, and depth without a bound.

A tree's bootstrap gives every row a Poisson count from a hash of its key, the seed and
the tree, and weighs classes over that bootstrap.  Rows of the same label and features
are counted together once for several trees, and stand in a tree's bootstrap as often as
its smallest nodes can tell.  Spark's trees end at a depth of DEEPEST; leaves that are
not finished there get trees of their own on the rows that reach them.  Trees are
independent of each other and are fitted side by side, fewer at a time the more rows
there are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Trees, trees_from_nodes

#: Spark's trees go no deeper.
DEEPEST = 30
#: Trees whose bootstraps are counted together and that are fitted at the same time, at most.
TOGETHER = 8
#: Rows a core that the fits of one time keep in memory, about.
HELD = 1 << 20
#: Kinds of rows that go to one task of a fit, about.
KINDS = 1 << 16
#: A Poisson count of 1 on average goes no higher than this in 2^40 draws.
_MOST = 14
#: Says that labels are 0 and 1, so that Spark does not look for the largest.
_BINARY = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}


def _uniform(key: Column, seed: int, tree: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(tree)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def drawn(key: Column, seed: int, tree: int) -> Column:
    """How often a row stands in a tree's bootstrap: a Poisson count with mean 1, from a hash."""
    u = _uniform(key, seed, tree)
    # the first bound that u is below: sums of all bounds make methods that Java does not compile
    below, steps = 0.0, F
    for k in range(_MOST):
        below += math.exp(-1) / math.factorial(k)
        steps = steps.when(u < below, k)
    return steps.otherwise(_MOST)


def alike(rows: DataFrame, seed: int, trees: Sequence[int]) -> DataFrame:
    """One row for all (label, features, key) of the same label and features: the vector, their number (n) and, for every tree t, how many of them its bootstrap has (rows{t}) and how often in all (times{t}).

    The order inside a partition is fixed, as Spark's own samples go by it.
    """
    own = rows.select("label", "features", *(drawn(F.col("key"), seed, t).alias(f"_{t}") for t in trees))
    # both counts in one sum, so that half as much is shuffled; it overflows, which Spark refuses, at 2^31 draws of a kind
    both = [F.sum(F.col(f"_{t}") * F.lit(1 << 32) + F.when(F.col(f"_{t}") > 0, 1).otherwise(0)).alias(f"_{t}") for t in trees]
    held = own.groupBy("label", "features").agg(F.count("*").alias("n"), *both).sortWithinPartitions("label", "features")
    parts = [c for t in trees for c in (F.col(f"_{t}").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"rows{t}"), F.shiftright(f"_{t}", 32).alias(f"times{t}"))]
    return held.select("label", array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("vector"), "n", *parts)


def class_counts(rows: DataFrame, seed: int, trees: Sequence[int], per_tree: bool) -> list[dict[int, float]]:
    """By tree, how many rows of each label its bootstrap has, or all rows have; from one pass over rows with their keys, or rows of ``alike``."""
    if "key" in rows.columns:
        of = [F.sum(drawn(F.col("key"), seed, t)) if per_tree else F.count("*") for t in trees]
    else:
        of = [F.sum(f"times{t}" if per_tree else "n") for t in trees]
    n = rows.groupBy("label").agg(*(c.alias(f"n{i}") for i, c in enumerate(of))).collect()
    return [{r["label"]: float(r[f"n{i}"]) for r in n} for i in range(len(of))]


def bootstrap(rows: DataFrame, seed: int, tree: int, balanced: bool, per_tree: bool, n: dict[int, float] | None = None, most: int | None = None) -> DataFrame:
    """The rows of a tree's bootstrap with their weight: count, times n / (2 n_class) over the bootstrap, or over all rows; n as ``class_counts`` gives it.

    Rows of ``alike`` stand there as often as rows are alike in the bootstrap, but no
    more than most times: their counts add up to all of theirs, and no node that asks
    for at most so many rows can tell the difference.
    """
    if "key" in rows.columns:
        # rows with a count of 0 go by one comparison
        some = rows.where(_uniform(F.col("key"), seed, tree) >= math.exp(-1)).withColumn("count", drawn(F.col("key"), seed, tree))
    else:
        own, times = F.col(f"rows{tree}"), F.col(f"times{tree}")
        stand = own if most is None else F.least(own, F.lit(most))
        there = rows.where(own > 0).select("label", "vector", stand.alias("_stand"), times.alias("_times"))
        some = there.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_stand")))
        some = some.select("label", "vector", F.when(F.col("_k") == 1, F.col("_times") - F.col("_stand") + 1).otherwise(1).alias("count"))
    if not balanced:
        return some.withColumn("weight", F.col("count").cast("double"))
    n = class_counts(rows, seed, [tree], per_tree)[0] if n is None else n
    weight = {k: sum(n.values()) / (2 * v) if v else 0.0 for k, v in n.items()}
    return some.withColumn("weight", F.col("count") * F.when(F.col("label") == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0)))


def side_by_side(spark: SparkSession, rows: int, most: int) -> int:
    """How many fits over so many rows go on at the same time: each keeps its rows in memory, and two of many rows leave no core idle."""
    return max(1, min(most, max(2, HELD * spark.sparkContext.defaultParallelism // max(rows, 1))))


def forest(rows: DataFrame, trees: int, depth: int, min_leaf: int, min_split: int, seed: int, balanced: bool, per_tree: bool) -> tuple[Trees, np.ndarray]:
    """Trees over rows (label, features, key) and the importances of the features: means over the trees of their shares of the weighted gain.

    Rows are read once for every TOGETHER trees.
    """
    if trees < 1 or depth < 0:
        raise ValueError("a forest needs trees and a depth of at least 0")
    spark, made, width = rows.sparkSession, [], 0
    for first in range(0, trees, TOGETHER):
        batch = range(first, min(first + TOGETHER, trees))
        held = alike(rows, seed, batch).persist()
        n = held.count()
        if n == 0:
            held.unpersist()
            raise ValueError("nothing to train on")
        # a shuffle makes more partitions than a fit's many short passes need
        few = held.coalesce(max(spark.sparkContext.defaultParallelism, n // KINDS))
        width = len(few.first()["vector"])
        counts = dict(zip(batch, class_counts(few, seed, batch, per_tree) if balanced else [None] * len(batch), strict=True))

        def grown(tree: int, few: DataFrame = few, counts: dict = counts) -> pd.DataFrame:
            own = bootstrap(few, seed, tree, balanced, per_tree, counts[tree], max(min_split, 2 * min_leaf))
            return _grown(own, depth, min_leaf, min_split, seed * 100_003 + tree)

        with ThreadPoolExecutor(side_by_side(spark, n, len(batch))) as pool:
            made += pool.map(inheritable_thread_target(SparkSession.active())(grown), batch)
        held.unpersist()
    shares = np.zeros(width)
    for i, tree in enumerate(made):
        tree["tree"] = i
        inner = tree[tree["left"] >= 0]
        gain = np.bincount(inner["feature"], weights=inner["gain"] * (inner["zero"] + inner["one"]), minlength=width)
        shares += gain / gain.sum() if gain.sum() > 0 else 0
    return trees_from_nodes(pd.concat(made, ignore_index=True)), shares / shares.sum() if shares.sum() > 0 else shares


def _grown(rows: DataFrame, depth: int, min_leaf: int, min_split: int, seed: int) -> pd.DataFrame:
    """Nodes of one tree over rows (label, vector, weight), pruned, and grown on below Spark's depth."""
    rows = rows.select(F.col("label").cast("double").alias("label", metadata=_BINARY), "vector", "weight")
    stage = RandomForestClassifier(
        numTrees=1, maxDepth=min(depth, DEEPEST), minInstancesPerNode=min_leaf, maxBins=128, seed=seed, labelCol="label", featuresCol="vector", weightCol="weight", bootstrap=False, featureSubsetStrategy="sqrt"
    )
    tree = pruned(nodes(stage.fit(rows)), min_split)
    if depth <= DEEPEST:
        return tree
    level = _levels(tree)
    open_ = tree.index[(level == DEEPEST) & (tree["zero"] > 0) & (tree["one"] > 0) & (tree["n"] >= max(min_split, 2 * min_leaf))]
    flat, at = trees_from_nodes(tree), {}
    if len(open_):
        # the places of these leaves in the flat tree, by walking both alike
        at = dict(_alike(tree, flat))
    reached = rows.withColumn("_leaf", _leaf(flat, vector_to_array("vector"))) if len(open_) else rows
    for leaf in open_.tolist():
        below = _grown(reached.where(F.col("_leaf") == at[leaf]).drop("_leaf"), depth - DEEPEST, min_leaf, min_split, seed + leaf + 1)
        tree = grafted(tree, leaf, below)
    return tree


def _leaf(tree: Trees, features: Column) -> Column:
    sent = SparkSession.active().sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(sent.value.leaves(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)), pa.int32())

    return of(features)


def _alike(nodes_: pd.DataFrame, flat: Trees) -> Iterator[tuple[int, int]]:
    left, right, waiting = nodes_["left"].to_numpy(), nodes_["right"].to_numpy(), [(0, int(flat.roots[0]))]
    while waiting:
        a, b = waiting.pop()
        yield a, b
        if left[a] >= 0:
            waiting += [(left[a], int(flat.left[b])), (right[a], int(flat.left[b]) + 1)]


def _levels(tree: pd.DataFrame) -> np.ndarray:
    """Depth of every node; parents stand before their children."""
    level, left, right = np.zeros(len(tree), dtype=int), tree["left"].to_numpy(), tree["right"].to_numpy()
    for i in np.flatnonzero(left >= 0).tolist():
        level[left[i]] = level[right[i]] = level[i] + 1
    return level


def pruned(tree: pd.DataFrame, min_split: int) -> pd.DataFrame:
    """Without the splits of nodes that hold fewer rows, and what stood below them."""
    left, right = tree["left"].to_numpy().copy(), tree["right"].to_numpy().copy()
    few = tree["n"].to_numpy() < min_split
    kept = np.zeros(len(tree), dtype=bool)
    kept[0] = True
    for i in range(len(tree)):
        if not kept[i] or few[i]:
            left[i] = right[i] = -1
        if left[i] >= 0:
            kept[left[i]] = kept[right[i]] = True
    new = np.cumsum(kept) - 1
    out = tree.assign(left=np.where(left >= 0, new[left], -1), right=np.where(right >= 0, new[right], -1))[kept].reset_index(drop=True)
    return out.assign(id=out.index)


def grafted(tree: pd.DataFrame, leaf: int, below: pd.DataFrame) -> pd.DataFrame:
    """The tree with another one in the place of a leaf; numbers of its own nodes stay."""
    base = len(tree) - 1  # the root of below takes the leaf's row
    moved = lambda c: np.where(below[c] >= 0, below[c] + base, -1)
    below = below.assign(left=moved("left"), right=moved("right"), id=below["id"] + base)
    out = tree.copy()
    for c in ("left", "right", "feature", "threshold", "gain"):
        out.loc[leaf, c] = below.loc[0, c]
    return pd.concat([out, below.iloc[1:]], ignore_index=True)


def nodes(model: RandomForestClassificationModel) -> pd.DataFrame:
    """Nodes of a model (tree, id, left, right, feature, threshold, gain, zero, one, n), from Spark's own saved form of it."""
    spark = SparkSession.active()
    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(folder)
    n = "nodeData"
    stats = F.col(f"{n}.impurityStats")
    columns = spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"), f"{n}.id", F.col(f"{n}.leftChild").alias("left"), F.col(f"{n}.rightChild").alias("right"), F.col(f"{n}.split.featureIndex").alias("feature"),
        F.coalesce(F.try_element_at(f"{n}.split.leftCategoriesOrThreshold", F.lit(1)), F.lit(0.0)).alias("threshold"), f"{n}.gain",
        stats[0].alias("zero"), F.coalesce(F.try_element_at(stats, F.lit(2)), F.lit(0.0)).alias("one"), F.col(f"{n}.rawCount").alias("n"),
    )
    held = columns.toArrow().to_pandas().sort_values(["tree", "id"], ignore_index=True)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return held


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write: the checkpoint folder that the session names, or the warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
