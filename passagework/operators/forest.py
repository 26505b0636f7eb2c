"""Random forests over place features: training, probabilities, selection, metrics, persistence."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import batches, labels
from ..functions.features import feature_count, reach
from ..functions.labels import clean_text, labelled_characters
from ..plans.rules import passes
from . import growth
from .abbreviations import DEFAULT
from .growth import DEEPEST
from .trees import Trees, passing, trees_from, trees_from_nodes  # noqa: F401

VERSION = 2


@dataclass(frozen=True)
class Config:
    """Settings of a segmenter; presets change a few of them."""

    left: int = 5
    right: int = 5
    trees: int = 100
    depth: int = 16
    min_leaf: int = 1
    threshold: float = 0.5
    sample_rate: float = 0.1
    seed: int = 0
    balanced: bool = True
    #: Balance classes over each tree's own bootstrap, and not over all rows.
    per_tree: bool = False
    #: Nodes of fewer rows are not split.
    min_split: int = 2
    variant: str = "array"
    mode: str = "reference"
    model_type: str = "random_forest"
    selection_threshold: float = 0.01
    max_features: int | None = None
    abbreviations: tuple[str, ...] = field(default=DEFAULT)


PRESETS = {
    "small": Config(left=5, right=3, trees=32, depth=16, min_leaf=4, min_split=8, per_tree=True, sample_rate=0.001),
    "medium": Config(left=7, right=5, trees=64, depth=32, min_leaf=4, min_split=8, per_tree=True, sample_rate=0.001),
    "large": Config(left=9, right=7, trees=256, depth=64, min_leaf=2, min_split=4, per_tree=True, sample_rate=0.001),
}
_TYPES = {"random_forest": False, "binary_random_forest": False, "feature_selected_rf": True, "feature_selected_random_forest": True}


@dataclass(frozen=True)
class Segmenter:
    """A trained forest with its settings; selected: feature indexes in order of importance, or None for all.

    The model is Spark's, or the trees themselves where they were grown one by one
    (``growth``), with the importance of each feature that they use.  Without a model
    it is not trained: scoring, saving and importances then raise ValueError.
    """

    config: Config
    model: RandomForestClassificationModel | Trees | None = None
    selected: tuple[int, ...] | None = None
    gains: tuple[float, ...] | None = None


def training_rows(annotated: DataFrame, config: Config, text: str = "text") -> DataFrame:
    """(label, features) of the characters that train: all boundaries, all candidates, and a sample of the rest.

    The sample is drawn by a hash of text, place and seed, so it is the same in every
    run and on every layout of the table.
    """
    docs = annotated.select(clean_text(text).alias("_text"), labels.boundaries(text).alias("_bounds"), F.xxhash64(text, F.lit(config.seed)).alias("_key"))
    least, n = int(config.sample_rate * (1 << 40)), F.length("_text")
    drawn = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.xxhash64("_key", i), F.lit(1 << 40)) < F.lit(least))
    also = F.when(n > 0, drawn).otherwise(F.array().cast("array<int>")) if 0 < least < 1 << 40 else None
    look = replace(_look(config), mode="full", variant="array", everywhere=least >= 1 << 40)
    rows = batches.placed(docs, look, "_text", also, F.col("_bounds")).drop("_bounds")
    return rows.select("label", "features", F.xxhash64("_key", "pos").alias("key"))


def _look(config: Config) -> batches.Look:
    entries = config.abbreviations
    return batches.Look(config.left, config.right, config.mode, reach(list(entries)), tuple(entries), config.variant)


def class_weights(rows: DataFrame) -> dict[int, float]:
    """n / (2 n_class) of labels 0 and 1."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    return {k: total / (2.0 * v) for k, v in n.items()}


def one_by_one(config: Config) -> bool:
    """Whether trees are grown one by one, as Spark's forest has no such setting."""
    return config.per_tree or config.min_split > 2 or config.depth > DEEPEST


def fit(rows: DataFrame, config: Config, selected: tuple[int, ...] | None = None) -> tuple[RandomForestClassificationModel | Trees, np.ndarray]:
    """A forest fitted on (label, features) and, where trees are grown one by one, key, by all features or the selected ones; and their importances."""
    if one_by_one(config):
        if selected is not None:
            rows = rows.withColumn("features", F.array(*(F.col("features")[i] for i in selected)))
        return growth.forest(rows, config.trees, config.depth, config.min_leaf, config.min_split, config.seed, config.balanced, config.per_tree)
    rows = sliced(rows, selected)
    forest = RandomForestClassifier(numTrees=config.trees, maxDepth=config.depth, minInstancesPerNode=config.min_leaf, maxBins=128, seed=config.seed, labelCol="label", featuresCol="vector")
    if config.balanced:
        w = class_weights(rows)
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, w.get(1, 1.0)).otherwise(w.get(0, 1.0)))
        forest = forest.setWeightCol("weight")
    model = forest.fit(rows)
    return model, model.featureImportances.toArray()


def sliced(rows: DataFrame, selected: tuple[int, ...] | None) -> DataFrame:
    """rows with column vector, which may be there already: all features, or the selected ones."""
    if "vector" not in rows.columns:
        rows = rows.withColumn("vector", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    if selected is None:
        return rows
    return VectorSlicer(inputCol="vector", outputCol="_sliced", indices=list(selected)).transform(rows).drop("vector").withColumnRenamed("_sliced", "vector")


def segmenter_of(rows: DataFrame, config: Config) -> Segmenter:
    """A segmenter fitted on (label, features), with the features selected where its model type asks for that."""
    if config.model_type not in _TYPES:
        raise ValueError(f"unknown model type {config.model_type!r}")
    (model, gains), selected = fit(rows, config), None
    if _TYPES[config.model_type]:
        ranked = sorted(enumerate(gains.tolist()), key=lambda x: -x[1])
        selected = tuple(i for i, v in ranked if v >= config.selection_threshold)[: config.max_features]
        if not selected:
            raise ValueError("no feature reaches the selection threshold")
        model, gains = fit(rows, config, selected)
    if isinstance(model, Trees):
        model = model.renumbered(selected)
    return Segmenter(config, model, selected, tuple(gains.tolist()))


def fitted(annotated: DataFrame, config: Config, text: str = "text") -> Segmenter:
    """A segmenter fitted on annotated texts, without metrics; rows are kept only where more than one pass reads them."""
    rows = training_rows(annotated, config, text)
    if _TYPES.get(config.model_type) or not one_by_one(config) or config.trees > growth.TOGETHER:
        rows = rows.persist()
    made = segmenter_of(rows, config)
    rows.unpersist()
    return made


def train(annotated: DataFrame, config: Config | None = None, text: str = "text", **changes) -> tuple[Segmenter, DataFrame]:
    """A segmenter fitted on annotated texts, and its metrics over the rows that it was trained on."""
    config = replace(config or Config(), **{k: v for k, v in changes.items() if v is not None})
    rows = training_rows(annotated, config, text).persist()
    made = segmenter_of(rows, config)
    scored_rows = metrics(with_prediction(probabilities(rows, made), config.threshold)).persist()
    scored_rows.count()
    rows.unpersist()
    return made, scored_rows


def _trained(made: Segmenter) -> None:
    if made.model is None:
        raise ValueError("the segmenter is not trained")


def importances(made: Segmenter) -> dict[int, float]:
    """Importance by feature index; they sum to 1."""
    _trained(made)
    index = made.selected or range(feature_count(made.config.left, made.config.right))
    return dict(zip(index, made.gains, strict=True))


def probabilities(rows: DataFrame, made: Segmenter) -> DataFrame:
    """rows with column p, the probability of a boundary."""
    _trained(made)
    if isinstance(made.model, Trees):
        return rows.withColumn("p", made.model.probability(F.col("features")))
    out = made.model.setFeaturesCol("vector").transform(sliced(rows, made.selected))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def with_prediction(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.withColumn("pred", F.when(passes(F.col("p"), threshold), 1).otherwise(0))


def trees_of(made: Segmenter) -> Trees:
    """The forest of a segmenter as node arrays; features by their place before selection."""
    _trained(made)
    return made.model if isinstance(made.model, Trees) else trees_from_nodes(growth.nodes(made.model)).renumbered(made.selected)


def boundaries(docs: DataFrame, config: Config, trees: Trees, threshold: float | None = None, text: str | Column = "text", into: str = "bounds", carried: Column | None = None) -> DataFrame:
    """docs with the array of boundaries by a forest: a step for each row, whatever its keys, and no shuffle.

    Features and trees are worked out over whole batches of texts.  carried as in
    ``seen``, for pieces of texts.  The rows go through Python as they are, so leave out
    beforehand what is not needed.
    """
    look, level, sent, n = _look(config), config.threshold if threshold is None else threshold, trees.sent(), len(trees)
    known, parts = batches.classes(docs.sparkSession), carried is not None
    others = [c for c in docs.columns if c != into]
    k = others.index(text) if isinstance(text, str) else len(others)
    given = docs.select(*others, *([] if isinstance(text, str) else [text.alias("_text")]), *([] if carried is None else [carried.alias("_carried")]))
    schema = StructType([*docs.select(*others).schema.fields, StructField(into, ArrayType(IntegerType(), False))])

    def found(rows: pa.RecordBatch) -> pa.ListArray:
        texts = batches.Texts(rows.column(k).to_pylist(), known.value)
        counts = rows.column(rows.num_columns - 1)
        before = {f.name: counts.field(f.name).to_numpy(zero_copy_only=False) for f in counts.type} if parts else None
        at = texts.places(False)
        of, x = batches.described(texts, look, at, before)
        kept = passing(sent, n, x, level)
        upto = np.concatenate(([0], np.cumsum(np.bincount(of[kept], minlength=rows.num_rows))))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array((at - texts.starts[of])[kept] + 1, pa.int32()))

    def step(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            for rows in batches.groups(batch, k):
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(others)], found(rows)], schema.names)

    return given.mapInArrow(step, schema)


def forest_boundaries(docs: DataFrame, made: Segmenter, threshold: float | None = None, text: str = "text", into: str = "bounds") -> DataFrame:
    """docs with the array of boundaries by a trained forest."""
    return boundaries(docs, made.config, trees_of(made), threshold, text, into)


def metrics_of_bounds(rows: DataFrame, truth: str, bounds: str, text: str = "text") -> DataFrame:
    """``metrics`` over all characters, from two arrays of boundaries per text, counted as sets."""
    n = F.length(text)
    inside = lambda b: F.array_distinct(F.filter(b, lambda x: (x > 0) & (x <= n)))
    t, p = inside(truth), inside(bounds)
    both = F.size(F.array_intersect(t, p))
    counts = rows.select(both.alias("tp"), (F.size(p) - both).alias("fp"), (F.size(t) - both).alias("fn"), (n - F.size(p) - F.size(t) + both).alias("tn"))
    return _figures(counts.agg(*(F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn"))))


def metrics(rows: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """One row: accuracy, precision, recall, f1_score, boundary_accuracy, binary_mode; 0 where undefined."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    counts = rows.agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    return _figures(counts)


def _figures(counts: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    counts = counts.na.fill(0.0)
    return counts.select(
        part(tp + tn, tp + tn + fp + fn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"),
        part(2 * tp, 2 * tp + fp + fn).alias("f1_score"), part(tp, tp + fp + fn).alias("boundary_accuracy"), F.lit(True).alias("binary_mode"),
    )


def evaluate(annotated: DataFrame, made: Segmenter, text: str = "text", threshold: float | None = None, max_samples: int | None = None) -> DataFrame:
    """Metrics over all characters of annotated texts (of the first max_samples, where given), seen in their full context."""
    c = made.config
    annotated = annotated.limit(max_samples) if max_samples is not None else annotated
    rows = labelled_characters(annotated.select(F.col(text).alias("text")), list(c.abbreviations), c.left, c.right).select("label", "features")
    return metrics(with_prediction(probabilities(rows, made), c.threshold if threshold is None else threshold))


def save(made: Segmenter, path: str) -> None:
    """The forest and its settings as a folder; replaces what was there."""
    _trained(made)
    spark = SparkSession.active()
    if isinstance(made.model, Trees):
        made.model.table(spark).write.mode("overwrite").parquet(f"{path}/trees")
    else:
        made.model.write().overwrite().save(f"{path}/forest")
    kind = "trees" if isinstance(made.model, Trees) else "forest"
    meta = json.dumps({"version": VERSION, "kind": kind, "config": asdict(made.config), "selected": made.selected, "gains": made.gains})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(path: str) -> Segmenter:
    spark = SparkSession.active()
    meta = migrated(json.loads(spark.read.text(f"{path}/config").first()["value"]))
    model = Trees.of(spark.read.parquet(f"{path}/trees")) if meta["kind"] == "trees" else RandomForestClassificationModel.load(f"{path}/forest")
    gains = meta["gains"] if meta["gains"] is not None else model.featureImportances.toArray().tolist()
    return Segmenter(Config(**meta["config"]), model, tuple(meta["selected"]) if meta["selected"] else None, tuple(gains))


def _kinds_and_gains(meta: dict) -> dict:
    """Version 1 knew Spark's forests alone and left importances to them."""
    return {**meta, "kind": "forest", "gains": None, "version": 2}


#: What brings the settings of a version to the next one.
MIGRATIONS = {1: _kinds_and_gains}


def migrated(meta: dict) -> dict:
    """Settings of any earlier version as those of this one, step by step; what a version lacked has its default, what is no more is left out."""
    if meta["version"] > VERSION:
        raise ValueError(f"model version {meta['version']} is newer than {VERSION}")
    while meta["version"] < VERSION:
        meta = MIGRATIONS[meta["version"]](meta)
    known = {f.name for f in fields(Config)}
    return {**meta, "config": {k: tuple(v) if k == "abbreviations" else v for k, v in meta["config"].items() if k in known}}
