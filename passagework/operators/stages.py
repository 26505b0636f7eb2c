"""The engine as Spark ML stages: places and their features, any classifier, boundaries.

``Pipeline(stages=[Places(), GBTClassifier(...), Boundaries()])`` trains on a column of
annotated texts and scores a column of plain texts.  Each part can be exchanged: the
encoder by its name in ENCODERS, the extractor by any transformer that makes rows of
places with a vector of features, the model by any classifier with probabilities.
Pipelines are saved and loaded as Spark does it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import CANDIDATES, encode, encode_one_hot, surroundings
from ..functions.features import features, reach
from ..functions.labels import character_labels, clean_text
from ..plans.rules import passes
from .abbreviations import DEFAULT

#: Encoders of a character by name; others can be put here, in every session that uses them.
ENCODERS: dict[str, Callable[[Column], Column]] = {"class": encode, "code_point": encode_one_hot}


def _param(name: str, doc: str, kind: Callable) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class Places(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Rows of places with their features.

    A table with the annotated column gives the characters that train: all boundaries,
    all candidates and a sample of the rest, with label.  Other tables give the
    candidates of the text column.  Other columns stay, with pos and c.
    """

    textCol = _param("textCol", "plain texts to score", TypeConverters.toString)
    annotatedCol = _param("annotatedCol", "annotated texts to train on", TypeConverters.toString)
    featuresCol = _param("featuresCol", "vector of features", TypeConverters.toString)
    left = _param("left", "characters before a place", TypeConverters.toInt)
    right = _param("right", "characters after a place", TypeConverters.toInt)
    variant = _param("variant", "how the colon flag is gated: array or list", TypeConverters.toString)
    mode = _param("mode", "context of short texts: reference or full", TypeConverters.toString)
    encoder = _param("encoder", "name in ENCODERS", TypeConverters.toString)
    abbreviations = _param("abbreviations", "known abbreviations", TypeConverters.toListString)
    sampleRate = _param("sampleRate", "share of other characters that train", TypeConverters.toFloat)
    seed = _param("seed", "of that sample", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, textCol="text", annotatedCol="annotated", featuresCol="features", left=5, right=5, variant="array", mode="full", encoder="class", abbreviations=DEFAULT, sampleRate=0.1, seed=0):
        super().__init__()
        self._set(**{**self._input_kwargs, "abbreviations": list(abbreviations)})
        self._setDefault(
            textCol="text", annotatedCol="annotated", featuresCol="features", left=5, right=5, variant="array", mode="full", encoder="class", abbreviations=list(DEFAULT), sampleRate=0.1, seed=0
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = lambda p: self.getOrDefault(p)
        if of("encoder") not in ENCODERS:
            raise ValueError(f"unknown encoder {of('encoder')!r}")
        known, code = of("abbreviations"), ENCODERS[of("encoder")]
        trains = of("annotatedCol") in dataset.columns
        text, near = of("textCol"), (of("left"), of("right"), of("mode"), reach(known))
        if trains:
            others = [c for c in dataset.columns if c not in (of("annotatedCol"), text)]
            docs = dataset.select(*others, clean_text(of("annotatedCol")).alias("_text"), character_labels(of("annotatedCol")).alias("_labels"), F.xxhash64(of("annotatedCol"), F.lit(of("seed"))).alias("_key"))
            rows = surroundings(docs, "_text", True, *near, F.col("_labels")).drop("_labels").withColumnRenamed("mark", "label")
            drawn = F.pmod(F.xxhash64("_key", "pos"), F.lit(1 << 40)) < F.lit(int(of("sampleRate") * (1 << 40)))
            rows, others = rows.where((F.col("label") == 1) | F.col("c").isin(*CANDIDATES) | drawn), [*others, "label"]
        else:
            rows, others = surroundings(dataset, text, False, *near), [c for c in dataset.columns if c != text]
        vector = array_to_vector(F.transform(features(known, of("left"), of("right"), of("variant"), code=code), lambda x: x.cast("double")))
        return rows.select(*others, "pos", "c", vector.alias(of("featuresCol")))


class Boundaries(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Of rows of scored places, those whose probability passes the threshold, with bound, the place after the character."""

    probabilityCol = _param("probabilityCol", "vector of the classes' probabilities", TypeConverters.toString)
    threshold = _param("threshold", "probability of a boundary", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, probabilityCol="probability", threshold=0.5):
        super().__init__()
        self._setDefault(probabilityCol="probability", threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = vector_to_array(self.getOrDefault("probabilityCol"))[1]
        return dataset.where(passes(p, self.getOrDefault("threshold"))).withColumn("bound", F.col("pos") + 1)
