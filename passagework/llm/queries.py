"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontaminate, exact, fim, language, licenses, mixing, nearest, pii, quality, simhash, toxicity
from .common import read


def _docs(op: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read(spark, sf_dir, "documents"), *(read(spark, sf_dir, t) for t in more))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": _docs(licenses.op1_licenses),
    "op2_chat": lambda spark, sf_dir: chat.op2_chat(read(spark, sf_dir, "conversations")),
    "op3_mixing": _docs(mixing.op3_mixing),
    "op4_pii": _docs(pii.op4_pii),
    "op5_toxicity": _docs(toxicity.op5_toxicity, "labels"),
    "op6_decontaminate": _docs(decontaminate.op6_decontaminate, "benchmark"),
    "op7_language": _docs(language.op7_language),
    "op8_simhash": _docs(simhash.op8_simhash),
    "op9_exact": _docs(exact.op9_exact),
    "op10_quality": _docs(quality.op10_quality, "labels"),
    "op11_centroids": lambda spark, sf_dir: centroids.op11_centroids(read(spark, sf_dir, "embeddings")),
    "op12_nearest": lambda spark, sf_dir: nearest.op12_nearest(read(spark, sf_dir, "embeddings")),
    "op13_fim": _docs(fim.op13_fim),
}
SQL: dict[str, str] = {"op9_exact": exact.OP9_SQL, "op11_centroids": centroids.OP11_SQL, "op12_nearest": nearest.OP12_SQL, "op13_fim": fim.OP13_SQL}
