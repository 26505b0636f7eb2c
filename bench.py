"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import time
from pathlib import Path

from pyspark.sql import SparkSession

from passagework.operators import forest
from passagework.operators.trees import trees_from
from passagework.queries import QUERIES

HEADLINE = ("sentence_spans", "segment_text_tagged", "nonblank_sentence_spans", "rule_boundaries", "candidate_positions", "corpus_stats_by_lang", "paragraph_spans", "page_flags", "chunked_equals_unchunked", "forest_scores", "forest_sentences")
#: Trees and depth of the forests that are walked besides, with the windows of the medium preset.
SHAPES = ((32, 16), (64, 16))


def of_shape(trees: int, depth: int, seed: int = 1) -> forest.Trees:
    """A forest of about a trained one's size: every fourth branch ends early, so that 64 trees of depth 16 have some 300,000 nodes."""
    r = random.Random(seed)

    def node(left: int) -> tuple | float:
        if not left or (left < depth - 3 and r.random() < 0.25):
            return r.random()
        feature = r.randrange(21)
        return feature, r.randint(-5, 26) + 0.5 if feature < 13 else 0.5, node(left - 1), node(left - 1)

    return trees_from([node(depth) for _ in range(trees)])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    # Python workers find the package wherever the bench is started from
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH"))))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["candidate_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(int(cpus))
    config = forest.Config(left=7, right=5)
    for shape in SHAPES:
        trees = of_shape(*shape)
        began = time.perf_counter()
        forest.boundaries(documents, config, trees).select("doc_id", "bounds").write.format("noop").mode("overwrite").save()
        took["forest_{}x{}".format(*shape)] = round(time.perf_counter() - began, 3)
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2], "chars_per_second": round(chars / took["sentence_spans"]), "forest_chars_per_second": round(chars / took["forest_scores"]), "forest_64x16_chars_per_second": round(chars / took["forest_64x16"])}))
    spark.stop()


if __name__ == "__main__":
    main()
