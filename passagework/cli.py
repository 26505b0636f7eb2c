"""Command line: analyze, train, best-model."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import forest
from .operators.abbreviations import DEFAULT, from_text, listed
from .operators.segments import corpus_statistics, paragraph_spans, sentences, tagged
from .plans.rules import rule_boundaries
from .plans.search import best_model
from .sources.files import read_text_file, save_metrics, training_texts, write_document


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagework")
    sub = p.add_subparsers(dest="command")
    a = sub.add_parser("analyze")
    a.add_argument("--model", help="folder of a trained model; the fixed rule without one")
    a.add_argument("--input", required=True)
    a.add_argument("--output", help="folder to write to; printed without one")
    a.add_argument("--abbreviations", help="file of abbreviations, one a line, for the fixed rule")
    a.add_argument("--format", choices=("annotated", "sentences", "paragraphs"), default="annotated")
    a.add_argument("--metrics")
    a.add_argument("--threshold", type=float)
    t = sub.add_parser("train")
    t.add_argument("--data", required=True)
    t.add_argument("--output", required=True)
    for name, kind in (("left-window", int), ("right-window", int), ("n-estimators", int), ("max-depth", int), ("sample-rate", float), ("max-samples", int), ("threshold", float), ("feature-selection-threshold", float), ("max-features", int)):
        t.add_argument(f"--{name}", type=kind)
    t.add_argument("--use-feature-selection", action="store_true")
    t.add_argument("--metrics-file")
    b = sub.add_parser("best-model")
    b.add_argument("--data", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--validation")
    b.add_argument("--metrics-file")
    for name, kind in (("left-window-values", int), ("right-window-values", int), ("n-estimators-values", int), ("max-depth-values", int), ("threshold-values", float)):
        b.add_argument(f"--{name}", type=kind, nargs="+")
    b.add_argument("--sample-rate", type=float)
    b.add_argument("--max-samples", type=int)
    return p


def _analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = read_text_file(spark, a.input).withColumn("doc_id", F.monotonically_increasing_id())
    if a.model:
        bounded = forest.forest_boundaries(docs, forest.load(a.model), threshold=a.threshold)
    else:
        known = listed(from_text(spark, a.abbreviations)) if a.abbreviations else list(DEFAULT)
        bounded = rule_boundaries(docs, known, threshold=0.5 if a.threshold is None else a.threshold)
    if a.format == "annotated":
        out = tagged(bounded).select(F.col("tagged").alias("value"))
    else:
        segments: DataFrame = sentences(bounded).withColumnRenamed("sentence", "s") if a.format == "sentences" else paragraph_spans(bounded).withColumnRenamed("paragraph", "s")
        ordered = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "s"))).alias("all"))
        out = ordered.select(F.array_join(F.transform("all", lambda x: x["s"]), "\n" if a.format == "sentences" else "\n\n").alias("value"))
    if a.output:
        out.write.mode("overwrite").text(a.output)
    else:
        for row in out.toLocalIterator():
            print(row["value"])
    if a.metrics:
        figures = {}
        if a.format != "paragraphs":
            s = corpus_statistics(sentences(bounded), "sentence").first()
            figures |= {"num_sentences": s["n"]} | ({"avg_sentence_length": s["mean_length"] or 0} if a.format == "sentences" else {})
        if a.format != "sentences":
            p = corpus_statistics(paragraph_spans(bounded), "paragraph").first()
            figures |= {"num_paragraphs": p["n"]} | ({"avg_paragraph_length": p["mean_length"] or 0} if a.format == "paragraphs" else {})
        write_document(spark, json.dumps(figures, indent=2), a.metrics)


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    made, figures = forest.train(
        training_texts(spark, a.data, a.max_samples), left=a.left_window, right=a.right_window, trees=a.n_estimators, depth=a.max_depth, sample_rate=a.sample_rate, threshold=a.threshold,
        selection_threshold=a.feature_selection_threshold, max_features=a.max_features, model_type="feature_selected_rf" if a.use_feature_selection else None,
    )
    forest.save(made, a.output)
    if a.metrics_file:
        save_metrics(figures, a.metrics_file)


def _best(spark: SparkSession, a: argparse.Namespace) -> None:
    given = {"left": a.left_window_values, "right": a.right_window_values, "trees": a.n_estimators_values, "depth": a.max_depth_values, "thresholds": a.threshold_values}
    base = forest.Config(sample_rate=a.sample_rate if a.sample_rate is not None else 0.1)
    held = training_texts(spark, a.validation, a.max_samples) if a.validation else None
    made, tried = best_model(training_texts(spark, a.data, a.max_samples), held, base=base, **{k: v for k, v in given.items() if v})
    forest.save(made, a.output)
    if a.metrics_file:
        write_document(spark, json.dumps(tried, indent=2), a.metrics_file)


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 1
    spark = SparkSession.builder.appName("passagework").getOrCreate()
    {"analyze": _analyze, "train": _train, "best-model": _best}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
