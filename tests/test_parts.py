"""Parts that can be exchanged, searched, joined and published."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from passagework import queries
from passagework.functions import batches
from passagework.functions.chars import CANDIDATES, surroundings
from passagework.functions.features import Known, flags, with_features
from passagework.functions.labels import labelled_characters
from passagework.operators import abbreviations, forest, growth
from passagework.operators.stages import ENCODERS, Boundaries, Places
from passagework.plans.search import best_model, figures_by_threshold, narrowed
from passagework.sources import files, registry
from passagework.streaming import chunks

ANNOTATED = ["This is one.<|sentence|> Dr. Who is here.<|sentence|> Is he?<|sentence|> Yes.<|sentence|><|paragraph|>", 'He said: "No; never."<|sentence|> See Fig. 3, then go on!<|sentence|> Done.<|sentence|>']


def annotated(spark, n=4, column="text"):
    return spark.createDataFrame([(t,) for t in ANNOTATED * n], f"{column} string")


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("make", [GBTClassifier, LogisticRegression])
def test_pipelines_take_any_classifier(spark, tmp_path, make):
    stages = [Places(left=3, right=3, sampleRate=0.3), make(featuresCol="features", labelCol="label", maxIter=4), Boundaries(threshold=0.4)]
    model = Pipeline(stages=stages).fit(annotated(spark, column="annotated"))
    df = texts(spark, ["This is one. Is he? Yes.", "", None, "no end"])
    rows = lambda m: sorted((r.doc_id, r.bound) for r in m.transform(df).select("doc_id", "bound").collect())
    got = rows(model)
    assert (0, 12) in got and (0, 24) in got and {i for i, _ in got} == {0}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert rows(again) == got and again.stages[0].getOrDefault("left") == 3


def test_places_train_as_the_forest_does(spark):
    config = forest.Config(left=3, right=2, sample_rate=0.4)
    want = sorted((r.label, tuple(r.features)) for r in forest.training_rows(annotated(spark), config).collect())
    rows = Places(left=3, right=2, sampleRate=0.4).transform(annotated(spark, column="annotated"))
    assert sorted((r.label, tuple(int(x) for x in r.features)) for r in rows.collect()) == want
    coded = Places(left=1, right=0, encoder="code_point").transform(texts(spark, ["a."])).first()
    assert list(coded.features[:2]) == [97.0, 46.0]
    ENCODERS["none"] = lambda c: F.lit(7)
    assert list(Places(left=1, right=0, encoder="none").transform(texts(spark, ["a."])).first().features[:2]) == [7.0, 7.0]
    with pytest.raises(ValueError):
        Places(encoder="other").transform(texts(spark, ["a."]))


def test_windows_are_slices(spark):
    base = forest.Config(sample_rate=0.5)
    wide = forest.training_rows(annotated(spark), forest.Config(left=5, right=4, sample_rate=0.5))
    for a, b in ((5, 4), (2, 3), (1, 0)):
        want = sorted((r.label, tuple(r.features)) for r in forest.training_rows(annotated(spark), forest.Config(left=a, right=b, sample_rate=0.5)).collect())
        assert sorted((r.label, tuple(r.features)) for r in narrowed(wide, 5, 4, a, b).collect()) == want
    assert base.sample_rate == 0.5


ODD = ["", None, ".", "\n", "a" * 70 + ".", "U.S.A. v. Dr. X; e.g. 'no'.", "as follows: (1) one; (ii) two, and three; x. four; or five.", "He said: \u201cGo.\u201d \u2018no\u2019 \"yes\" \U0001d4d0. \u00b2; \u00df! \u01c5? z", "include: a; b; c as well as d", "viii. ix. 10. \u2022 x: y\r\n(x) z:"]
ALPHABET = ["a", "b", "i", "v", "x", "1", "0", "(", ")", ".", ".", ";", ":", ",", " ", " ", "\"", "\u201c", "\u201d", "'", "\u2018", "\u2019", "\n", "\r", "\u2022", "Dr.", "No.", " and ", " or ", " as well as ", "following:", "include:", "\U0001d4d0", "\u00e9", "\u00b2", "A", "?", "!"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(ALPHABET) for _ in range(r.choice((3, 20, 90, 400)))) for _ in range(n)]


@pytest.mark.parametrize("mode, variant, left, right, reach", [("full", "array", 5, 5, 50), ("reference", "array", 3, 2, 50), ("reference", "list", 1, 0, 60), ("reference", "array", 0, 0, 50), ("full", "list", 9, 7, 55)])
def test_batches_describe_places_as_expressions_do(spark, mode, variant, left, right, reach):
    df = texts(spark, odd_texts(120, left)).repartition(3)
    entries = [*abbreviations.DEFAULT, "abc.", "a.1."]
    for everywhere in (False, True):
        want = with_features(surroundings(df, "text", everywhere, left, right, mode, reach), entries, left, right, variant)
        got = batches.placed(df, batches.Look(left, right, mode, reach, tuple(entries), variant, everywhere=everywhere))
        rows = lambda x: sorted((r.doc_id, r.pos, tuple(r.features)) for r in x.select("doc_id", "pos", "features").collect())
        assert rows(got) == rows(want)


def test_batches_go_in_groups(monkeypatch):
    monkeypatch.setattr(batches, "CHARACTERS", 100)
    given = odd_texts(60, 1)
    got = list(batches.groups(pa.RecordBatch.from_arrays([pa.array(given)], ["t"]), 0))
    assert [t for g in got for t in g.column(0).to_pylist()] == given and all(g.num_rows == 1 or sum(len((t or "").encode()) for t in g.column(0).to_pylist()) <= 100 for g in got) and len(got) > 20


@pytest.mark.parametrize("rate", [0.0, 0.2, 1.0])
def test_training_rows_without_a_row_for_every_character(spark, rate):
    """The rows that train, with their sample, are those of a filter over all characters."""
    r = random.Random(2)
    df = spark.createDataFrame([("".join(w + r.choice(("", "", "<|sentence|>", "<|paragraph|>")) for w in (t or "")),) for t in odd_texts(25, 5)] + [(None,)], "text string")
    config = forest.Config(left=3, right=2, sample_rate=rate, seed=7)
    rows = labelled_characters(df.select("text", F.xxhash64("text", F.lit(7)).alias("_key")), list(config.abbreviations), 3, 2)
    drawn = F.pmod(F.xxhash64("_key", "pos"), F.lit(1 << 40)) < F.lit(int(rate * (1 << 40)))
    want = rows.where((F.col("label") == 1) | F.col("c").isin(*CANDIDATES) | drawn).select("label", "features", F.xxhash64("_key", "pos").alias("key"))
    got = forest.training_rows(df, config)
    listed = lambda x: sorted((y.label, tuple(y.features), y.key) for y in x.collect())
    assert listed(got) == listed(want)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_conversations_are_dealt_over_all_tasks(spark):
    """What is worked out of conversations costs far more than their bytes, by which Spark would put them into one task."""
    assert queries._annotated(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_ends_are_sent_no_further_than_needed(spark):
    """A short last piece asks for no more neighbours than a long one."""
    pieces = chunks.cut(texts(spark, ["abcd. " * 90 + "x"]), 100).select("doc_id", "part", "offset", "text")
    plan = chunks.adjoined(pieces, around=(50, 50))._jdf.queryExecution().analyzed().toString()
    assert "sequence(1, 1, " in plan


def test_figures_of_all_thresholds(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(r.randint(0, 1), r.choice([0.0, 0.3, 0.5, 0.50001, 0.7, r.random(), 1.0])) for _ in range(400)], "label int, p double")
    thresholds = (0.7, 0.5, 0.3, 0.5, 0.0, 1.0)
    got = figures_by_threshold(rows, thresholds)
    for t, g in zip(thresholds, got):
        want = forest.metrics(forest.with_prediction(rows, t)).first().asDict()
        assert all(abs(want[k] - g[k]) < 1e-12 for k in want)
    assert figures_by_threshold(rows.limit(0), (0.5,))[0]["f1_score"] == 0.0


def test_search_finds_what_single_fits_find(spark):
    made, tried = best_model(annotated(spark), None, (2, 3), (2,), (3,), (3,), (0.4, 0.5), forest.Config(sample_rate=0.3))
    assert [(t["left"], t["threshold"]) for t in tried] == [(2, 0.4), (2, 0.5), (3, 0.4), (3, 0.5)]
    for t in tried:
        alone, _ = forest.train(annotated(spark), forest.Config(left=t["left"], right=2, trees=3, depth=3, sample_rate=0.3))
        rows = forest.training_rows(annotated(spark), alone.config)
        want = forest.metrics(forest.with_prediction(forest.probabilities(rows, alone), t["threshold"])).first()
        assert abs(want.f1_score - t["f1_score"]) < 1e-9
    best = max(t["f1_score"] for t in tried)
    assert (made.config.left, made.config.threshold) == next((t["left"], t["threshold"]) for t in tried if t["f1_score"] == best)


@pytest.mark.parametrize("sent", [abbreviations.SENT, 10])
def test_a_hundred_thousand_abbreviations(spark, monkeypatch, sent):
    monkeypatch.setattr(abbreviations, "SENT", sent)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé.") for _ in range(r.randint(1, 6)))
    known = {word() + "." for _ in range(3000)} | {f"x{i}." for i in range(97_000)} | {"y" * 70 + "."}
    table = spark.createDataFrame([(k,) for k in known], "abbr string")
    rows = [" ".join(r.choice([word() + ".", f"x{r.randint(0, 200_000)}.", "y" * 70 + ".", "yy" * 40 + "."]) for _ in range(40)) for _ in range(40)]
    places = surroundings(texts(spark, rows), mode="full", reach=max(50, abbreviations.longest(table)))
    got = abbreviations.marked(places, table)
    seen = {(x.doc_id, x.pos): x._known for x in got.select("doc_id", "pos", "_known").collect()}
    want = {}
    for i, t in enumerate(rows):
        for at, c in enumerate(t):
            if c in CANDIDATES:
                want[i, at] = int(c == "." and re.search(r"[\w.]*$", t[: at + 1].replace("_", " ")).group() in known)
    assert seen == want and 0 < sum(want.values()) < len(want)
    listed = flags(Known(F.col("_known")))
    assert {(x.doc_id, x.pos): x.abbreviation for x in got.select("doc_id", "pos", *listed).collect()} == want
    assert with_features(got, Known(F.col("_known"))).columns == ["doc_id", "pos", "c", "features"]


def test_models_are_published_whole(spark, tmp_path):
    at = str(tmp_path / "models")
    made, _ = forest.train(annotated(spark), trees=3, depth=3, left=2, right=2)
    assert [registry.publish(made, at, "m") for _ in range(2)] == [1, 2] and registry.versions(spark, at, "m") == [1, 2]
    assert registry.load(at, "m").config == made.config and registry.load([str(tmp_path / "none"), at], "m", 1).gains == made.gains
    forest.save(made, f"{at}/old")
    assert registry.load(at, "old").config == made.config
    part = next((tmp_path / "models/m/v2/config").glob("part-*"))
    part.write_text(part.read_text().replace('"left": 2', '"left": 9'))
    for crc in part.parent.glob(f".{part.name}.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="torn"):
        registry.load(at, "m")
    assert registry.load(at, "m", 1).config == made.config
    (tmp_path / "models/m/v1/manifest.json").unlink()
    with pytest.raises(ValueError, match="torn"):
        registry.load(at, "m", 1)
    for missing in (("none", None), ("m", 7)):
        with pytest.raises(FileNotFoundError):
            registry.load(at, *missing)


def test_files_of_many_blocks(spark, tmp_path):
    r = random.Random(5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        for i in range(6):
            body = "".join(r.choice(["word ", "é", "\n", "\n\n", "\r\n", "\r", "x" * 90]) for _ in range(200)) + ["end", "\n", "\r", "", "y" * 300, "\n\n"][i]
            (tmp_path / f"f{i}.txt").write_bytes(body.encode())
            rows = files.training_texts(spark, str(tmp_path / f"f{i}.txt"))
            assert spark.read.text(str(tmp_path / f"f{i}.txt")).rdd.getNumPartitions() > 5
            with open(tmp_path / f"f{i}.txt", encoding="utf-8") as f:
                assert sorted(x.text for x in rows.collect()) == sorted(f)
        (tmp_path / "empty.txt").write_text("")
        assert files.training_texts(spark, str(tmp_path / "empty.txt")).count() == 0
        with_all = [line for p in sorted(tmp_path.glob("*.txt")) for line in open(p, encoding="utf-8")]
        assert sorted(x.text for x in files.training_texts(spark, str(tmp_path)).collect()) == sorted(with_all)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_untrained_segmenters_refuse(spark, tmp_path):
    bare = forest.Segmenter(forest.Config())
    for use in (lambda: forest.save(bare, str(tmp_path / "m")), lambda: forest.forest_boundaries(texts(spark, ["a."]), bare), lambda: forest.importances(bare), lambda: forest.evaluate(annotated(spark, 1), bare)):
        with pytest.raises(ValueError, match="not trained"):
            use()


def test_colon_flag_of_the_list_variant(spark):
    places = surroundings(texts(spark, ["a: b c. d"]), mode="full")
    got = {v: {r.pos: r.near_colon for r in places.select("pos", *flags([], v)).collect()} for v in ("array", "list")}
    assert got["list"] == {1: 0, 6: 1} and got["array"] == {1: 0, 6: 0}


def test_analysis_report(spark):
    from passagework.functions.features import analysis

    rows, totals = analysis(annotated(spark, 1), ["Dr."], 2, 2)
    clean = [re.sub(r"<\|\w+\|>", "", t) for t in ANNOTATED]
    assert totals.first().asDict() == {"characters": sum(map(len, clean)), "boundaries": 7, "candidates": sum(c in CANDIDATES for t in clean for c in t)}
    assert rows.count() == sum(map(len, clean)) and analysis(annotated(spark, 1).limit(0), [])[1].first().boundaries == 0


def test_trees_take_few_passes_and_little_memory(spark, monkeypatch):
    """Bootstraps of all trees are counted in one pass; fits go on side by side only as far as their rows may be held; a fit without metrics is that of train."""
    rows = spark.createDataFrame([(int(i % 9 == 0), i) for i in range(2000)], "label int, key long")
    counts = growth.class_counts(rows, 5, range(3), True)
    for tree in range(3):
        got = growth.bootstrap(rows, 5, tree, True, True, counts[tree]).collect()
        assert {label: sum(x["count"] for x in got if x.label == label) for label in (0, 1)} == counts[tree]
        assert sorted((x.key, x["count"]) for x in got) == sorted((x.key, x.n) for x in rows.select("key", growth.drawn(F.col("key"), 5, tree).alias("n")).where("n > 0").collect())
    cores = spark.sparkContext.defaultParallelism
    assert [growth.side_by_side(spark, n, 8) for n in (0, 10, growth.HELD * cores // 4, growth.HELD * cores * 50)] == [8, 8, 4, 2] and growth.side_by_side(spark, 10, 1) == 1
    passes, real = [], growth.class_counts
    monkeypatch.setattr(growth, "class_counts", lambda *a: passes.append(a) or real(*a))
    config = forest.Config(left=2, right=2, trees=4, depth=4, per_tree=True, min_split=4, sample_rate=0.3)
    made = forest.fitted(annotated(spark), config)
    assert len(passes) == 1
    like, _ = forest.train(annotated(spark), config)
    assert made.gains == like.gains and (made.model.number == like.model.number).all()


def test_search_makes_vectors_once_for_each_pair_of_windows(spark, monkeypatch):
    made, real = [], forest.array_to_vector
    monkeypatch.setattr(forest, "array_to_vector", lambda c: made.append(c) or real(c))
    _, tried = best_model(annotated(spark), None, (2, 3), (2,), (2,), (2, 3), (0.5,), forest.Config(sample_rate=0.3))
    assert [(t["left"], t["depth"]) for t in tried] == [(2, 2), (2, 3), (3, 2), (3, 3)] and len(made) == 2


def test_rows_that_are_alike_train_as_one(spark, monkeypatch):
    """Rows of a kind are counted together, and their copies make the same trees as all of them do, by selected features, too."""
    r = random.Random(5)
    kinds = [[r.randint(0, 6), r.randint(0, 6), r.randint(0, 1)] for _ in range(60)]
    data = [(int(x[0] + x[1] + r.randint(0, 3) > 7), x, i) for i, x in enumerate(r.choices(kinds, [1 / (1 + k) for k in range(60)], k=4000))]
    rows = spark.createDataFrame(data, "label int, features array<int>, key long").repartition(3)
    held = growth.alike(rows, 3, range(2)).persist()
    assert held.count() < 121 and growth.class_counts(held, 3, range(2), True) == growth.class_counts(rows, 3, range(2), True)
    assert growth.class_counts(held, 3, [1], False) == growth.class_counts(rows, 3, [1], False)
    for tree in range(2):
        every = growth.bootstrap(forest.sliced(rows, None), 3, tree, True, True)
        few = growth.bootstrap(held, 3, tree, True, True, None, 8)
        sums = lambda df: {(x.label, tuple(x.vector)): (x.c, x.n, round(x.w, 6)) for x in df.groupBy("label", "vector").agg(F.sum("count").alias("c"), F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
        a, b = sums(every), sums(few)
        assert {k: (c, min(n, 8), w) for k, (c, n, w) in a.items()} == b and max(n for _, n, _ in a.values()) > 8
        grown = [growth._grown(x.select("label", "vector", "weight"), 6, 4, 8, 7) for x in (every, few)]
        for c in ("id", "left", "right", "feature", "threshold"):
            assert (grown[0][c] == grown[1][c]).all()
        assert len(grown[0]) > 5 and all(abs(grown[0][c] - grown[1][c]).max() < 1e-6 for c in ("zero", "one"))
    seen, real = [], growth._grown
    monkeypatch.setattr(growth, "_grown", lambda df, *a: seen.append((df.count(), len(df.first()["vector"]))) or real(df, *a))
    monkeypatch.setattr(growth, "TOGETHER", 2)
    config = forest.Config(trees=3, depth=4, min_leaf=4, min_split=8, per_tree=True)
    both = [forest.fit(rows, config, s) for s in (None, (1, 0))]
    assert all(n <= 8 * 120 for n, _ in seen) and [w for _, w in seen] == [3, 3, 3, 2, 2, 2]
    assert [len(g) for _, g in both] == [3, 2] and [len(t) for t, _ in both] == [3, 3]


def test_figures_of_a_forest_start_no_python_on_executors(spark, monkeypatch):
    """The few rows that the driver holds after a fit become a table without a Python worker."""
    made = forest.Segmenter(forest.Config(), forest.trees_from([0.5]), (4, 2), (0.75, 0.25))
    monkeypatch.setattr(queries, "_training", lambda spark, sf_dir: None)
    monkeypatch.setattr(forest, "fitted", lambda rows, config: made)
    for query, expected in ((queries.forest_importances, [(4, 0.75), (2, 0.25)]), (queries.forest_selected, [(0, 4, 0.75), (1, 2, 0.25)])):
        rows = query(spark, "")
        assert [tuple(x) for x in rows.collect()] == expected and {t for _, t in rows.dtypes} == {"bigint", "double"}
        assert "PythonRDD" not in rows._jdf.queryExecution().toRdd().toDebugString()
