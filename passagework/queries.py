"""Registered queries of the boundary engine over the whole driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.batches import Look, placed
from .functions.chars import BULLETS, CANDIDATES, LIST_INTROS, LIST_MARKERS, OTHER_DIGITS, PUNCTUATION, candidate_positions, characters, encode, encode_one_hot, exploded, surroundings
from .functions.features import FLAGS, window
from .functions.labels import annotate, boundaries, clean_text
from .functions import sql
from .operators import abbreviations, forest
from .operators.abbreviations import DEFAULT
from .operators.segments import corpus_statistics, paragraph_spans, sentence_spans, sentences, tagged
from .plans.rules import passes, rule_boundaries, rule_sentences, scored
from .plans.search import best_model
from .streaming.chunks import adjoined, chunked_boundaries, chunked_forest, cut, forest_reach

_L, _I = "long", "int"
#: About how many turns of conversations go to one task.
TURNS = 8192


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt over the cores first, as a file's row groups may be few."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages", "page_id", "html").withColumnRenamed("html", "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns in order: dealt out by turns and not by bytes, of which they have few for what follows."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    tasks = max(spark.sparkContext.defaultParallelism, turns.count() // TURNS)
    return turns.repartition(tasks, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("all"))


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast(_L).alias(c) if t == _I else F.col(c) for c, t in df.dtypes))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(_documents(spark, sf_dir).select("doc_id", F.explode(candidate_positions("text")).alias("pos")))


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(_documents(spark, sf_dir).select("doc_id", F.size(candidate_positions("text")).alias("n")))


def encoding_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(F.explode(characters("text")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return _longs(rows.groupBy(encode(F.col("c")).alias("code")).agg(F.sum("n").alias("n")))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.posexplode(characters("text")).alias("pos", "c"))
    return _longs(rows.select("item_id", "pos", encode_one_hot(F.col("c")).alias("code")))


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surroundings(_read(spark, sf_dir, "benchmark", "item_id", "text"), mode="full")
    return _longs(rows.select("item_id", "pos", F.posexplode(window(5, 5)).alias("k", "code")))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(_pages(spark, sf_dir), Look(0, 0, abbreviations=DEFAULT))
    return _longs(rows.select("page_id", "pos", *(F.element_at("features", i + 2).alias(name) for i, name in enumerate(FLAGS))))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return turns.select("conv_id", annotate(F.transform("all", lambda x: x["t"])).alias("annotated"))


def label_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(_annotated(spark, sf_dir).select("conv_id", F.explode(boundaries("annotated")).alias("bound")))


def annotate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("conv_id", clean_text("annotated").alias("clean"))


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_boundaries(_documents(spark, sf_dir), list(DEFAULT))


def rule_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(exploded(_bounded(spark, sf_dir).select("doc_id", "bounds"), "bounds", "bound").drop("bounds"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(rule_sentences(_documents(spark, sf_dir), list(DEFAULT)))


def nonblank_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(rule_sentences(_documents(spark, sf_dir), list(DEFAULT), blank=False).select("doc_id", "start", "end"))


def segment_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(_bounded(spark, sf_dir)).select("doc_id", "tagged")


def sentence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(sentences(rule_boundaries(_pages(spark, sf_dir), list(DEFAULT))))


def conversation_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(paragraph_spans(rule_boundaries(_joined_turns(spark, sf_dir), list(DEFAULT))))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(scored(_documents(spark, sf_dir), list(DEFAULT)).select("_scores"), "_scores", "s").drop("_scores")
    levels = (0.1, 0.3, 0.5, 0.7, 0.9)
    counts = rows.agg(*(F.sum(F.when(passes(F.col("s.p"), t), 1).otherwise(0)).alias(f"t{int(t * 10)}") for t in levels))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{int(t * 10)}").alias("n")) for t in levels))).alias("r")).select("r.*")


def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir).select("conv_id", clean_text("annotated").alias("text"), boundaries("annotated").alias("truth"))
    return forest.metrics_of_bounds(rule_boundaries(rows, list(DEFAULT)), "truth", "bounds")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return corpus_statistics(rule_sentences(docs, list(DEFAULT)), "sentence", "lang")


def _differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """How many boundaries stand in one of two tables (doc_id, bound) alone."""
    signed = lambda rows, sign: rows.select("doc_id", F.col("bound").cast(_L), F.lit(sign).alias("s"))
    return signed(one, 1).unionByName(signed(other, -1)).groupBy("doc_id", "bound").agg(F.sum("s").alias("s")).where("s <> 0").agg(F.count("*").alias("differences"))


def chunked_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    whole = exploded(rule_boundaries(docs, list(DEFAULT)).select("doc_id", "bounds"), "bounds", "bound")
    return _differences(whole, chunked_boundaries(cut(docs, 1000), list(DEFAULT)))


def chunked_forest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of a forest over whole documents against those over pieces that find their surroundings by joins."""
    docs, config, trees = _documents(spark, sf_dir), replace(SAMPLE_CONFIG, mode="reference"), forest.trees_from(SAMPLE_TREES)
    whole = exploded(forest.boundaries(docs, config, trees).select("doc_id", "bounds"), "bounds", "bound")
    pieces = cut(docs, 1000).select("doc_id", "part", "offset", "text")
    return _differences(whole, chunked_forest(adjoined(pieces, around=forest_reach(config), carry=True), config, trees))


#: A forest of four trees over windows of three characters on both sides and the flags, fitted once on conversations.
SAMPLE_CONFIG = forest.Config(left=3, right=3, trees=4, depth=4, mode="full")
SAMPLE_TREES = (
    (11, 0.5, (8, 0.5, 0.0, (0, 146.0, (2, 139.5, 0.7233, 0.0), 0.9041)), 0.0),
    (11, 0.5, (4, 0.0, (2, 136.5, (5, -2.5, 0.9252, 0.0), (5, -2.5, 0.9742, 0.0)), (1, 23.5, 0.9049, (5, 9.5, 0.7486, 0.0))), 0.0),
    (8, 0.5, 0.0, (6, -2.5, (4, -1.5, (6, -3.5, 0.0, 0.9771), 1.0), (6, 5.5, 0.7641, (5, 19.5, 0.6625, 0.2586)))),
    (6, -2.5, (5, -2.5, (11, 0.5, 0.9973, 0.0), (2, 0.0, 0.0, (3, 0.0, 0.8792, 0.0))), (8, 0.5, 0.0, (5, 19.5, 0.6774, (6, 12.5, 0.1985, 0.7149)))),
)


def _by_forest(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    return forest.boundaries(docs, SAMPLE_CONFIG, forest.trees_from(SAMPLE_TREES), threshold)


def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of all documents by the sample forest."""
    return _longs(exploded(_by_forest(_documents(spark, sf_dir)).select("doc_id", "bounds"), "bounds", "bound").drop("bounds"))


def forest_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every candidate of the pages by the sample forest, row by row as training sees it."""
    rows = placed(_pages(spark, sf_dir), Look(3, 3, abbreviations=DEFAULT))
    return _longs(rows.select("page_id", "pos", F.round(forest.trees_from(SAMPLE_TREES).probability(F.col("features")), 9).alias("p")))


def forest_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the sample forest over conversations with known sentences."""
    rows = _annotated(spark, sf_dir).select(clean_text("annotated").alias("text"), boundaries("annotated").alias("truth"))
    return forest.metrics_of_bounds(_by_forest(rows), "truth", "bounds")


def forest_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence spans of all documents by the sample forest, at a threshold of its own."""
    return _longs(sentence_spans(_by_forest(_documents(spark, sf_dir), 0.4)).select("doc_id", "ord", "start", "end"))


def training_rows(rate: float) -> Callable[[SparkSession, str], DataFrame]:
    """Sums of the window's codes over the characters that train, by label and place in the window."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = _annotated(spark, sf_dir).select(F.col("annotated").alias("text"))
        rows = forest.training_rows(data, forest.Config(left=2, right=2, sample_rate=rate))
        return _longs(rows.select("label", F.posexplode(F.slice("features", 1, 5)).alias("k", "code")).groupBy("label", "k").agg(F.count("*").alias("n"), F.sum("code").alias("codes")))

    return query


def _told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table; by Arrow, as lists would go through Python on the executors."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: [r[i] for r in rows] for i, name in enumerate(names)}), schema)


def _small(**changes) -> forest.Config:
    return replace(forest.PRESETS["small"], trees=8, depth=6, **changes)


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select(F.col("annotated").alias("text"))


def forest_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of the benchmark by a small forest trained on conversations with known sentences."""
    made = forest.fitted(_training(spark, sf_dir), _small())
    docs = _read(spark, sf_dir, "benchmark", "item_id", "text")
    return _longs(exploded(forest.forest_boundaries(docs, made).select("item_id", "bounds"), "bounds", "bound").drop("bounds"))


def forest_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every feature of a forest trained on conversations."""
    made = forest.fitted(_training(spark, sf_dir), _small())
    return _told(spark, list(forest.importances(made).items()), "feature long, importance double")


def forest_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that selection keeps, by rank, with their importance in the forest fitted on them."""
    made = forest.fitted(_training(spark, sf_dir), _small(model_type="feature_selected_rf", max_features=6))
    kept = forest.importances(made)
    return _told(spark, [(k, f, kept[f]) for k, f in enumerate(made.selected)], "rank long, feature long, importance double")


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every combination of a small search over windows, depths and thresholds."""
    _, tried = best_model(_training(spark, sf_dir), None, (3, 5), (3,), (4,), (4, 6), (0.3, 0.5), forest.Config(sample_rate=0.01))
    names = ("left", "right", "trees", "depth", "threshold", "accuracy", "precision", "recall", "f1_score")
    return _told(spark, [tuple(t[n] for n in names) for t in tried], "left long, right long, trees long, depth long, threshold double, accuracy double, precision double, recall double, f1_score double")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions over the pages."""
    sql.register(spark)
    told = _pages(spark, sf_dir).selectExpr("page_id", "split_sentences(text) AS sentence", "sentence_bounds(text) AS bound")
    return _longs(told.select("page_id", F.posexplode(F.arrays_zip("sentence", "bound")).alias("ord", "s")).select("page_id", "ord", "s.sentence", "s.bound"))


def sql_sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the pages by a table function in SQL."""
    sql.register(spark)
    return _longs(spark.sql("SELECT p.page_id, s.ord, s.start, s.`end`, s.sentence FROM {pages} p, LATERAL sentence_rows(p.text) s", pages=_pages(spark, sf_dir)))


def _joined_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return turns.select("conv_id", F.array_join(F.transform("all", lambda x: x["t"]), "\n\n").alias("text"))


def sql_paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of the conversations by a table function in SQL."""
    sql.register(spark)
    return _longs(spark.sql("SELECT c.conv_id, p.ord, p.start, p.`end`, p.paragraph FROM {turns} c, LATERAL paragraph_rows(c.text) p", turns=_joined_turns(spark, sf_dir)))


def abbreviation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full stops of the documents that end an abbreviation of a table, which is joined and not listed."""
    table = abbreviations.table(spark)
    places = surroundings(_documents(spark, sf_dir), mode="full", reach=max(50, abbreviations.longest(table)))
    return _longs(abbreviations.marked(places, table).where("_known = 1").select("doc_id", "pos"))


def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features of every candidate of all documents, counted by place in the window and code."""
    rows = placed(_documents(spark, sf_dir).select("text"), Look(5, 5, flags=False)).select(F.posexplode("features").alias("k", "code"))
    return _longs(rows.groupBy("k", "code").agg(F.count("*").alias("n")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "candidate_positions": positions, "candidate_counts": candidate_counts, "char_encoding_histogram": encoding_histogram, "onehot_encoding": one_hot, "window_features_l5r5": window_features,
    "page_flags": page_flags, "label_positions": label_positions, "annotate_roundtrip": annotate_roundtrip, "rule_boundaries": rule_bounds, "sentence_spans": spans, "nonblank_sentence_spans": nonblank_spans,
    "segment_text_tagged": segment_tagged, "sentences_list": sentence_list, "paragraph_spans": conversation_paragraphs, "threshold_sweep": threshold_sweep, "evaluation_metrics": evaluation_metrics,
    "corpus_stats_by_lang": corpus_stats, "chunked_equals_unchunked": chunked_difference, "chunked_forest_equals_whole": chunked_forest_difference, "forest_scores": forest_scores,
    "forest_probabilities": forest_probabilities, "forest_evaluation": forest_evaluation, "forest_sentences": forest_sentences, "training_rows_rate0": training_rows(0.0), "training_rows_rate1": training_rows(1.0),
    "forest_trained": forest_trained, "forest_importances": forest_importances, "forest_selected": forest_selected, "grid_search": grid_search, "sql_functions": sql_functions,
    "sql_sentence_rows": sql_sentence_rows, "sql_paragraph_rows": sql_paragraph_rows,
    "abbreviation_join": abbreviation_join, "document_windows": document_windows,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(items) -> str:
    return "(" + ", ".join(f"chr({ord(x)})" if x in "\n\r" else _q(x) for x in items) + ")"


_CAND = _in(CANDIDATES)
_WS = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_PUNCT = "[" + "".join(f"\\x{{{p:X}}}" for p in PUNCTUATION) + "]"


def _chars(table: str, key: str, text: str = "text") -> str:
    """k, t (the text), pos, c of every character."""
    return f"SELECT k, t, pos, substr(t, pos + 1, 1) AS c FROM (SELECT {key} AS k, {text} AS t, unnest(range(length({text}))) AS pos FROM {table} WHERE length({text}) > 0)"


def _spread(table: str, key: str, text: str = "text") -> str:
    """As _chars, splitting each text once."""
    return f"SELECT k, unnest(range(len(l))) AS pos, unnest(l) AS c, unnest(l[2:] || ['']) AS nx FROM (SELECT {key} AS k, string_split({text}, '') AS l FROM {table} WHERE length({text}) > 0)"


def _code(c: str) -> str:
    digits = " OR ".join(f"unicode({c}) BETWEEN {a} AND {b}" for a, b in OTHER_DIGITS)
    return f"""CASE WHEN regexp_matches({c}, '^\\p{{L}}') THEN unicode(lower({c})) - 96 WHEN regexp_matches({c}, '^\\p{{Nd}}') OR (unicode({c}) > 127 AND ({digits})) THEN 0
 WHEN {c} IN {_in([x for x in CANDIDATES if x not in chr(10) + chr(13)])} THEN -1 WHEN {c} IN (chr(10), chr(13)) THEN -2
 WHEN {c} IN (' ', chr(9), chr(160)) THEN -3 WHEN regexp_matches({c}, '^{_PUNCT}') THEN -4 ELSE -5 END"""


_CODE = _code("c")


def _rule(table: str, key: str, text: str = "text") -> str:
    """k, pos, p of every candidate by the rule."""
    longest = max(map(len, DEFAULT))
    abbr = ", ".join(_q(a) for a in DEFAULT)
    quotes = "('\"', '”', '''', '’')"
    ends = "(nx IS NULL OR nx IN (' ', chr(10), chr(9)))"
    known = f"regexp_extract(tail, '[\\p{{L}}\\p{{N}}.]*$') IN ({abbr})"
    closes = f"(pv IN ('.', '!', '?') AND NOT regexp_matches(n2, '^\\p{{Ll}}') AND NOT coalesce({known}, false))"
    upto = lambda last: f"array_to_string(l[greatest({last} - {longest}, 1):{last}], '')"
    return f"""SELECT k, pos, CASE WHEN c = chr(10) THEN 0.4 WHEN c IN {quotes} AND {ends} THEN CASE WHEN {closes} THEN 0.9 WHEN c IN ('"', '”') THEN 0.3 ELSE 0.1 END
 WHEN c NOT IN ('.', '!', '?') THEN 0.1 WHEN c = '.' AND {known} THEN 0.2 WHEN {ends} THEN 0.9 ELSE 0.3 END AS p
 FROM (SELECT k, pos, c, pv, nx, n2, CASE WHEN c = '.' THEN {upto('pos + 1')} WHEN pv = '.' AND c IN {quotes} THEN {upto('pos')} END AS tail
 FROM (SELECT k, l, pos, l[pos + 1] AS c, CASE WHEN pos > 0 THEN l[pos] ELSE '' END AS pv, CASE WHEN pos + 2 <= len(l) THEN l[pos + 2] END AS nx, CASE WHEN pos + 3 <= len(l) THEN l[pos + 3] ELSE '' END AS n2 FROM (
  SELECT k, l, unnest(list_filter(range(len(l)), lambda i: l[i + 1] IN {_CAND})) AS pos FROM (SELECT {key} AS k, string_split({text}, '') AS l FROM {table} WHERE length({text}) > 0))))"""


def _segments(table: str, key: str, text: str = "text", more: str = "") -> str:
    """k, t, ord, start, end of the sentences by the rule."""
    return f"""SELECT d.k, d.t{more}, unnest(range(len(b) - 1)) AS ord, unnest(b[1:len(b) - 1]) AS "start", unnest(b[2:]) AS "end" FROM (
 SELECT x.k, x.t{more}, list_sort(list_distinct(list_concat([0, length(x.t)], coalesce(r.b, [])))) AS b FROM (SELECT {key} AS k, {text} AS t{more} FROM {table} WHERE length({text}) > 0) x
 LEFT JOIN (SELECT k, list(pos + 1) AS b FROM ({_rule(table, key, text)}) WHERE p > 0.5 GROUP BY k) r ON x.k = r.k) d"""


_TURNS = "(SELECT conv_id, string_agg(coalesce(text, ''), '{sep}' ORDER BY turn, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id)"
_BLANK_LINES = _TURNS.replace("'{sep}'", "chr(10) || chr(10)")
_TRUTH = "SELECT DISTINCT conv_id AS k, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '') ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bound FROM conversations"
_MARKS = "(?:" + "|".join("".join(f"\\{x}" if x in "().*+?[]" else x for x in m) for m in LIST_MARKERS) + ")"
_INTROS = "(?:" + "|".join(LIST_INTROS) + ")"


def _conj(a: str) -> str:
    return " OR ".join(f"(instr({a}, {_q(c)}) - 1 BETWEEN 1 AND 4 AND substr({a}, instr({a}, {_q(c)}) - 1, 1) IN (';', ','))" for c in (" and ", " or ", " and/or ", " as well as "))


def _page_flags(table: str = "pages", key: str = "page_id", text: str = "html", more: str = "") -> str:
    """The flags of every candidate; more: further columns from l (the characters), pos and c."""
    low = "regexp_matches(nx, '^\\p{Ll}')"
    b20, a20 = "array_to_string(l[greatest(pos - 19, 1):pos], '')", "array_to_string(l[pos + 1:pos + 20], '')"
    b50, a50 = "array_to_string(l[greatest(pos - 49, 1):pos], '')", "array_to_string(l[pos + 1:pos + 50], '')"
    abbr = ", ".join(_q(a) for a in DEFAULT)
    quotes = {n: f"len(list_filter(l[1:pos + 1], lambda x: x = {_q(q)}))" for n, q in (("s", '"'), ("o", "“"), ("e", "”"), ("i", "'"), ("io", "‘"), ("ie", "’"))}
    edge = "(c IN ('.', ',', ';', ':', '(', ')', '[', ']') OR pv IN ('.', ',', ';', ':', '(', ')') OR nx IN ('.', ',', ';', ':', '(', ')', '[', ']'))"
    typical = f"(c <> '' AND contains('()0123456789abcdefghijklmnopqrstuvwxyz.{BULLETS}', c))"
    inner = "(pos > 0 AND pos < len(l) - 1 AND (c IN ('.', ',', ';', ':') OR pv IN ('.', ',', ';', ':')))"
    return f"""WITH s AS (SELECT {key}, l, pos, l[pos + 1] AS c, CASE WHEN pos > 0 THEN l[pos] ELSE '' END AS pv, CASE WHEN pos + 2 <= len(l) THEN l[pos + 2] ELSE '' END AS nx FROM (
 SELECT {key}, l, unnest(list_filter(range(len(l)), lambda i: l[i + 1] IN {_CAND})) AS pos FROM (SELECT {key}, string_split({text}, '') AS l FROM {table} WHERE length({text}) > 0))),
w AS (SELECT *, {b20} AS b20, {a20} AS a20, {b50} AS b50, {a50} AS a50 FROM s)
SELECT {key}, pos,{more}
 CAST(c = '.' AND regexp_extract({b50} || c, '[\\p{{L}}\\p{{N}}.]*$') IN ({abbr}) AS BIGINT) AS abbreviation,
 CAST(CASE WHEN c IN ('.', '!', '?') THEN 1 WHEN c IN (chr(10), chr(13)) THEN 0 ELSE -1 END AS BIGINT) AS terminator,
 CAST(CASE WHEN c NOT IN ('"', '“', '”', '''', '‘', '’') THEN 1 WHEN {quotes["s"]} % 2 = 0 AND {quotes["o"]} = {quotes["e"]} AND {quotes["i"]} % 2 = 0 AND {quotes["io"]} = {quotes["ie"]} THEN 1 ELSE 0 END AS BIGINT) AS balanced,
 CAST(CASE WHEN c IN ('"', '”', '''', '’') AND nx <> '' AND {low} THEN 0 ELSE 1 END AS BIGINT) AS complete,
 CAST(nx <> '' AND {low} AS BIGINT) AS lower_next,
 CAST(({edge} OR {typical}) AND ({typical} OR {inner}) AND (regexp_matches(b20, '{_MARKS}$') OR regexp_matches(a20, '^{_MARKS}')
  OR ({edge} AND ((length(b20) >= 5 AND contains(right(b20, 5), ':') AND regexp_matches(b20, '{_INTROS}')) OR ((c IN (';', ',') OR pv IN (';', ',')) AND ({_conj("a20")}))))) AS BIGINT) AS list_item,
 CAST(c = ';' AND (length(b50 || a50) - length(replace(b50 || a50, ';', '')) >= 2 OR regexp_matches(b50 || a50, '{_MARKS}') OR regexp_matches(b50, '{_INTROS}') OR regexp_matches(a50, ' and | or | and/or | as well as ')) AS BIGINT) AS semicolon_list,
 CAST(contains(right(b20, 10), ':') AND (c = ':' OR pv = ':' OR nx = ':') AS BIGINT) AS near_colon
FROM w"""


def _tree_sql(node: tuple | float) -> str:
    if not isinstance(node, tuple):
        return repr(float(node))
    return f"CASE WHEN f[{node[0] + 1}] <= {node[1]} THEN {_tree_sql(node[2])} ELSE {_tree_sql(node[3])} END"


def _forest_sql(table: str, key: str, text: str = "text") -> str:
    """key, pos and p of every candidate by the sample forest."""
    at = [f"(CASE WHEN pos + 1 + {k} BETWEEN 1 AND len(l) THEN l[pos + 1 + {k}] END)" for k in range(-3, 4)]
    codes = ", ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN {_code(c)} END, -3)" for c in at)
    flags_ = _page_flags(table, key, text, f" [{codes}] AS win,")
    mean = " + ".join(f"({_tree_sql(t)})" for t in SAMPLE_TREES)
    return f"SELECT {key}, pos, ({mean}) / {len(SAMPLE_TREES)} AS p FROM (SELECT {key}, pos, list_concat(win, [{', '.join(FLAGS)}]) AS f FROM ({flags_}))"


def _training_sql(where: str) -> str:
    table = _TURNS.replace("{sep}", "")
    return f"""WITH e AS (SELECT k, pos, c, CAST({_CODE} AS BIGINT) AS code FROM ({_spread(table, "conv_id")})), b AS (SELECT k, bound FROM ({_TRUTH}) WHERE bound > 0),
r AS (SELECT e.k, e.pos, CASE WHEN b.k IS NULL THEN 0 ELSE 1 END AS label FROM e LEFT JOIN b ON b.k = e.k AND b.bound = e.pos + 1 WHERE {where})
SELECT CAST(r.label AS BIGINT) AS label, o.k AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(e.code, -3)) AS BIGINT) AS codes
 FROM r, (SELECT unnest(range(5)) AS k) o LEFT JOIN e ON e.k = r.k AND e.pos = r.pos + o.k - 2 GROUP BY 1, 2"""


def _sentences_sql() -> str:
    """Lists of sentences: cut at tags, lone quotes given to a neighbour step by step."""
    lone = lambda x: f"regexp_full_match({x}, '{_WS}*\"{_WS}*')"
    first = f"(right(arr[i], 1) = '\"' AND i + 2 <= len(arr) AND {lone('arr[i + 1]')})"
    second = lone("arr[i]")
    segments = _segments("pages", "page_id", "html")
    return f"""WITH RECURSIVE s AS (SELECT s.k, s.ord, substr(t, "start" + 1, "end" - "start") AS piece, CASE WHEN "end" < length(t) AND right(substr(t, "start" + 1, "end" - "start"), 1) = '"' AND substr(t, "end" + 1, 1) NOT IN (' ', chr(10), chr(9)) THEN 0 ELSE 1 END AS cut FROM ({segments}) s),
g AS (SELECT k, ord, piece, coalesce(sum(cut) OVER (PARTITION BY k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM s),
p AS (SELECT k, part, string_agg(piece, '' ORDER BY ord) AS piece FROM g GROUP BY k, part),
a AS (SELECT k, list(piece ORDER BY part) AS arr FROM p WHERE piece <> '' GROUP BY k),
r AS (SELECT k, arr, 1 AS i FROM a UNION ALL
 SELECT k, CASE WHEN {first} THEN list_concat(arr[1:i], ['" ' || arr[i + 2]], arr[i + 3:]) WHEN {second} THEN list_concat(arr[1:i - 1], [arr[i] || arr[i + 1]], arr[i + 2:]) ELSE arr END,
  CASE WHEN {first} OR {second} THEN i ELSE i + 1 END FROM r WHERE i < len(arr)),
z AS (SELECT k, arr FROM r WHERE i >= len(arr))
SELECT k AS page_id, CAST(o AS BIGINT) AS ord, arr[o + 1] AS sentence FROM (SELECT k, arr, unnest(range(len(arr))) AS o FROM z)"""


_TURN_TEXT = _TURNS.replace("{sep}", "")


def _forest_spans() -> str:
    return f"""SELECT d.doc_id, unnest(range(len(b) - 1)) AS ord, unnest(b[1:len(b) - 1]) AS "start", unnest(b[2:]) AS "end" FROM (
 SELECT x.doc_id, list_sort(list_distinct(list_concat([0, length(x.text)], coalesce(r.b, [])))) AS b FROM (SELECT doc_id, text FROM documents WHERE length(text) > 0) x
 LEFT JOIN (SELECT doc_id, list(pos + 1) AS b FROM ({_forest_sql("documents", "doc_id")}) WHERE p >= 0.4 GROUP BY doc_id) r ON x.doc_id = r.doc_id) d"""


SQL: dict[str, str] = {
    "candidate_positions": f"SELECT k AS doc_id, pos FROM ({_spread('documents', 'doc_id')}) WHERE c IN {_CAND}",
    "candidate_counts": f"SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), ''), lambda c: c IN {_CAND})) AS BIGINT) AS n FROM documents",
    "char_encoding_histogram": f"SELECT CAST({_CODE} AS BIGINT) AS code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c, count(*) AS n FROM ({_spread('documents', 'doc_id')}) GROUP BY c) GROUP BY 1",
    "onehot_encoding": f"SELECT k AS item_id, pos, CAST(unicode(c) AS BIGINT) AS code FROM ({_spread('benchmark', 'item_id')})",
    "window_features_l5r5": f"""WITH e AS (SELECT k, pos, c, CAST({_CODE} AS BIGINT) AS code FROM ({_spread("benchmark", "item_id")}))
SELECT p.k AS item_id, p.pos, o.k AS k, coalesce(e.code, -3) AS code FROM (SELECT k, pos FROM e WHERE c IN {_CAND}) p, (SELECT unnest(range(11)) AS k) o LEFT JOIN e ON e.k = p.k AND e.pos = p.pos + o.k - 5""",
    "page_flags": _page_flags(),
    "label_positions": f"SELECT k AS conv_id, bound FROM ({_TRUTH}) WHERE bound > 0",
    "annotate_roundtrip": f"SELECT conv_id, text AS clean FROM {_TURNS.replace('{sep}', '')}",
    "rule_boundaries": f"SELECT k AS doc_id, pos + 1 AS bound FROM ({_rule('documents', 'doc_id')}) WHERE p > 0.5",
    "sentence_spans": f'SELECT k AS doc_id, ord, "start", "end", substr(t, "start" + 1, "end" - "start") AS sentence FROM ({_segments("documents", "doc_id")})',
    "nonblank_sentence_spans": f"""SELECT k AS doc_id, "start", "end" FROM ({_segments("documents", "doc_id")}) WHERE NOT regexp_full_match(substr(t, "start" + 1, "end" - "start"), '{_WS}*')""",
    "segment_text_tagged": f"""SELECT d.doc_id, coalesce(g.tagged, '') AS tagged FROM documents d LEFT JOIN (
 SELECT k, string_agg(substr(t, "start" + 1, "end" - "start") || CASE WHEN r.b THEN '<|sentence|>' ELSE '' END, '' ORDER BY ord) AS tagged FROM ({_segments("documents", "doc_id")}) s
 LEFT JOIN (SELECT k AS rk, pos + 1 AS rb, true AS b FROM ({_rule("documents", "doc_id")}) WHERE p > 0.5) r ON r.rk = s.k AND r.rb = s."end" GROUP BY k) g ON g.k = d.doc_id""",
    "paragraph_spans": f"""WITH t AS (SELECT conv_id, text, length(text) AS n FROM {_BLANK_LINES}), r AS (SELECT k, pos + 1 AS b FROM ({_rule(_BLANK_LINES, "conv_id")}) WHERE p > 0.5),
c AS (SELECT k, b FROM r JOIN t ON t.conv_id = r.k WHERE b < n AND regexp_matches(substr(text, b + 1, 10), '^(?s:.{{0,3}})\\n{_WS}*\\n') UNION SELECT conv_id, n FROM t WHERE n > 0),
p AS (SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY b), 0) AS s, b AS e FROM c),
q AS (SELECT k, s, e, regexp_replace(substr(text, s + 1, e - s), '^{_WS}+|{_WS}+$', '', 'g') AS paragraph, n FROM p JOIN t ON t.conv_id = p.k),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS ord, lead(s) OVER (PARTITION BY k ORDER BY s) AS nx FROM q WHERE paragraph <> '')
SELECT k AS conv_id, ord, CASE WHEN ord = 0 THEN 0 ELSE s END AS "start", coalesce(nx, n) AS "end", paragraph FROM f""",
    "threshold_sweep": f"""SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(sum(CASE WHEN CASE WHEN threshold = 0.5 THEN p > 0.5 ELSE p >= threshold END THEN 1 ELSE 0 END) AS BIGINT) AS n
 FROM ({_rule("documents", "doc_id")}), (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold) GROUP BY 1""",
    "evaluation_metrics": f"""WITH t AS (SELECT conv_id, text FROM {_TURNS.replace("{sep}", "")}), a AS (SELECT k, bound FROM ({_TRUTH}) WHERE bound > 0), p AS (SELECT k, pos + 1 AS bound FROM ({_rule(_TURNS.replace("{sep}", ""), "conv_id")}) WHERE p > 0.5),
c AS (SELECT (SELECT count(*) FROM a JOIN p USING (k, bound)) AS tp, (SELECT count(*) FROM p) AS pp, (SELECT count(*) FROM a) AS tt, (SELECT sum(length(text)) FROM t) AS n)
SELECT (n - (pp - tp) - (tt - tp)) / n AS accuracy, tp / pp AS "precision", tp / tt AS recall, 2 * tp / (pp + tt) AS f1_score, tp / (pp + tt - tp) AS boundary_accuracy, true AS binary_mode FROM c""",
    "corpus_stats_by_lang": f"""SELECT lang, CAST(count(*) AS BIGINT) AS n, avg("end" - "start") AS mean_length FROM ({_segments("documents", "doc_id", more=", lang")}) GROUP BY lang""",
    "chunked_equals_unchunked": "SELECT CAST(0 AS BIGINT) AS differences",
    "chunked_forest_equals_whole": "SELECT CAST(0 AS BIGINT) AS differences",
    "forest_scores": f"SELECT doc_id, pos + 1 AS bound FROM ({_forest_sql('documents', 'doc_id')}) WHERE p > 0.5",
    "forest_probabilities": f"SELECT page_id, pos, round(p, 9) AS p FROM ({_forest_sql('pages', 'page_id', 'html')})",
    "forest_sentences": _forest_spans(),
    "forest_evaluation": f"""WITH t AS (SELECT conv_id, text FROM {_TURN_TEXT}), a AS (SELECT k, bound FROM ({_TRUTH}) WHERE bound > 0), p AS (SELECT conv_id AS k, pos + 1 AS bound FROM ({_forest_sql(_TURN_TEXT, "conv_id")}) WHERE p > 0.5),
c AS (SELECT (SELECT count(*) FROM a JOIN p USING (k, bound)) AS tp, (SELECT count(*) FROM p) AS pp, (SELECT count(*) FROM a) AS tt, (SELECT sum(length(text)) FROM t) AS n)
SELECT (n - (pp - tp) - (tt - tp)) / n AS accuracy, tp / pp AS "precision", tp / tt AS recall, 2 * tp / (pp + tt) AS f1_score, tp / (pp + tt - tp) AS boundary_accuracy, true AS binary_mode FROM c""",
    "training_rows_rate0": _training_sql(f"b.k IS NOT NULL OR e.c IN {_CAND}"),
    "training_rows_rate1": _training_sql("true"),
    "sentences_list": _sentences_sql(),
    "sql_functions": f"""SELECT k AS page_id, ord, substr(t, "start" + 1, "end" - "start") AS sentence, CASE WHEN e IS NOT NULL THEN "end" END AS bound FROM ({_segments("pages", "page_id", "html")}) s
 LEFT JOIN (SELECT k AS rk, pos + 1 AS e FROM ({_rule("pages", "page_id", "html")}) WHERE p > 0.5) r ON r.rk = s.k AND r.e = s."end\"""",
    "document_windows": f"""WITH e AS (SELECT k, pos, c, CAST({_CODE} AS BIGINT) AS code FROM ({_spread("documents", "doc_id")}))
SELECT o.k AS k, coalesce(e.code, -3) AS code, CAST(count(*) AS BIGINT) AS n FROM (SELECT k, pos FROM e WHERE c IN {_CAND}) p, (SELECT unnest(range(11)) AS k) o LEFT JOIN e ON e.k = p.k AND e.pos = p.pos + o.k - 5 GROUP BY 1, 2""",
}
SQL["abbreviation_join"] = f"""SELECT k AS doc_id, pos FROM (SELECT k, l, pos FROM (SELECT k, l, unnest(list_filter(range(len(l)), lambda i: l[i + 1] = '.')) AS pos
 FROM (SELECT doc_id AS k, string_split(text, '') AS l FROM documents WHERE length(text) > 0))) WHERE regexp_extract(array_to_string(l[greatest(pos - 19, 1):pos + 1], ''), '[\\p{{L}}\\p{{N}}.]*$') IN ({", ".join(_q(a) for a in DEFAULT)})"""
SQL["sql_sentence_rows"] = f'SELECT k AS page_id, ord, "start", "end", substr(t, "start" + 1, "end" - "start") AS sentence FROM ({_segments("pages", "page_id", "html")})'
SQL["sql_paragraph_rows"] = SQL["paragraph_spans"]
assert len(FLAGS) == 8
