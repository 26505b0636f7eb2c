"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  Beside
them, high-recall generators propose overlapping candidates: addresses spelled out,
groups of digits, long tokens, and values assigned to names of secrets.  Each candidate
gets features of its format and of the text around it, boosted trees score it, and a
threshold calibrated for its kind on examples that the trees did not learn from
decides.  Accepted candidates that overlap a base span, or a candidate that is farther
above its threshold, are dropped; sorted spans are searched by halving for that.

Scoring stays in one row: matches and the pieces between them give the places by
running sums, so no row is exploded or shuffled, and very long texts are whole.  The
trees are learned by Spark's own gradient boosting, and are applied as an expression.
They learn from made examples of known kind and from the documents: of about
``max_documents`` documents drawn by a hash, at most ``max_examples`` different base
spans of at most 400 characters and long plain words are put into another form of
known label where they stand (``document_examples``).

Defined results: null and empty texts have no spans; the digest is then that of the
empty string.  Repeated rows are scanned alike.  Other columns are not read.
"""

from __future__ import annotations

import math
import random
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, written so that a failing start never rescans its run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates, all of high recall and without a greatest length; each starts where its run starts, and
#: no run fails at its end, so that runs are read once.  Groups of digits that end in a letter are no part of a run.
GENERATORS = {
    "address": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?|\.)[A-Za-z0-9-]++)++",
    "digits": r"(?<![0-9A-Za-z+])\(?(?=[0-9](?:[\x20().-]{0,2}+[0-9]){6})[0-9]++(?![A-Za-z])(?:[\x20().-]{1,2}+[0-9]++(?![A-Za-z]))*+",
    "token": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}+",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|secret|token|(?:api|access|auth)[_-]?key)[\"']?[\x20\t]{0,2}[:=][\x20\t]{0,2}[\"']?[A-Za-z0-9!@#$%^&*_+/=.~-]{6,}+",
}
FEATURES = ("kind", "length", "digits", "letters", "marks", "groups", "cue", "upper_mix", "luhn", "first_group", "changes", "vowels", "capitals")
#: Names of what is found beyond the base kinds, in the order in which they are listed.
ADDED = ("address", "digits", "token", "secret")
_CUE = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|social|passport|token|key|secret|password|passwd|pwd|auth|api)[^\n]{0,16}$"
#: What stands before the value in a match of the secret generator.
_NAME = r"^[^:=]*[:=][\x20\t]{0,2}[\"']?"
#: What every match of the address generator holds: the spelled sign, and a dot after the first name behind it.
_SPELLED = r"[\x20(\[{][aA][tT][\x20)\]}] ?[A-Za-z0-9-]++(?: ?[\x20(\[{][dD][oO][tT]|\.[A-Za-z0-9-])"
_SPAN = "array<struct<start: int, size: int, piece: string>>"


def _running(sizes: Column, width: int = 64) -> Column:
    """Sums of all elements before each, in two levels, so that many elements cost little more than few."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / width).cast("int"))
    whole = F.transform(chunks, lambda c: F.aggregate(F.slice(sizes, c * width + 1, F.lit(width)), F.lit(0), lambda a, x: a + x))
    starts = F.transform(chunks, lambda c: F.aggregate(F.slice(whole, F.lit(1), c), F.lit(0), lambda a, x: a + x))

    def inside(c: Column) -> Column:
        part = F.slice(sizes, c * width + 1, F.lit(width))
        return F.transform(part, lambda x, i: F.element_at(starts, c + 1) + F.aggregate(F.slice(part, F.lit(1), i), F.lit(0), lambda a, y: a + y))

    return F.flatten(F.transform(chunks, inside))


def _matches(rows: DataFrame, into: str, pattern: str, gate: Column) -> DataFrame:
    """rows with array column ``into``: (start, size, piece) of all matches of the pattern in norm_, where the gate holds."""
    found, rest, sizes = f"{into}_m", f"{into}_p", f"{into}_s"
    rows = rows.withColumn(found, F.when(gate, F.regexp_extract_all("norm_", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")))
    some = F.size(found) > 0
    rows = rows.withColumn(rest, F.when(some, F.split("norm_", pattern, -1)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(sizes, F.zip_with(F.slice(rest, F.lit(1), F.size(found)), F.col(found), lambda p, m: F.length(p) + F.length(m)))
    ends = F.when(some, _running(F.col(sizes))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(f"{into}_e", ends)
    # what stood before the match, its own size taken off the running sum that includes it
    spans = F.zip_with(
        F.arrays_zip(F.col(f"{into}_e").alias("before"), F.slice(rest, F.lit(1), F.size(found)).alias("gap")),
        F.col(found),
        lambda a, m: F.struct((a["before"] + F.length(a["gap"])).alias("start"), F.length(m).alias("size"), m.alias("piece")),
    )
    return rows.withColumn(into, F.when(some, spans).otherwise(F.array().cast(_SPAN))).drop(found, rest, sizes, f"{into}_e")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, piece: Column) -> Column:
    n = F.length(_digits(piece))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(_digits(piece))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(piece, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    return F.lit(True)


def _features(kind: Column, piece: Column, before: Column) -> list[Column]:
    """The FEATURES of a candidate, all as doubles; of an assignment, those of its value."""
    piece = F.when(kind == "secret", F.regexp_replace(piece, _NAME, "")).otherwise(piece)
    digits = _digits(piece)
    letters = F.length(F.regexp_replace(piece, "[^A-Za-z]", ""))
    groups = F.size(F.split(piece, "[^0-9A-Za-z]+", -1))
    values = (
        F.when(kind == "address", 0).when(kind == "digits", 1).when(kind == "token", 2).otherwise(3),
        F.length(piece),
        F.length(digits),
        letters,
        F.length(piece) - F.length(digits) - letters,
        groups,
        F.when((kind == "secret") | before.rlike(_CUE), 1).otherwise(0),
        F.when(piece.rlike("[a-z]") & piece.rlike("[A-Z]"), 2).when(piece.rlike("^[0-9a-f]+$"), 1).otherwise(0),
        F.when(F.length(digits).between(13, 19) & luhn(digits), 1).otherwise(0),
        F.length(F.regexp_extract(piece, "^[^0-9A-Za-z]*([0-9A-Za-z]+)", 1)),
        F.size(F.split(piece, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", -1)) - 1,
        F.length(F.regexp_replace(piece, "[^AEIOUaeiou]", "")) / F.greatest(letters, F.lit(1)),
        F.length(F.regexp_replace(piece, "[^A-Z]", "")) / F.greatest(letters, F.lit(1)),
    )
    return [v.cast("double") for v in values]


def examples(seed: int = 3, n: int = 60) -> list[tuple[str, str, str, int]]:
    """(kind, piece, text before, label): made candidates of known kind, drawn from a fixed seed."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "ter", "lo", "min", "ka", "re", "sto", "vi"]) for _ in range(r.randint(1, 4)))
    plain = lambda: f"{word()} {word()} {word()} "
    cue = lambda: r.choice(["call me on ", "phone: ", "tel. ", "fax ", "contact "])
    secret = lambda: r.choice(['token = "', "api_key=", "secret: ", 'password = "', "auth "])
    coded = lambda k, a: "".join(r.choice(a) for _ in range(k))
    out = []
    for _ in range(n):
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] ")])
        out += [
            ("address", f"{word()}{at}{word()}{dot}com", r.choice([plain(), "mail "]), 1),
            ("address", f"{word()} at {word()}.{word()}", plain(), 0),
            ("digits", f"({digit(3)}) {digit(3)}-{digit(4)}", r.choice([plain(), cue()]), 1),
            ("digits", f"{digit(3)}-{digit(3)}-{digit(4)}", r.choice([plain(), cue()]), 1),
            ("digits", f"{digit(3)}-{digit(2)}-{digit(4)}", r.choice(["ssn ", "social security ", plain()]), 1),
            ("digits", digit(10), cue(), 1),
            ("digits", digit(r.randint(7, 14)), plain(), 0),
            ("digits", digit(r.randint(15, 20)), plain(), 0),
            ("digits", " ".join([digit(4) for _ in range(4)]), plain(), 0),
            ("digits", " ".join(digit(r.randint(1, 2)) for _ in range(r.randint(7, 16))), plain(), 0),
            ("digits", "-".join(digit(r.randint(1, 5)) for _ in range(r.randint(3, 7))) + digit(3), plain(), 0),
            ("digits", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", plain(), 0),
            ("digits", f"{digit(1)}.{digit(2)}.{digit(2)}.{digit(3)}", plain(), 0),
            ("digits", f"{r.randint(1900, 2030)} {r.randint(1900, 2030)}", plain(), 0),
            ("token", coded(r.choice([32, 40, 64]), "0123456789abcdef"), r.choice([secret(), plain()]), 1),
            ("token", coded(r.randint(20, 60), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), secret(), 1),
            ("token", word() * 6, plain(), 0),
            ("token", "-" * r.randint(20, 60), plain(), 0),
            ("token", f"{word()}-{word()}-{word()}-{word()}-{word()}-{word()}{word()}", plain(), 0),
        ]
    return [(k, p, b, y) for k, p, b, y in [*out, *_long_examples(n), *_code_examples(n)] if k != "token" or len(p) >= 16]


def _code_examples(n: int, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Made codes without a cue beside names and paths that look like them, and values assigned to names of secrets."""
    r = random.Random(seed)
    coded = lambda k, a: "".join(r.choice(a) for _ in range(k))
    word = lambda: "".join(r.choice(["an", "ter", "lo", "min", "ka", "re", "sto", "vi", "sch", "ung"]) for _ in range(r.randint(2, 4)))
    plain = lambda: f"{word()} {word()} {word()} "
    name = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "access_key"]) + r.choice(["=", ": ", " = ", '="'])
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for _ in range(n):
        hexes = coded(r.randint(16, 31), "0123456789abcdef")
        out += [
            ("token", coded(r.randint(16, 24), upper), plain(), 1),
            ("token", coded(r.randint(3, 5), upper[:26]) + coded(r.randint(14, 36), upper), plain(), 1),
            ("token", coded(r.randint(24, 60), upper + lower), plain(), 1),
            ("token", hexes, name(), 1),
            ("token", coded(r.randint(16, 40), lower), name(), 1),
            ("token", "_".join(word() for _ in range(r.randint(3, 6))).upper(), plain(), 0),
            ("token", "".join(word() for _ in range(4)).upper(), plain(), 0),
            ("token", "".join(word() for _ in range(r.randint(3, 6))).capitalize(), plain(), 0),
            ("token", "".join(word().capitalize() for _ in range(r.randint(3, 6))), plain(), 0),
            ("token", f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}-{word()}", plain(), 0),
            ("token", f"{word()}/{word()}{r.randint(1, 9)}/{word()}-{word()}/{word()}", plain(), 0),
            ("token", coded(r.randint(16, 40), "0123456789"), plain(), 0),
            ("token", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{coded(6, '0123456789')}Z", plain(), 0),
            ("secret", name() + coded(r.randint(8, 30), upper + lower), plain(), 1),
            ("secret", name() + coded(r.randint(8, 30), lower + "!@#$%"), plain(), 1),
            ("secret", name() + hexes, plain(), 1),
            ("secret", name() + word() + r.choice(["", "_", "!"]) + coded(r.randint(2, 4), "0123456789"), plain(), 1),
            ("secret", name() + word() + word(), plain(), 0),
            ("secret", name() + r.choice(["required", "optional", "string", "missing", "expired", "invalid", "disabled", "******", "........", "$PASSWORD", "the.name"]), plain(), 0),
            ("secret", name() + word().capitalize() + r.choice([".", ".get", "_name"]) + word(), plain(), 0),
        ]
    return out


def document_examples(docs: DataFrame, max_examples: int = 2000, max_documents: int = 10_000) -> DataFrame:
    """(kind, piece, before, label): base spans and long plain words of the documents, each in a form of known label.

    An email is spelled out and a phone loses its country's number: both are still
    personal.  A card fails the Luhn check by its last digit and an address of a host has
    a part above 255: neither is.  A run of letters is a word; a digest and its capitals
    after a name of a secret, in the place of a base span, are secrets.
    """
    share = max(docs.count() // max_documents, 1)
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select(F.coalesce("text", F.lit("")).alias("norm_"))
    rows = rows.where(F.col("norm_").rlike(r"@|[0-9.+]{7}|[0-9]{4}|\+[0-9]|[A-Za-z]{16}"))
    for kind, pattern in {**BASE, "word": r"(?<![A-Za-z0-9_/+-])[A-Za-z]{16,}+(?![A-Za-z0-9_/+=-])"}.items():
        rows = _matches(rows, kind, pattern, F.lit(True))
    placed = F.concat(*(F.transform(F.filter(k, _sampled(k)), _placed(k)) for k in [*BASE, "word"]))
    some = rows.select(F.explode(placed).alias("s")).select("s.*").distinct()
    some = some.withColumn("h", F.xxhash64("form", "piece", "before")).orderBy("h", "form", "piece", "before").limit(max_examples)
    piece, before, style = F.col("piece"), F.col("before"), F.pmod("h", F.lit(4)).cast("int") + 1
    at = F.element_at(F.array(*map(F.lit, ["(at)", "[at]", " at ", " [at] "])), style)
    dot = F.element_at(F.array(*map(F.lit, ["(dot)", "[dot]", " dot ", " [dot] "])), style)
    spelled = F.concat(F.substring_index(piece, "@", 1), at, F.replace(F.substring_index(piece, "@", -1), F.lit("."), dot))
    local = F.regexp_replace(piece, r"^\+[0-9]{1,3}[\x20.-]+", "")
    failing = F.concat(F.expr("left(piece, length(piece) - 1)"), ((F.expr("right(piece, 1)").cast("int") + 1) % 10).cast("string"))
    digest = F.sha2(piece.cast("binary"), 256)
    capitals = F.upper(F.translate(F.substring(digest, 1, 20), "0123", "KRTZ"))
    named = lambda name: F.concat(F.expr("right(before, 24)"), F.lit(name))
    example = lambda when, kind, value, context, label: F.when(when, F.struct(F.lit(kind).alias("kind"), value.alias("piece"), context.alias("before"), F.lit(label).alias("label")))
    made = F.array(
        example(F.col("form") == "email", "address", spelled, before, 1),
        example((F.col("form") == "phone") & local.rlike(r"^\(?[0-9]{2,4}[)\x20.-]+[0-9]") & (F.length(_digits(local)) >= 7), "digits", local, before, 1),
        example(F.col("form") == "card", "digits", failing, before, 0),
        example(F.col("form") == "ip", "digits", F.regexp_replace(piece, "^[0-9]+", "999"), before, 0),
        example(F.col("form") == "word", "token", piece, before, 0),
        example(F.col("form") == "ip", "token", F.substring(digest, 1, 32), named("token="), 1),
        example(F.col("form") == "card", "token", capitals, before, 1),
        example(F.col("form") == "email", "secret", F.concat(F.lit("password="), F.substring(digest, 1, 12)), before, 1),
    )
    every = some.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*")
    # only what the kind's generator would propose whole
    proposed = F.lit(False)
    for kind, pattern in GENERATORS.items():
        proposed = proposed | ((F.col("kind") == kind) & F.col("piece").rlike(rf"\A(?:{pattern})\z"))
    return every.where(proposed)


def _sampled(kind: str):
    return lambda s: (s["size"] <= 400) & (_holds(kind, s["piece"]) if kind in BASE else F.lit(True))


def _placed(kind: str):
    def placed(s: Column) -> Column:
        start = F.greatest(s["start"] - 40, F.lit(0))
        return F.struct(F.lit(kind).alias("form"), s["piece"].alias("piece"), F.substring(F.col("norm_"), start + 1, s["start"] - start).alias("before"))

    return placed


def _long_examples(n: int, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """More made candidates, all far longer than those of ``examples``."""
    r = random.Random(seed)
    coded = lambda k, a: "".join(r.choice(a) for _ in range(k))
    word = lambda: r.choice(["an", "ter", "lo", "min", "ka", "re", "sto", "vi"]) + r.choice(["da", "lin", "mo", "sa"])
    plain = lambda: f"{word()} {word()} {word()} "
    secret = lambda: r.choice(['token = "', "api_key=", "secret: ", 'password = "', "auth "])
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for _ in range(n):
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] ")])
        out += [
            ("token", coded(r.randint(201, 2000), alnum), secret(), 1),
            ("token", coded(r.randint(201, 2000), alnum + "_-"), secret(), 1),
            ("token", coded(r.randint(201, 2000), alnum + "+/") + r.choice(["", "=", "=="]), secret(), 1),
            ("token", coded(r.randint(201, 1000), "0123456789abcdef"), r.choice([secret(), plain()]), 1),
            ("token", r.choice("-=_") * r.randint(201, 2000), plain(), 0),
            ("token", "".join(word() for _ in range(r.randint(50, 300))), plain(), 0),
            ("token", r.choice("-_/").join(word() for _ in range(r.randint(40, 200))), plain(), 0),
            ("address", f"{''.join(word() for _ in range(r.randint(1, 20)))}{at}{dot.join(word() for _ in range(r.randint(6, 12)))}{dot}com", r.choice([plain(), "mail "]), 1),
            ("digits", coded(r.randint(24, 400), "0123456789"), plain(), 0),
            ("digits", " ".join(coded(r.randint(1, 5), "0123456789") for _ in range(r.randint(12, 100))), plain(), 0),
        ]
    return out


def _tree(node) -> tuple | float:
    """A learned tree as (feature, threshold, left, right) down to the leaves' values."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else "double('infinity')"


def _value(node: tuple | float, v: str) -> str:
    if not isinstance(node, tuple):
        return _number(node)
    i, threshold, left, right = node
    return f"CASE WHEN {v}[{i}] <= {_number(threshold)} THEN {_value(left, v)} ELSE {_value(right, v)} END"


def margin(trees: list[tuple[float, tuple | float]], v: str) -> str:
    """The boosted margin of the feature array named v, as a SQL expression."""
    return " + ".join(f"{_number(weight)} * {_value(tree, v)}" for weight, tree in trees)


def learn(spark: SparkSession, docs: DataFrame | None = None, rounds: int = 12, depth: int = 4, precision: float = 0.98, max_examples: int = 2000) -> tuple[list, dict[str, float]]:
    """(weighted trees, threshold by kind).

    Trees learn from three quarters of the examples, made and of the documents; on the
    rest each kind's threshold is the least margin from which on at least the asked
    precision holds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    table = _examples(spark, docs, max_examples)
    seen = table.where(~_held()).select(F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=1, stepSize=0.3).fit(seen)
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    held = table.where(_held()).select("kind", "label", F.expr(margin(trees, "f")).alias("m")).collect()
    least = {}
    for kind in ADDED:
        own = sorted(((r["m"], r["label"]) for r in held if r["kind"] == kind), reverse=True)
        good, best = 0, float("inf")
        for n, (m, y) in enumerate(own, 1):
            good += y
            if good >= precision * n and (n == len(own) or own[n][0] < m):
                best = m
        least[kind] = max(best, 0.0)
    return trees, least


def _examples(spark: SparkSession, docs: DataFrame | None, max_examples: int) -> DataFrame:
    """All examples with features f, in one order; those of the documents are few and short (``document_examples``)."""
    rows = examples()
    if docs is not None:
        rows += sorted(map(tuple, document_examples(docs, max_examples).collect()))
    table = spark.createDataFrame([(*e, i) for i, e in enumerate(rows)], "kind string, piece string, before string, label int, i int").coalesce(1)
    return table.withColumn("f", F.array(*_features(F.col("kind"), F.col("piece"), F.col("before"))))


def _held() -> Column:
    return F.col("i") % 61 % 4 == 0


def _gates() -> dict[str, Column]:
    """What a text holds wherever the kind's pattern matches, read faster than the pattern itself."""
    return {
        "email": F.col("norm_").contains("@"), "ip": F.col("digit_") & F.col("norm_").contains("."), "card": F.col("digit_"), "phone": F.col("digit_") & F.col("norm_").contains("+"),
        "address": F.col("norm_").rlike(_SPELLED), "digits": F.col("digit_") & F.col("norm_").rlike(r"[0-9](?:[\x20().-]{0,2}+[0-9]){6}"), "token": F.col("norm_").rlike("[A-Za-z0-9_/+-]{16}"),
        "secret": reduce(or_, (F.lower("norm_").contains(w) for w in ("pass", "pwd", "secret", "token", "key"))) & F.col("norm_").rlike(r"(?i)(?:pass|pwd|secret|token|key)[a-z]{0,6}[\"']?[\x20\t]{0,2}[:=]"),
    }


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, address, digits, token): arrays of (start, size, piece) by kind."""
    trees, least = learn(docs.sparkSession, docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("norm_"))
    rows = rows.withColumn("digit_", F.col("norm_").rlike("[0-9]"))
    gates = _gates()
    for kind, pattern in BASE.items():
        rows = _matches(rows, kind, pattern, gates[kind])
        if kind != "email":
            rows = rows.withColumn(kind, F.filter(kind, _check(kind)))
    for kind, pattern in GENERATORS.items():
        rows = _matches(rows, kind, pattern, gates[kind])
        rows = rows.withColumn(f"{kind}_f", F.transform(kind, _featured(kind))).withColumn(f"{kind}_a", F.expr(_accepted(kind, trees, least[kind])))
    for kind in ADDED:
        rows = rows.withColumn(kind, F.transform(F.filter(f"{kind}_a", _apart(kind)), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), s["piece"].alias("piece"))))
    return rows.select("doc_id", *BASE, *ADDED)


def _check(kind: str):
    return lambda s: _holds(kind, s["piece"])


def _featured(kind: str):
    def featured(s: Column) -> Column:
        start = F.greatest(s["start"] - 40, F.lit(0))
        before = F.substring(F.col("norm_"), start + 1, s["start"] - start)
        return F.struct(s["start"].alias("start"), s["size"].alias("size"), s["piece"].alias("piece"), F.array(*_features(F.lit(kind), s["piece"], before)).alias("f"))

    return featured


def _accepted(kind: str, trees: list, least: float) -> str:
    """SQL of the candidates whose margin reaches the kind's threshold, with what it is above it."""
    above = f"{margin(trees, 's.f')} - {_number(least)}"
    if kind == "digits":
        above = f"CASE WHEN s.f[{FEATURES.index('digits')}] < 7 THEN -1D ELSE {above} END"
    scored = f"transform({kind}_f, s -> named_struct('start', s.start, 'size', s.size, 'piece', s.piece, 'above', {above}))"
    return f"filter({scored}, s -> s.above >= 0)"


def _apart(kind: str):
    """Whether a candidate meets no base span and no better candidate of another kind; equals fall to the kind listed first."""

    def apart(s: Column) -> Column:
        end = s["start"] + s["size"]
        clear = F.lit(True)
        for k in BASE:
            next_ = F.get(F.col(k), _first(k, lambda o: o["start"] + o["size"] > s["start"]))
            clear = clear & ~F.coalesce(next_["start"] < end, F.lit(False))
        for k in ADDED:
            if k != kind:
                low = _first(f"{k}_a", lambda o: o["start"] + o["size"] > s["start"])
                high = _first(f"{k}_a", lambda o: o["start"] >= end)
                clear = clear & ~F.exists(F.slice(f"{k}_a", low + 1, high - low), _better(s, ADDED.index(k) < ADDED.index(kind)))
        return clear

    return apart


def _better(s: Column, first: bool):
    return lambda o: (o["above"] >= s["above"]) if first else (o["above"] > s["above"])


def _first(spans: str, holds) -> Column:
    """How many spans stand before the first for which ``holds``, by halving: the spans are sorted and holds stays true."""
    n = F.size(spans)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["low"] + a["high"], 1)
        true, false = F.struct(a["low"].alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), a["high"].alias("high"))
        return F.when(a["low"] >= a["high"], a).when(holds(F.get(F.col(spans), middle)), true).otherwise(false)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve)["low"]


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start."""
    return F.array_join(F.concat(*(F.transform(k, _named(k)) for k in kinds)), ",")


def _named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), (s["start"] + s["size"]).cast("string"))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, piece): one row per span."""
    rows = F.concat(*(F.transform(k, _row(k)) for k in [*BASE, *ADDED]))
    return spans(docs).select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.kind", "s.start", "s.end", "s.piece")


def _row(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + s["size"]).alias("end"), s["piece"].alias("piece"))


def op4_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of the base spans, all spans, and their number."""
    found = spans(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    n_all = sum((F.size(k) for k in [*BASE, *ADDED]), F.lit(0))
    return found.select("doc_id", *counts, F.sha2(_listed(list(BASE)).cast("binary"), 256).alias("base_sha256"), _listed([*BASE, *ADDED]).alias("spans"), n_all.cast("long").alias("n_spans"))
