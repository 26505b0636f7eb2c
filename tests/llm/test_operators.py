import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import chat, decontaminate, exact, graph, language, licenses, mixing, pii, quality, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, fp string, norm string, digest string, anchor int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, "x", "y", "z", 1) for i, t, lang, src in rows], DOCS)


WORDS = {"en": "the house of words and that with this from thing".split(), "de": "der die und nicht schön über haus wörter sich auch".split(), "fr": "le la élève être où maison mots avec pour dans".split()}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))) + ".", lang, r.choice(["a", "b", "c", None])))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "12 34 !!", "de", None), (1003, rows[0][1].upper(), "en", "a"), (1004, rows[0][1], "en", "b"), (1005, "😀 é", None, "b")]
    return rows


def test_hashes_stand_alone():
    code, _ = tokens.codes(["hello world hello", "hello"])
    for n in range(1, 10):
        at = np.arange(len(code) - n + 1)
        assert (tokens.gram_hashes(code, n) == tokens.span_hashes(code, at, at + n)).all()


def test_language(spark):
    rows = corpus(2, 200) + [(2000, " ".join(WORDS["en"] * 8 + WORDS["de"] * 6), None, "a")]
    got = {r.doc_id: r for r in language.op7_language(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _ in rows[:200]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == lang
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002))
    assert got[2000].languages == "en+de"
    kept = language.keep_identified(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows) - 3
    assert language.op7_language(docs(spark, rows).limit(0)).count() == 0
    odd = docs(spark, [*corpus(2, 20), (2001, "\u2113 \u2124", None, "a")])
    assert language.op7_language(odd).where("doc_id = 2001").first().lang_pred in WORDS
    nobody = docs(spark, [(1, "the house", None, "a")])
    assert language.op7_language(nobody).first().lang_pred == "und"


def test_rare_languages_are_learned(spark):
    assert language.even_share([3, 100, 5000], 300) == 197 and language.even_share([10, 20], 300) == 20.0 and language.even_share([50, 50], 10) == 5
    r = random.Random(8)
    say = lambda lang: " ".join(r.choice(WORDS[lang]) for _ in range(30))
    rows = [(i, say("en" if i % 2 else "de"), "en" if i % 2 else "de", "a") for i in range(3000)] + [(3000 + i, say("fr"), "fr", "a") for i in range(3)]
    model = language.train(docs(spark, rows), max_rows=300)
    assert model.languages == ("de", "en", "fr")
    probe = docs(spark, [(1, say("fr"), None, "a"), (2, say("en"), None, "a")])
    assert {x.doc_id: x.r.lang_pred for x in probe.select("doc_id", language.identify("text", model).alias("r")).collect()} == {1: "fr", 2: "en"}
    with pytest.raises(ValueError, match="languages"):
        language.train(docs(spark, rows), most=2)


def brute_groups(prints, bits=3):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("chunk", [2, 4096])
def test_simhash_links(spark, chunk):
    r = random.Random(3)
    prints = {}
    for i in range(60):
        base = r.getrandbits(64)
        for j in range(5):
            prints[i * 5 + j] = base ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4)))
    prints[900] = prints[901] = 0
    table = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(table, chunk=chunk).collect()}
    assert got == brute_groups(prints)


def test_fingerprints(spark):
    import xxhash

    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"

    rows = corpus(4) + [(3000, "One", "en", "a"), (3001, "a b\x1fc d É e", "en", "a"), (3002, "w " * 70000, "en", "a")]
    got = {r.doc_id: r.fingerprint for r in simhash.op8_simhash(docs(spark, rows)).collect()}
    assert got == {i: slow(t) for i, t, _, _ in rows}
    kept = simhash.keep_one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert simhash.op8_simhash(docs(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r.root for r in graph.components(links).collect()} == {0}


@pytest.mark.parametrize("bits", [256, 4])
def test_exact(spark, bits):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = corpus(5) + [(4000, "ÉA", "fr", "a"), (4001, "éa", "fr", "a"), (4002, "Éa", "fr", "a")]
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(low(t), []).append(i)
    got = {r.doc_id: r for r in exact.duplicates(docs(spark, rows), "max", bits).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        own = groups[low(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
    if bits == 256:
        assert got[4000].text_sha256 == hashlib.sha256("Éa".encode()).hexdigest()
        assert exact.keep_last_copy(docs(spark, rows)).count() == len(groups)
        assert exact.op9_exact(docs(spark, rows).limit(0)).count() == 0


def test_batches_merge_into_an_index(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 37}", "en", "a") for i in range(200)] + [(i, "", "en", "a") for i in range(200, 260)] + [(None, "text 1", "en", "a")]
    df = docs(spark, rows).repartition(3)
    index = None
    for k, part in enumerate((df.where("doc_id < 50"), df.where("doc_id >= 50 and doc_id < 220"), df.where("doc_id >= 220 or doc_id is null"))):
        batch = exact.compact(exact.flush(part, str(tmp_path / f"r{k}")))
        index = exact.written(batch if index is None else exact.merge(index, batch), str(tmp_path / f"i{k}"))
    whole = exact.compact(exact.flush(df, str(tmp_path / "all")))
    assert sorted(index.collect()) == sorted(whole.collect()) and index.count() == 38
    some = [r.digest for r in whole.limit(2).collect()]
    assert exact.lookup(index, some).count() == 2 and "PushedFilters: [In(digest" in exact.lookup(index, some)._jdf.queryExecution().toString()
    want = sorted(map(str, exact.duplicates(df, "max").collect()))
    monkeypatch.setattr(exact, "_HOT", 20)
    assert sorted(map(str, exact.duplicates(df, "max").collect())) == want


def test_stages_keep_one_row_of_each_group(spark):
    say = lambda seed: " ".join(random.Random(seed).choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]) for _ in range(80))
    a, b, c, d = (say(i) for i in range(4))
    rows = [(1, a), (1, a), (2, a), (2, a), (2, b), (None, a), (None, c), (None, c), (None, d), (None, d.upper()), (3, b), (4, None), (4, "")]
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    for stage, want in ((exact.keep_last_copy, [(2, a), (None, c), (None, d), (3, b), (4, "")]), (simhash.keep_one_of_each, [(1, a), (2, b), (None, c), (None, d), (4, "")])):
        out = stage(df)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, (r.text or "").lower()) for r in out.collect()), key=str) == sorted(want, key=str)


def test_lower_case_is_ascii_only(spark):
    text = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000], "doc_id long, text string")
    bad = text.where(exact.normalised("text") != F.translate("text", exact._UPPER, exact._UPPER.lower()))
    assert bad.count() == 0


def test_mixing(spark):
    rows = corpus(6, 120)
    df = docs(spark, rows)
    got = {r.doc_id: r for r in mixing.op3_mixing(df).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    of = {i: s for i, _, _, s in rows}
    sources = sorted({s for s in of.values() if s}) + [None]
    total = {s: sum(size[i] for i in size if of[i] == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(total.values())), list(sources)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    for i in size:
        assert got[i].size == size[i] and got[i].source_size == total[of[i]] and math.isclose(got[i].target, target[of[i]])
        assert got[i].taken <= 3 * size[i]
    for s in sources:
        assert abs(sum(got[i].taken for i in size if of[i] == s) - target[s]) <= 64 + 64
    again = {r.doc_id: r.taken for r in mixing.op3_mixing(df.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.op3_mixing(df.limit(0)).count() == 0


def test_mixing_of_a_small_source(spark):
    rows = [(1, "w " * 40, "en", "a"), (2, "w " * 60, "en", "a"), (3, "w " * 9000, "en", "b"), (4, None, "en", "a")]
    got = {r.doc_id: r for r in mixing.op3_mixing(docs(spark, rows)).collect()}
    assert (got[1].target, got[1].taken, got[2].taken, got[4].taken) == (300.0, 120, 180, 0)
    assert abs(got[3].taken - 8800) <= 64


def test_blocks_of_a_mix_are_not_sent_to_all(spark):
    """Slots come from one row per source, but are as many as the corpus has blocks: their join is a shuffle at any size."""
    df = mixing.op3_mixing(docs(spark, corpus(6, 120)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [x for x in plan.splitlines() if "Join [" in x and "index#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_every_shard_is_a_fair_draw(spark):
    """Counts of all shards, the last one too, against the multinomial's expectation; totals are the quotas."""
    sources = spark.createDataFrame([("a", 64 * 3000, 10), ("b", 64 * 9000, 10), (None, 64 * 8000, 10)], "source string, source_size long, rows long")
    plan = mixing.quotas(sources)
    quota = {r.source: r.quota for r in plan.collect()}
    drawn = mixing.slots(plan, 1000).persist()
    counts = {(r.shard, r.source): r.n for r in mixing.shard_counts(drawn).collect()}
    shards = {s for s, _ in counts}
    assert len(shards) == 20 and all(sum(n for (s, x), n in counts.items() if x == q) == quota[q] for q in quota)
    chi = 0.0
    for shard in shards:
        size = sum(counts.get((shard, q), 0) for q in quota)
        for q in quota:
            want = size * quota[q] / sum(quota.values())
            chi += (counts.get((shard, q), 0) - want) ** 2 / want
            assert abs(counts.get((shard, q), 0) - want) < 5 * math.sqrt(want)
    assert chi < 2 * 20 * 2
    # rounds of a source take its blocks evenly
    times = Counter((r.source, r["index"]) for r in drawn.collect())
    for q in quota:
        own = [n for (x, _), n in times.items() if x == q]
        assert max(own) <= 3 and max(own) - min(own) <= 1 or len(own) < 9000


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select(F.lit(n).cast("long").alias("n"), F.lit(99).cast("long").alias("key"), "id")
        out = rows.select(mixing.permuted(F.col("id"), F.col("n"), F.col("key"), mixing.mirrors(F.col("n"), F.col("key"))).alias("x"))
        assert sorted(r.x for r in out.collect()) == list(range(n))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum((int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9)) for k, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if holds(k, m.group())]


def test_pii(spark):
    r = random.Random(7)
    alphabet = "aZ0129.@+-( )%_é😀, ٣"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120))), "en", "a") for i in range(300)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "call 4111 1111 1111 1111 or +1 (202) 555-0101, a.b@c.org, 10.0.0.1", "en", "a"), (1003, "1.2.3.4 " * 300, "en", "a")]
    rows += [(1004, 'the token = "3f786850e387550fdab836ed7e6dc881de23001b" here', "en", "a"), (1005, "jane (at) example (dot) org", "en", "a"), (1006, "plain words only, in 2024", "en", "a"), (1007, "a." * 5000 + "@", "en", "a")]
    got = {x.doc_id: x for x in pii.op4_pii(docs(spark, rows)).collect()}
    for i, t, _, _ in rows:
        want = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        n = Counter(k for k, _, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in PATTERNS)
        assert got[i].spans.startswith(text)
    assert got[1004].spans == "token:13:53" and got[1005].spans.startswith("address:0:") and got[1006].spans == ""


def test_pii_candidates_are_settled_by_score(spark):
    """The added spans against plain Python over the same margins: base spans stay, and of candidates that meet the better one."""
    r = random.Random(51)
    bits = ["call 555-123-4567 ", "jane (at) example (dot) org ", 'key = "' + "a1B2" * 8 + '" ', "2024-01-02 ", "a.b@c.org ", "1234567890123456789012 ", "555-123-4567(at)x.y ", "abcdef0123456789abcdef01 at x.y ", "10.0.0.1 "]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 9))), "en", "a") for i in range(60)]
    df = docs(spark, rows)
    trees, least = pii.learn(spark, df)
    got = {x.doc_id: x for x in pii.op4_pii(df).collect()}
    cases = []
    for i, t, *_ in rows:
        for kind, pattern in pii.GENERATORS.items():
            cases += [(i, kind, m.start(), m.end(), m.group(), t[max(0, m.start() - 40) : m.start()]) for m in re.finditer(pattern, t)]
    f = F.array(*pii._features(F.col("kind"), F.col("piece"), F.col("before")))
    table = spark.createDataFrame(cases, "i long, kind string, a long, b long, piece string, before string")
    judged = [(*x[:5], x.m - least[x.kind]) for x in table.withColumn("f", f).withColumn("m", F.expr(pii.margin(trees, "f"))).select("i", "kind", "a", "b", "piece", "m").collect()]
    for i, t, *_ in rows:
        base = base_spans(t)
        own = [c for c in judged if c[0] == i and c[5] >= 0 and (c[1] != "digits" or sum(x.isdigit() for x in c[4]) >= 7)]
        meets = lambda x, y: x[0] < y[1] and y[0] < x[1]
        rank = pii.ADDED.index
        kept = [c for c in own if not any(meets(c[2:4], b[1:]) for b in base) and not any(o[1] != c[1] and meets(c[2:4], o[2:4]) and (o[5], -rank(o[1])) > (c[5], -rank(c[1])) for o in own)]
        want = [*(f"{k}:{a}:{b}" for k, a, b in base), *(f"{k}:{a}:{b}" for _, k, a, b, *_ in sorted(kept, key=lambda c: (rank(c[1]), c[2])))]
        assert got[i].spans == ",".join(want) and got[i].n_spans == len(want), t
    assert pii.op4_pii(df.limit(0)).count() == 0


def test_pii_of_any_length(spark):
    r = random.Random(12)
    code = lambda n: "".join(r.choice("ABCDEFGHabcdefghijklmnop0123456789") for _ in range(n))
    head = 'the token = "'
    rows = [(n, f'{head}{code(n)}" here', "en", "a") for n in (40, 199, 200, 201, 350, 1500, 9000)]
    far = "".join("ab" for _ in range(40)) + " (at) " + " (dot) ".join(["mail"] * 9) + " (dot) org"
    rows += [(1, far, "en", "a"), (2, "call me on 555-123-4567 3rd floor", "en", "a"), (3, "1 2" * 60_000 + "x", "en", "a"), (4, "lo" * 80 + " at home. " + "-" * 400, "en", "a")]
    got = {x.doc_id: x.spans for x in pii.op4_pii(docs(spark, rows)).collect()}
    for n in (40, 199, 200, 201, 350, 1500, 9000):
        assert f"token:{len(head)}:{len(head) + n}" in got[n], n
    assert got[1] == f"address:0:{len(far)}" and got[2] == "digits:11:23" and "token" not in got[4] and "address" not in got[4]
    # proposed whole, whatever the trees say of it
    for text, kind in (("9" * 60, "digits"), ("1 " * 40 + "2", "digits"), (far, "address"), ("k" * 5000, "token")):
        found = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pii.GENERATORS[kind]), F.lit(0))).first()[0]
        assert found == [text]


def labelled(spark, n, make):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        y = int(r.random() < 0.3)
        rows.append((i, make(r, y), "en", "a"))
        marks.append((i, y, y))
    rows += [(n, None, "en", "a"), (n + 1, "", "en", "a")]
    return docs(spark, rows), spark.createDataFrame([*marks, (n, None, None)], "doc_id long, quality int, toxic int"), {i: y for i, y, _ in marks}


def test_toxicity(spark):
    def make(r, y):
        w = [r.choice("abcdefgh") + r.choice("ijklmnop") + r.choice("qrstuv") for _ in range(40)]
        return " ".join(w[:20] + ["vile", "scum", "vile"] * y + w[20:])

    df, marks, y = labelled(spark, 400, make)
    got = {r.doc_id: r for r in toxicity.op5_toxicity(df, marks).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in y if got[i].held_out]
    assert np.mean([got[i].predicted == y[i] for i in held]) > 0.95
    assert {r.predicted for r in toxicity.op5_toxicity(df, marks.limit(0)).collect()} == {0}
    # labels of one class alone where settings are chosen
    uneven = marks.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1) | (F.col("toxic") == 0))
    got = {r.doc_id: r for r in toxicity.op5_toxicity(df, uneven).collect()}
    assert np.mean([got[i].predicted == y[i] for i in held]) > 0.95
    known = [y[i] for i in y if zlib.crc32(str(i).encode()) % 5 > 1 or (zlib.crc32(str(i).encode()) % 5 == 1 and not y[i])]
    assert abs(got[400].score - got[401].score) < 1e-12 and abs(got[400].score - np.mean(known)) < 0.02


def test_quality(spark):
    def make(r, y):
        w = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
        return " ".join(w) if y else " ".join(x.upper() + "!!" for x in w)

    df, marks, y = labelled(spark, 300, make)
    got = {r.doc_id: r for r in quality.op10_quality(df, marks).collect()}
    held = [i for i in y if got[i].held_out]
    assert len(got) == 302 and np.mean([got[i].predicted == y[i] for i in held]) > 0.95
    assert {r.predicted for r in quality.op10_quality(df, marks.limit(0)).collect()} == {0}


def edits(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        cur = [i + 1]
        for j, d in enumerate(t):
            cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_decontamination(spark):
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(n))
    passages = [say(20) for _ in range(6)]
    rows, want = [], set()
    for i in range(60):
        p = list(r.choice(passages))
        for _ in range(r.randint(0, 16)):
            k = r.randrange(len(p))
            p[k] = r.choice(["", "x", p[k] + "y"])
        t = f"{say(12)}\n{''.join(p)}   {say(9)}"
        rows.append((i, t, "en", "a"))
        plain = " ".join(t.split())
        for k, q in enumerate(passages):
            e = edits(q, plain)
            if e <= min(int(len(q) * 0.1), (len(q) - 8) // 8):
                want.add((i, k, e))
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, passages[0].upper(), "en", "a")]
    want.add((102, 0, 0))
    bench = spark.createDataFrame([*enumerate(passages), (50, None), (51, "short"), (None, passages[0])], "item_id long, text string")
    df = docs(spark, rows)
    got = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.op6_decontaminate(df, bench).collect()}
    assert got == want
    small = decontaminate.contaminated(df, bench, "hits", block_chars=200).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.edits")
    assert {tuple(x) for x in small.collect()} == want
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, *_ in rows} - {i for i, *_ in want}
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(rows)


def test_decontamination_of_long_texts_and_short_passages(spark):
    r = random.Random(31)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(n))
    passages = [say(20) for _ in range(8)]
    text = "   ".join(x for p in passages for x in (say(60), p[:30] + "x" + p[31:], "\n" * 300, say(40)))
    index = decontaminate.build(list(enumerate(passages)), 0.1)
    assert sorted(decontaminate.search_long(text, index, 500)) == sorted(decontaminate.search([text], index)[0]) and len(decontaminate.search([text], index)[0]) == 8
    bench = spark.createDataFrame([(1, "Yes, so"), (2, "ab"), (3, " "), (4, None)], "item_id long, text string")
    df = docs(spark, [(1, "oh yes,  so it is", "en", "a"), (2, "abc ab_ x", "en", "a"), (3, "crab", "en", "a"), (4, None, "en", "a"), (5, "x (AB)", "en", "a")])
    got = {(x.doc_id, x.item_id, x.start, x.end) for x in decontaminate.op6_decontaminate(df, bench).collect()}
    assert got == {(1, 1, 3, 11), (2, 2, 4, 6), (5, 2, 3, 5)}


def test_alignment_in_a_very_wide_band():
    """Bands wider than 65,535 diagonals keep their costs apart."""
    p = np.array([1, 2, 3, 4, 5, 6, 7, 8], dtype=np.uint32)
    text = np.full(200_000, 9, dtype=np.uint32)
    text[150_000:150_008] = p
    assert decontaminate._align(p, text, 0, 160_000)[:3] == (0, 150_000, 150_008)


def test_decontamination_in_windows(monkeypatch):
    r = random.Random(12)
    passages = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(25)) for _ in range(5)]
    text = "\n".join(f"{' '.join(r.choice(['beta', 'omega']) for _ in range(30))} {p[:40]}x{p[41:]}" for p in passages * 3)
    index = decontaminate.build(list(enumerate(passages)), 0.1)
    whole = decontaminate.search([text, "", passages[2]], index)
    assert {h[0] for h in whole[0]} == set(range(5))
    for most in (1, 50, 700):
        monkeypatch.setattr(decontaminate, "_POSTINGS", most)
        assert decontaminate.search([text, "", passages[2]], index) == whole


def test_licenses(spark):
    gap = " filler words" * 30
    rows = [(1, f"x{gap}.\nReleased under the MIT License.\n{gap}", "en", "a"), (2, "Licensed under CC BY-NC 4.0.", "en", "a"), (3, "a license to chill", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a")]
    rows.append((6, licenses.TEMPLATES["MIT"].replace("free of charge", "for no charge"), "en", "a"))
    rows.append((7, "This work is licensed under the GNU General Public License, version 3. " * 2, "en", "a"))
    got = {}
    for x in licenses.op1_licenses(docs(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert [x.license for x in got[1]] == ["MIT-notice"] and rows[0][1][got[1][0].start : got[1][0].end] == "Released under the MIT License"
    assert [x.license for x in got[2]] == ["CC-BY-NC-4.0"] and got[2][0].differences == ""
    assert 3 not in got and 4 not in got and 5 not in got
    assert got[6][0].license == "MIT" and "-free of+for no" in got[6][0].differences
    assert len(got[7]) == 2


def test_several_licenses_in_one_header(spark):
    w = licenses.TEMPLATES
    headers = {1: ["GPL-3.0-notice", "CC-BY-NC-4.0", "Unlicense"], 2: ["proprietary", "Apache-2.0"], 3: ["MIT", "ISC", "BSD", "CC0"], 4: list(w), 5: ["MIT-notice", "MIT-notice", "GPL-2.0-notice", "GPL-3.0-notice"]}
    rows = [(i, "\n".join(w[n] for n in names), "en", "a") for i, names in headers.items()]
    # wrapped lines without a cue of their own, and a mark of comments that is never closed
    rows += [(6, "Copyright 2024 A. Nobody. " + w["proprietary"] + "\n# if a < b:\n# " + w["MIT"].replace(" software", "\n# software").replace(" sell", "\n# sell") + "\n# if b > a", "en", "a")]
    headers[6] = ["proprietary", "MIT"]
    got = {i: [] for i in headers}
    for x in licenses.op1_licenses(docs(spark, rows)).orderBy("doc_id", "start").collect():
        got[x.doc_id].append(x.license)
    assert got == headers


def test_licenses_that_are_not_named(spark):
    said = [
        "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is not licensed under the GNU General Public License, version 3.",
        "It is not Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-ND 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    ]
    got = {x.doc_id: x.license for x in licenses.op1_licenses(docs(spark, [(i, t, "en", "a") for i, t in enumerate(said)])).collect()}
    assert got == {6: "GPL-3.0-notice"}
    assert licenses.op1_licenses(docs(spark, []).limit(0)).count() == 0


def test_templates_of_any_kind(spark):
    r = random.Random(41)
    plain = "This software is provided as-is; altered source versions must be plainly marked as such"
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(600))
    table = spark.createDataFrame([("plain", plain), ("long", long), (None, "x")], "license string, wording string")
    templates = licenses.templates_of(table)
    rows = [(1, f"a {plain}. b", "en", "a"), (2, f"some words {long} more", "en", "a"), (3, long[: len(long) // 2], "en", "a"), (4, None, "en", "a")]
    found = licenses.scan(docs(spark, rows), "f", templates).select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*").collect()
    assert {(x.doc_id, x.license, x.coverage) for x in found} == {(1, "plain", 1.0), (2, "long", 1.0)}
    at = {x.doc_id: x for x in found}
    assert rows[0][1][at[1].start : at[1].end] == plain and rows[1][1][at[2].start : at[2].end] == long
    # the gate lets through whatever wording would confirm
    w = plain.split()
    for _ in range(60):
        kept = [x for x in w if r.random() > 0.12]
        t = "intro " + " ".join(kept) + " outro"
        if len(kept) >= 0.85 * len(w) and licenses.Scanner(templates, 0.85).scan(t):
            assert re.search(licenses.gate(templates, 0.85).replace(r"\p{L}\p{N}", r"a-z0-9").replace("(?iu)", "(?i)"), t)


def damaged(r, wording, share):
    """A wording of which some words are lost, changed or put in."""
    out = []
    for w in re.sub("<[^>]*>", lambda _: r.choice(["1.", "x", ""]), wording).split():
        if r.random() < share:
            out += r.choice([[], [w + "x"], [w, "also"]])
        else:
            out.append(w)
    return " ".join(out)


def test_ranks_lose_no_license():
    """Whatever a template alone is confirmed in is found, or taken by a better one, in texts of many damaged wordings."""
    r = random.Random(42)
    names = sorted(licenses.TEMPLATES)
    joint, alone = licenses.Scanner(licenses.TEMPLATES, 0.85), {n: licenses.Scanner({n: licenses.TEMPLATES[n]}, 0.85) for n in names}
    found = 0
    for _ in range(60):
        parts = [damaged(r, licenses.TEMPLATES[r.choice(names)], r.choice([0, 0.03, 0.15])) for _ in range(r.randint(1, 30))]
        t = r.choice([" ", "\n", " some filler words here and there "]).join(parts)
        got = joint.scan(t)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        for n in names:
            for place in alone[n].scan(t):
                assert any(place[0] < g[1] and g[0] < place[1] for g in got), (n, place, t)
                found += 1
    assert found > 300


def test_ranks_decide_between_near_equals(monkeypatch):
    one = "the authors of this program let everyone copy change and share it with all friends and all neighbours for ever"
    near = {"A": one, "B": one.replace("program", "collection of fonts"), "C": one + " and without any fee whatsoever to anybody at all"}
    scanner = licenses.Scanner(near, 0.85)
    for n in near:
        assert [(g[2], g[5]) for g in scanner.scan(f"intro {near[n]} outro")] == [(n, "")]
    ranked = licenses.Scanner.ranked
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, words, able: ranked(self, words, able)[::-1])
    assert [g[2] for g in scanner.scan(near["B"])] == ["A"]
    monkeypatch.undo()
    asked = []
    places = licenses.Scanner._places
    monkeypatch.setattr(licenses.Scanner, "_places", lambda self, own, at, template: asked.append(template.name) or places(self, own, at, template))
    scanner.scan(near["B"])
    assert asked[0] == "B"


def test_whole_license_bodies(spark):
    w = licenses.TEMPLATES
    said = {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "MIT-full", 4: "BSD", 5: "MIT"}
    fill = lambda t: re.sub("<n>", lambda m, k=iter("123"): next(k) + ".", t)
    rows = [(i, f"Copyright (c) 2020 Someone\n\n{fill(w[n])}\n\nint main() {{}}", "en", "a") for i, n in said.items()]
    rows.append((6, "\n".join(fill(w[n]) for n in [*said.values()] * 12), "en", "a"))
    rows.append((7, "Copyright. " * 3 + (w["MIT-notice"] + " ") * 700, "en", "a"))
    got = {}
    for x in licenses.op1_licenses(docs(spark, rows + [rows[0]])).orderBy("doc_id", "start").collect():
        got.setdefault(x.doc_id, []).append(x.license)
    assert got == {**{i: [n] for i, n in said.items()}, 1: ["BSD-2-Clause"] * 2, 6: [*said.values()] * 12, 7: ["MIT-notice"] * 700}


def cheapest(roles):
    """Least cost over all ways of putting out turns, by plain search over states."""
    cost = {chat.START: 0.0}
    for r in roles:
        nxt = {}
        for s, c in cost.items():
            for o in (1, 2, 3):
                label = 0.5 if r not in chat.ROLES else 0.0 if chat.ROLES[o - 1] == r else 2.0
                step = chat._BRIDGES[s, o][0] + label + c
                nxt[o] = min(nxt.get(o, math.inf), step)
        cost = nxt
    return min(c + chat.FINISH[s] for s, c in cost.items())


def test_chat(spark):
    r = random.Random(10)
    rows = []
    for conv in range(80):
        for t in range(r.randint(1, 12)):
            rows.append((conv, t, r.choice(["user", "assistant", "system", None, "bot"]), f"t{t}"))
    rows += [(None, 1, "user", None), (None, None, "assistant", ""), (500, 1, "user", "same"), (500, 1, "user", "same")]
    turns = spark.createDataFrame([(*x, "e") for x in rows], "conv_id long, turn long, role string, text string, stretch string")
    one, many = chat.format_chats(turns), chat.format_chats(turns, 3)
    by = {}
    for k, out in enumerate((one.collect(), many.collect())):
        assert len(out) == len(rows)
        for x in out:
            by.setdefault((k, x.conv_id), []).append(x)
    for k, conv in itertools.product((0, 1), range(80)):
        own = sorted(by[k, conv], key=lambda x: x.turn)
        text = "".join(x.rendered for x in own)
        told = re.findall(r"<\|(user|assistant|system)\|>", text)
        assert told[0] != "assistant" and told[-1] == "assistant" and "system" not in told[1:]
        assert all(a != b for a, b in itertools.pairwise(told)) and text.count("<|end|>") == len(told)
        roles = [x[2] for x in rows if x[0] == conv]
        spent = sum((0.5 if a not in chat.ROLES else 2.0) * (a != x.new_role) for a, x in zip(roles, own, strict=True))
        merges = sum("merge" in x.action for x in own)
        spent += merges * chat.MERGE + chat.INSERT * (len(told) - (len(own) - merges))
        assert math.isclose(spent, cheapest([a if a in chat.ROLES else None for a in roles]))
    assert chat.op2_chat(turns.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    kept = {r.doc_id for r in out.collect()}
    docs_ = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    left = {i: r.text for i, r in docs_.items() if any(map(str.isalpha, r.text or ""))}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for i, t in left.items():
        last[low(t)] = max(last.get(low(t), -1), i)
    left = {i: t for i, t in left.items() if last[low(t)] == i}
    prints = {i: simhash.fingerprint(t) for i, t in left.items()}
    left = {i: left[i] for i, c in brute_groups(prints).items() if i == c}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {i for i, t in left.items() if not any(b in " ".join(t.lower().split()) for b in bench)}
    assert kept == left


def test_toxicity_models_are_kneser_ney(spark, monkeypatch):
    """Both classes' probabilities against plain Python, each summing to 1 over the words; and both ways of delivery."""
    r = random.Random(21)
    vocabulary = [a + b for a in "abcdef" for b in "ghij"]
    rows = [(" ".join(r.choice(vocabulary[: 12 if y and r.random() < 0.5 else 24]) for _ in range(r.randint(1, 12))), y, int(i % 3 > 0)) for i in range(160) for y in [int(i % 4 == 0)]]
    table = toxicity.gather(spark.createDataFrame(rows, "text string, y int, part int")).persist()
    discount, factor = 2.0, 1.5
    counts, _ = toxicity.counts_of(table, ("b",), discount)
    model = toxicity.kneser_ney(counts, discount, factor)
    pair = [Counter(), Counter()]
    for text, y, part in rows:
        w = text.split()
        if part:
            pair[y].update(set(zip(["^", *w], w, strict=False)))
    types = Counter(w for _, w in {*pair[0], *pair[1]})
    n = [sum(p.values()) for p in pair]
    over = [discount * x / min(n) for x in n]
    uni = [Counter(), Counter()]
    for c in (0, 1):
        for (_, w), k in pair[c].items():
            uni[c][w] += k
    s = {w: types[w] / sum(types.values()) for w in types}
    g = [{w: max(uni[c][w] - over[c], 0) / n[c] for w in types} for c in (0, 1)]
    left = max(1 - sum(g[c].values()) for c in (0, 1))
    h = {w: max(uni[0][w] + uni[1][w] - sum(over), 0) / sum(n) for w in types}
    q = {w: h[w] + (1 - sum(h.values())) * s[w] for w in types}
    for w in types:
        if abs(math.log((g[1][w] + left * s[w]) / (g[0][w] + left * s[w]))) < math.log(factor):
            g[0][w] = g[1][w] = 0
    p = [{w: g[c][w] + (1 - sum(g[c].values())) * q[w] for w in types} for c in (0, 1)]
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in p)
    contexts = {v for v, _ in {*pair[0], *pair[1]}}
    f = [{}, {}]
    for c in (0, 1):
        total = Counter()
        for (v, _), k in pair[c].items():
            total[v] += k
        for v, w in {*pair[0], *pair[1]}:
            f[c][v, w] = max(pair[c][v, w] - over[c], 0) / total[v] if total[v] else 0.0
    summed = lambda fs, v: sum(x for (a, _), x in fs.items() if a == v)
    ratio = lambda fs, v, w: math.log((fs[1].get((v, w), 0) + (1 - summed(fs[1], v)) * p[1][w]) / (fs[0].get((v, w), 0) + (1 - summed(fs[0], v)) * p[0][w]))
    told = {(v, w) for v, w in f[0] if f[0][v, w] + f[1][v, w] > 0 and abs(ratio(f, v, w) - math.log(p[1][w] / p[0][w])) >= math.log(factor)}
    final = [{k: x for k, x in f[c].items() if k in told} for c in (0, 1)]
    for c in (0, 1):
        for v in contexts:
            assert abs(sum(final[c].get((v, w), 0) + (1 - summed(final[c], v)) * p[c][w] for w in types) - 1) < 1e-9
    sent = toxicity.Sent.of(model)
    assert len(sent.keys[1]) and len(sent.keys[2])
    for text, *_ in rows:
        w = text.split()
        want = sum(ratio(final, a, b) for a, b in zip(["^", *w], w, strict=False)) / len(w) if all(x in types for x in w) else None
        got, k = toxicity._normalised([text], [sent])
        assert k[0] == len(w) and (want is None or abs(got[0][0] - want) < 1e-9)
    texts = spark.createDataFrame([(t,) for t, *_ in rows] + [("",), (None,)], "text string")
    far = {x.text: x.m for x in toxicity._joined(texts, [model]).collect()}
    assert all(abs(far[t].x[0] - toxicity._normalised([t], [sent])[0][0][0]) < 1e-9 for t, *_ in rows) and not far[""]
    long = " ".join(t for t, *_ in rows) * 40
    whole = toxicity._normalised([long, None], [sent])
    monkeypatch.setattr(tokens, "BLOCK", 300)
    monkeypatch.setattr(tokens.split, "__defaults__", (300,))
    assert len(list(tokens.split(long))) > 50 and np.allclose(toxicity._normalised([long, None], [sent])[0], whole[0])


def test_long_texts_in_pieces():
    r = random.Random(22)
    text = " ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(3000)) + "x" * 3000
    for limit in (50, 1000, 10**6):
        pieces = list(tokens.split(text, limit))
        assert "".join(pieces) == text and max(map(len, pieces)) <= max(limit, 1)


def test_very_long_texts_stay_in_bounds(spark, monkeypatch):
    """Texts in pieces give what whole ones do: the same language, nearly the same quality; and memory does not follow the text."""
    import tracemalloc

    rows = corpus(61, 150)
    df = docs(spark, rows)
    model = language.train(df)
    text = " ".join(t for _, t, lang, _ in rows if lang == "en" and t) + " " + " ".join(t for _, t, lang, _ in rows if lang == "de" and t)
    whole = next(language._inferred([text], model, 3.0, 0.5))
    q = quality.QualityModel(np.random.default_rng(1).normal(size=1 << 12).astype(np.float32), 0.1, 12)
    counts = lambda pieces: sum(np.bincount(ids, minlength=1 << 12) for _, block, _ in pieces for ids, _ in quality._features(block, q.bits))
    at_once = counts([(0, [text], False)])
    monkeypatch.setattr(tokens, "BLOCK", 400)
    monkeypatch.setattr(tokens.split, "__defaults__", (400,))
    monkeypatch.setattr(tokens.blocks, "__defaults__", (400,))
    parts = next(language._inferred([text], model, 3.0, 0.5))
    assert parts[2][0] == whole[2][0] and np.abs(parts[1] - whole[1]).max() < 0.1
    apart = counts(tokens.bounded([text]))
    assert np.abs(apart - at_once).sum() < 0.1 * at_once.sum()
    monkeypatch.undo()
    tracemalloc.start()
    long = "the house of words and that " * 300_000
    for _, block, _ in tokens.bounded([long]):
        language.infer(block, model)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_bounds_and_empty_tables(spark):
    empty = docs(spark, []).limit(0)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pii.op4_pii(empty).count() == toxicity.op5_toxicity(empty, marks).count() == quality.op10_quality(empty, marks).count() == 0
    r = random.Random(71)
    rows = spark.createDataFrame([(" ".join(r.choice("abcdefgh") * 3 for _ in range(20)) + str(i), i % 2) for i in range(400)], "text string, y int")
    seen = []
    quality_train, quality._train = quality._train, lambda cases, *a: seen.append(len(cases)) or quality_train(cases, *a)
    try:
        quality.train(rows, 50, epochs=1)
    finally:
        quality._train = quality_train
    assert 20 < seen[0] < 90
    # repeated rows and ids, and null ids
    twice = docs(spark, [(1, "the house", "en", "a"), (1, "the house", "en", "a"), (1, "other words", "en", "b"), (None, "the house", "en", None), (None, None, None, None)])
    for out in (pii.op4_pii(twice), toxicity.op5_toxicity(twice, marks), quality.op10_quality(twice, marks), language.op7_language(twice), exact.op9_exact(twice), simhash.op8_simhash(twice), mixing.op3_mixing(twice)):
        assert out.count() == 5


def test_pii_learns_from_documents(spark):
    """Every example is a candidate of its generator and has the label that its form says; made secrets are found, plain settings are not."""
    rows = [(i, f"word{i} mail a{i}.b@c{i}.example.org and 10.0.{i}.7 then +1 (20{i % 10}) 555-01{i:02} pay 4111 1111 1111 1111 Donaudampfschifffahrt", "en", "a") for i in range(12)]
    rows += [(50, None, "en", "a"), (51, "", "en", "a"), (52, rows[0][1], "en", "a")]
    made = pii.document_examples(docs(spark, rows)).collect()
    assert {(x.kind, x.label) for x in made} >= {("address", 1), ("digits", 0), ("digits", 1), ("token", 0), ("token", 1), ("secret", 1)}
    for x in made:
        assert re.fullmatch(pii.GENERATORS[x.kind], x.piece), x
    assert pii.document_examples(docs(spark, rows).limit(0)).count() == 0
    found = {x.doc_id: x.spans for x in pii.op4_pii(docs(spark, [*rows, (60, 'set password=q7!x92kd0z in "a.b"', "en", "a"), (61, "password: required, token: missing", "en", "a")])).collect()}
    assert "secret:4:23" in found[60] and found[61] == "" and found[52] == found[0] and found[50] == found[51] == ""


def test_pii_gates_lose_no_match(spark):
    r = random.Random(11)
    parts = ["a", "Bo", "x-1", ".", " ", "  ", "(at)", "[At]", "{AT}", " at ", " AT ", "(dot)", " dot ", "[Dot]", "@", "+", "1", "22", "4532", "(", ")", "-", "A1b2C3d4E5f6G7h8", "passWord", "Api-Key", "pwd", "ann@b.co", "10.2.3.4", "+49 171", "555-0199", "=", ":", '"', "s3cret!x", "\u212a", "\u0130", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 14)))) for i in range(6000)]
    gates = pii._gates()
    df = spark.createDataFrame(rows, "i int, norm_ string").withColumn("digit_", F.col("norm_").rlike("[0-9]"))
    for kind, pattern in {**pii.BASE, **pii.GENERATORS}.items():
        found = df.where(F.col("norm_").rlike(pattern))
        assert found.count() > 10, kind
        assert found.where(~gates[kind]).count() == 0, kind


def test_stages_of_odd_tables(spark):
    """Every stage on an empty table, and on nulls, repeats, a long text and columns with names of the operators' own."""
    import corpus_pipeline

    rows = [*corpus(31, 30), (None, "der die und nicht schön", "de", None), (None, None, None, None), (5, "the house of words and that", "en", "a"), (5, "the house of words and that", "en", "a"), (9000, "words with that house " * 60_000, "en", "b")]
    for table, left in ((docs(spark, rows), True), (docs(spark, rows).limit(0), False)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert bool(out.count()) == left
            assert i + 1 == len(corpus_pipeline.STAGES) or out.columns == table.columns
