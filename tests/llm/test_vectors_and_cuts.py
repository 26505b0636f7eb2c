"""Centroids, nearest neighbours and fill-in-middle, held against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import centroids, fim, nearest

ODD = [(None, [0.5] * 64), (7, None), (8, []), (9, [1.0] * 63), (10, [1.0] * 63 + [None]), (11, [float("nan")] + [1.0] * 63), (12, [float("inf")] * 64), (13, [0.0] * 64), (300, [0.0] * 64)]


def table(spark, rows, kind="float"):
    """Vectors with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, query int, rank string, d double")


def vectors(seed, n, scale=1.0, size=64):
    r = random.Random(seed)
    centre = [[r.gauss(0, scale) for _ in range(size)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.3 * scale))) for c in r.choice(centre)]) for i in range(n)]
    # repeated vectors under other ids, and rows that repeat an id
    return rows + [(n + 1000 + i, rows[i][1]) for i in range(20)] + [rows[3], rows[3], (3, rows[5][1])]


def plain_centroids(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), list(map(str, v))) for i, v in kept)[:k]
    centre = [list(map(int, v)) for _, v in first]

    def nearest_of(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))

    for _ in range(rounds):
        of = [nearest_of(v)[1] for _, v in kept]
        for j in range(len(centre)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                centre[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *nearest_of(v)[::-1]) for i, v in kept], centre


@pytest.mark.parametrize("scale", [0.2, 3e5, 1e6])
def test_centroids(spark, scale):
    rows = vectors(1, 150, scale) + ODD
    want, centre = plain_centroids(rows)
    got = centroids.op11_centroids(table(spark, rows)).collect()
    fits = lambda d: d if d < 1 << 63 else None
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(((i, c, fits(d)) for i, c, d in want), key=repr)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    inertia = [fits(sum(d for _, c, d in want if c == j)) for j in range(len(centre))]
    assert all(r.centroid_sha256 == digest[r.cluster] and r.cluster_inertia == inertia[r.cluster] and r.inertia == fits(sum(d for _, _, d in want)) for r in got)


def test_few_centroids_and_none(spark):
    few = table(spark, [(1, [0.0] * 64), (2, [1.0] * 64), (1, [0.0] * 64)])
    assert sorted((r.vec_id, r.distance) for r in centroids.op11_centroids(few).collect()) == [(1, 0), (1, 0), (2, 0)]
    for rows in (ODD[1:7], []):
        assert centroids.op11_centroids(table(spark, rows)).count() == 0
    huge = table(spark, [(i, [(-1.0) ** i * 3e38] * 64) for i in range(9)] + [(20 + i, [i * 1.0] * 64) for i in range(9)])
    assert centroids.op11_centroids(huge).count() == 18
    with pytest.raises(Exception, match="10\\^44"):
        centroids.op11_centroids(table(spark, [(1, [1e300] * 64)], "double")).collect()


def test_partial_distances_give_up_only_what_is_farther():
    r = np.random.default_rng(2)
    x, c = r.integers(-9, 9, (500, 64)), r.integers(-9, 9, (8, 64))
    c[5] = c[2]  # ties go to the smaller number
    x[:9] = c[2]
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), r.permutation(64)):
        which, best = centroids.nearest(x, c, order)
        assert (which == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def plain_nearest(rows, k=10):
    kept = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in kept if i % 100 == 0}:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in kept if i != q and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 2])
def test_nearest(spark, block, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", (2, 37))
    rows = vectors(3, 420) + ODD + [(i, [float(i % 7)] * 5) for i in range(2000, 2105)] + [(100, vectors(4, 30)[0][1]), (500, [1.0] * 7)]
    t = table(spark, rows).repartition(3)
    got = nearest.neighbours(t, t.where(nearest.is_query()), 10, block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == plain_nearest(rows)


def test_nearest_of_few(spark):
    assert nearest.op12_nearest(table(spark, ODD[1:8])).count() == 0 and nearest.op12_nearest(table(spark, [])).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0]), (100, [1.0])]
    assert [(r.query_id, r.vec_id, r.score) for r in nearest.op12_nearest(table(spark, rows)).orderBy("rank").collect()] == [(0, 1, 0.0), (0, 2, 5.0)]
    large = [(i, [1e200 * i, 1e200]) for i in range(5)]
    assert nearest.op12_nearest(table(spark, large, "double")).count() == 4


def test_bounds_hold():
    r = np.random.default_rng(5)
    for scale in (1e-30, 1.0, 1e12):
        x, y = r.normal(size=(60, 64)) * scale, r.normal(size=(80, 64)) * scale * r.uniform(0.01, 2, (80, 1))
        y[:20] = x[:20]
        low, high = nearest.between(nearest.coded(x), nearest.coded(y))
        d = np.array([nearest.distances(np.repeat(x[i : i + 1], len(y), axis=0), y) for i in range(len(x))])
        assert (low <= d).all() and (d <= high).all() and (high - low).max() < 0.2 * d.max()


def plain_tokens(t):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)


TEXTS = [None, "", " ", "\n\t", "a", " a", "a ", "a b", "  two  words  ", "é 😀 x   y", "has <P> in it", "a<S>", "<M>", "x" * 5000, "w " * 40_000, "\r\n".join("line %d" % i for i in range(300))]


def test_run_lengths():
    r = random.Random(6)
    for t in [*(t or "" for t in TEXTS), *("".join(r.choice("ab \n é") for _ in range(r.randint(0, 30))) for _ in range(300))]:
        for unit, parts in (("token", plain_tokens(t)), ("character", list(t))):
            runs = fim.encoded(t, unit)
            assert runs.units == len(parts)
            for k in range(0, len(parts) + 1, max(1, len(parts) // 50)):
                assert runs.offset(k) == len("".join(parts[:k]))


def test_fill_in_middle(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id at all"), (1, "again"), (1, "again")]
    docs = spark.createDataFrame([(i, t, "f", "o", 3) for i, t in rows], "doc_id long, text string, fim string, output string, at int")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        t, s = t or "", sha(f"42:{'' if i is None else i}")
        h = [int(s[8 * j : 8 * j + 8], 16) for j in range(4)]
        parts = plain_tokens(t)
        n = len(parts)
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(parts[:lo]), "".join(parts[lo:hi]), "".join(parts[hi:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            want.append((i, n, "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < 80:
            want.append((i, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            want.append((i, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    got = [tuple(r) for r in fim.op13_fim(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fim.op13_fim(docs.limit(0)).count() == 0
    by_character = fim.transformed(docs, rate=100, unit="character")
    assert by_character.columns == docs.columns
    for r in by_character.select("text", "fim.*").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert r.back == (r.text or "") and r.n == len(r.text or "")
    with pytest.raises(ValueError):
        fim.transformed(docs, unit="line")
