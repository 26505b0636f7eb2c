"""Centroid clustering by partial-distance search, in exact integers.

A vector's components become integers floor(1024 * x).  Each round, the tasks assign
their vectors to the nearest centroid and send, per task, one row of sums for each
centroid and dimension; Spark adds those up, and only the new centroids reach the
driver.  The search adds squared differences over the dimensions of highest variance
first and gives a centroid up for a vector once the partial sum is strictly above
the vector's best; whatever survives has all its dimensions added.  Variances, sums
and inertia are taken over all vectors; nothing is sampled.

Defined results: rows whose vector is null, has not exactly 64 components or holds a
null or non-finite one give no row.  Rows are clustered one by one, so repeated rows
and repeated or null vec_ids do no harm; where first centroids tie in the hash (the
vec_id is the same), the components decide, and a null vec_id hashes as an empty
text.  Fewer vectors than centroids give fewer centroids, none gives no rows.  Other
columns are not read.  A distance or inertia beyond 64 bits is null; components
beyond 10^44 after scaling (no 32-bit float reaches them) are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import usable

DIM, SCALE, LIMB = 64, 1024, 10**18
#: Partial sums are compared after so many dimensions.
STEPS = ((0, 8), (8, 16), (16, 32), (32, DIM))
#: Components up to this size have distances in 64 bits; larger ones are computed in integers of any size.
PLAIN = 1 << 27
_LONG = (1 << 63) - 1


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as 64-bit integers, or as Python's where those do not do."""
    if not x.size or np.abs(x).max() * SCALE <= PLAIN:
        return np.floor(x * SCALE).astype(np.int64)
    if np.abs(x).max() > 1e44 / SCALE:
        raise ValueError("components beyond 10^44")
    return np.array([[int(v) for v in row] for row in np.floor(x * SCALE)], dtype=object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row of x, the smaller number on ties, and its squared distance."""
    columns, best, which = np.ascontiguousarray(x.T[order]), None, np.zeros(len(x), dtype=np.int64)
    for k, centre in enumerate(centroids[:, order]):
        live, total = None, np.zeros(len(x), dtype=x.dtype)
        for a, b in STEPS:
            apart = (columns[a:b] if live is None else columns[a:b, live]) - centre[a:b, None]
            total = total + (apart * apart).sum(axis=0)
            if best is None:
                continue
            kept = np.flatnonzero(total <= (best if live is None else best[live]))
            live, total = (kept if live is None else live[kept]), total[kept]
            if not len(live):
                break
        if best is None:
            best = total
        elif len(live):
            closer = total < best[live]
            best[live[closer]], which[live[closer]] = total[closer], k
    return which, best


@dataclass(frozen=True)
class Clusters:
    """Centroids as integers, the order in which dimensions are compared, rounds that moved a centroid, and inertia by centroid (None beyond 64 bits)."""

    centroids: tuple[tuple[int, ...], ...]
    order: tuple[int, ...]
    rounds: int
    inertia: tuple[int | None, ...]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = max((abs(v) for c in self.centroids for v in c), default=0) > PLAIN
        return nearest(x.astype(object) if large else x, np.array(self.centroids, dtype=object if large or x.dtype == object else np.int64), np.array(self.order))

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = usable(batch.column("embedding"), DIM)
    at, x = found.get(DIM, (np.zeros(0, dtype=np.int64), np.zeros((0, DIM))))
    return at, whole_numbers(x)


def _first(vectors: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """The components of the k vectors of smallest hash; each batch sends its own k at most."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _integers(batch)
            ids = batch.column("vec_id").take(pa.array(at)).to_pylist()
            rows = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), list(map(str, v))) for i, v in zip(ids, x.tolist(), strict=True))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["h", "x"])

    best = vectors.mapInArrow(ranked, "h string, x array<string>").orderBy("h", "x").limit(k).collect()
    return [tuple(map(int, r["x"])) for r in best]


def _by_variance(vectors: DataFrame) -> tuple[int, ...]:
    """The dimensions, highest variance first; it decides about speed alone."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(DIM), np.zeros(DIM)
        for batch in batches:
            x = _integers(batch)[1].astype(float)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIM), pa.int32()), pa.array([n] * DIM, pa.int64()), pa.array(one), pa.array(two)], ["d", "n", "one", "two"])

    rows = vectors.mapInArrow(moments, "d int, n long, one double, two double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).collect()
    spread = {r["d"]: r["two"] / r["n"] - (r["one"] / r["n"]) ** 2 if r["n"] else 0.0 for r in rows}
    return tuple(sorted(range(DIM), key=lambda d: (-spread.get(d, 0.0), d)))


def _moved(vectors: DataFrame, made: Clusters) -> tuple[tuple[int, ...], ...]:
    """The centroids after one round: floors of exact means; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(made.centroids)
        n, total = [0] * k, np.zeros((k, DIM), dtype=object)
        for batch in batches:
            _, x = _integers(batch)
            which, _ = made.search(x)
            for c in np.unique(which).tolist():
                own = x[which == c]
                n[c] += len(own)
                total[c] += np.array(own.sum(axis=0).tolist(), dtype=object)
        rows = [(c, d, n[c], *divmod(int(total[c][d]), LIMB)) for c in range(k) if n[c] for d in range(DIM)]
        limb = lambda i: pa.array([Decimal(r[i]) for r in rows], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), limb(3), limb(4)], ["c", "d", "n", "high", "low"])

    added = vectors.mapInArrow(sums, "c int, d int, n long, high decimal(38,0), low decimal(38,0)").groupBy("c", "d").agg(*(F.sum(x).alias(x) for x in ("n", "high", "low")))
    new = [list(c) for c in made.centroids]
    for r in added.collect():
        new[r["c"]][r["d"]] = (int(r["high"]) * LIMB + int(r["low"])) // r["n"]
    return tuple(map(tuple, new))


def _inertia(vectors: DataFrame, made: Clusters) -> tuple[int | None, ...]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(made.centroids)
        for batch in batches:
            which, far = made.search(_integers(batch)[1])
            for c in np.unique(which).tolist():
                total[c] += sum(far[which == c].tolist())
        # sums too large for the column stand for all that are beyond 64 bits
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(min(t, 10 * _LONG)) for t in total], pa.decimal128(38, 0))], ["c", "t"])

    rows = vectors.mapInArrow(sums, "c int, t decimal(38,0)").groupBy("c").agg(F.sum("t").alias("t")).collect()
    got = {r["c"]: int(r["t"]) for r in rows}
    return tuple(got.get(c, 0) if got.get(c, 0) <= _LONG else None for c in range(len(made.centroids)))


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> Clusters:
    """Centroids after so many rounds over rows (vec_id, embedding); rounds after one that moves nothing would not move anything either and are left out."""
    made = Clusters(tuple(_first(vectors, k, seed)), _by_variance(vectors), 0, ())
    for done in range(rounds if made.centroids else 0):
        new = _moved(vectors, made)
        if new == made.centroids:
            break
        made = Clusters(new, made.order, done + 1, ())
    return Clusters(made.centroids, made.order, made.rounds, _inertia(vectors, made) if made.centroids else ())


def assign(vectors: DataFrame, made: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row."""
    digests = made.digests()
    whole = None if None in made.inertia or sum(made.inertia) > _LONG else sum(made.inertia)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _integers(batch)
            if not len(at):
                continue
            which, far = made.search(x)
            far, which = [d if d <= _LONG else None for d in far.tolist()], which.tolist()
            columns = [
                batch.column("vec_id").take(pa.array(at)), pa.array(which, pa.int32()), pa.array(far, pa.int64()), pa.array([made.inertia[c] for c in which], pa.int64()),
                pa.array([whole] * len(which), pa.int64()), pa.array([digests[c] for c in which], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(rows, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op11_centroids(embeddings: DataFrame) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = embeddings.select("vec_id", "embedding")
    return assign(vectors, fit(vectors))


def _sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, k, d FROM (SELECT x.r, x.vec_id, c.k, {far} AS d, row_number() OVER (PARTITION BY x.r ORDER BY {far}, c.k) AS place FROM x, c{i} c) WHERE place = 1)")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(max(new), max(old)) AS v FROM (SELECT k, v AS old, NULL AS new FROM c{i} UNION ALL
 SELECT k, NULL, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) FROM (SELECT k, j, sum(CAST(x.v[j] AS HUGEINT)) AS s, count(*) AS n FROM a{i} JOIN x USING (r), (SELECT unnest(range(1, {DIM + 1})) AS j) GROUP BY k, j) GROUP BY k) GROUP BY k)""")
    a, c = f"a{rounds}", f"c{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {a} a JOIN {c} c ON c.k = a.k"""


OP11_SQL = _sql()
