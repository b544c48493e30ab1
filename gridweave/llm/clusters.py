"""Centroid clustering of integer vectors, assigned by a tournament over bisecting planes.

For centroids i < j the points nearer to j are those with ``x . 2(cj - ci) > |cj|^2 - |ci|^2``. Normals and thresholds
of all pairs are computed once a round, as integers. A vector starts with centroid 0 and meets 1, 2, ... in turn; each
meeting is one linear sign test that the loser leaves, a tie (zero) favours the smaller number, and after k - 1 tests
the winner is the nearest centroid. Only its distance is then computed, exactly.

Centroids (k times 64 integers, whatever the size of the table) travel with the task code. Every task adds up what it
assigns, Spark adds up the tasks, and the driver sees k sums and counts a round; one vector that fills a third of
the table changes nothing.

Arithmetic is exact: components up to 2^20 use 64-bit floats whose sums stay below 2^53, larger ones Python integers;
sums travel as digits of 40 bits.

Defined results: vectors of another length, and those with a NULL or non-finite component, are left out, as is a NULL
vector; a NULL or repeated id is kept like any other, and equal hashes of start vectors are ordered by the vector, a
NULL id after all others; with fewer vectors than centroids there are as many centroids as vectors; equal start
vectors leave all but the first of them empty, where they stay as they are; distances or sums beyond 64 bits are NULL;
an empty table gives an empty result; columns with clashing names are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .registry import query

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Up to this size of a component 64-bit floats are exact throughout.
EXACT = 1 << 20
#: Sums travel as digits of so many bits.
DIGIT = 40
_LONG = (1 << 63) - 1

Vector = tuple[int, ...]


def scaled(x: float, scale: int = SCALE) -> int:
    """``floor(scale * x)``, exactly, for a power of two."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, x``: the vectors of the right length with finite components, as doubles."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    out = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    return out.where(F.col("x").isNotNull() & (F.size("x") == dimensions) & F.forall("x", finite))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = "1") -> list[Vector]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return [tuple(scaled(v) for v in r["x"]) for r in rows]


class Tournament:
    """Finds the nearest of some centroids, the smallest number among equals."""

    def __init__(self, centroids: list[Vector]) -> None:
        self.small = all(abs(v) <= EXACT for c in centroids for v in c)
        self.tables = {kind: self._tables(centroids, kind) for kind in ([float, object] if self.small else [object])}

    @staticmethod
    def _tables(centroids: list[Vector], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(centroids)
        points = np.array(centroids, dtype=object).reshape(k, -1)
        normals = 2 * (points[None, :, :] - points[:, None, :])
        norms = (points * points).sum(axis=1)
        return points.astype(kind), normals.astype(kind), (norms[None, :] - norms[:, None]).astype(kind)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and squared distance of integer vectors, all small floats or all Python integers."""
        points, normals, thresholds = self.tables[object if x.dtype == object else float]
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(points)):
            beaten = (x * normals[winner, j]).sum(axis=1) > thresholds[winner, j]
            winner[beaten.astype(bool)] = j
        apart = x - points[winner]
        return winner, (apart * apart).sum(axis=1)

    def groups(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and integer vectors, those with small components apart from the others."""
        small = np.abs(x).max(axis=1) * SCALE <= EXACT if self.small else np.zeros(len(x), bool)
        if small.any():
            yield np.flatnonzero(small), np.floor(x[small] * SCALE)
        if not small.all():
            large = np.empty((int((~small).sum()), x.shape[1]), dtype=object)
            large[:] = [[scaled(v) for v in row] for row in x[~small].tolist()]
            yield np.flatnonzero(~small), large


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _digits(value: int) -> list[int]:
    out = []
    while not -(1 << DIGIT) < value < 1 << DIGIT:
        out.append(value & (1 << DIGIT) - 1)
        value >>= DIGIT
    return [*out, value]


def adder(centroids: list[Vector]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of vectors to the sums of a task: ``cluster, component, digit, value``; component -1 counts."""
    names = ["cluster", "component", "digit", "value"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        sums = {c: [0] * (len(centroids[0]) + 1) for c in range(len(centroids))}
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, x in game.groups(_matrix(batch)):
                winner, _ = game.nearest(x)
                for c in np.unique(winner).tolist():
                    mine = x[winner == c]
                    total = [len(mine), *map(int, mine.sum(axis=0).tolist())]
                    sums[c] = [a + b for a, b in zip(sums[c], total, strict=True)]
        rows = [(c, i - 1, d, v) for c, values in sums.items() if values[0]
                for i, value in enumerate(values) for d, v in enumerate(_digits(value))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in zip(*rows, strict=True)], names=names)
    return run


def assigner(centroids: list[Vector]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of vectors to ``vec_id, cluster, distance``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            if batch.num_rows:
                for at, x in game.groups(_matrix(batch)):
                    winner, squared = game.nearest(x)
                    cluster[at] = winner
                    for i, d in zip(at.tolist(), squared.tolist(), strict=True):
                        distance[i] = int(d) if d <= _LONG else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])
    return run


def next_centroids(vectors: DataFrame, centroids: list[Vector]) -> list[Vector]:
    """Every non-empty centroid moved to the floored mean of its vectors."""
    parts = vectors.mapInArrow(adder(centroids), "cluster bigint, component bigint, digit bigint, value bigint")
    rows = parts.groupBy("cluster", "component", "digit").agg(F.sum("value").alias("value")).collect()
    sums = [[0] * (len(c) + 1) for c in centroids]
    for r in rows:
        sums[r["cluster"]][r["component"] + 1] += r["value"] << DIGIT * r["digit"]
    return [tuple(s // n for s in rest) if n else old for old, (n, *rest) in zip(centroids, sums, strict=True)]


def cluster_vectors(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "1", id_col: str = "vec_id",
                    vec_col: str = "embedding", dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[Vector]]:
    """``vec_id, cluster, distance`` of all kept vectors, and the final centroids."""
    vectors = kept_vectors(df, id_col, vec_col, dimensions)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false"), []
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(assigner(centroids), f"vec_id {id_type}, cluster int, distance bigint"), centroids


def _hash(c: Vector) -> str:
    return hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()


def _oracle() -> str:
    """The rounds as a chain of common table expressions over (vector, component) rows."""
    kept = f"""kept AS (SELECT vec_id, row_number() OVER () AS r, embedding FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = {DIMENSIONS}),
    x AS (SELECT r, unnest(range({DIMENSIONS})) AS d, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
    s AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {CENTROIDS}),
    c0 AS (SELECT s.c, x.d, x.x AS m FROM s JOIN x USING (r))"""
    steps = [kept]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (SELECT r, c AS cluster, dist AS distance FROM (
            SELECT x.r, c.c, sum((x.x - c.m) * (x.x - c.m)) AS dist FROM x JOIN c{i} c ON x.d = c.d GROUP BY x.r, c.c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT cluster AS c, d, sum(x) AS t, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY 1, 2),
            c{i + 1} AS (SELECT o.c, o.d, CASE WHEN n IS NULL THEN o.m ELSE CAST((t - ((t % n) + n) % n) / n AS BIGINT) END AS m
                FROM c{i} o LEFT JOIN m{i} ON o.c = m{i}.c AND o.d = m{i}.d)""")
    return "WITH " + ",\n".join(steps) + f""",
    h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
        CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{ROUNDS} JOIN kept USING (r) JOIN h ON h.c = cluster"""


@query("op12_centroid_clustering", _oracle())
def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    rows, centroids = cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = settle(rows, "op12-assigned")

    def whole(total: Column) -> Column:
        return F.when(F.count("distance") == F.count("*"), total)
    sums = rows.groupBy("cluster").agg(whole(F.sum(F.col("distance").cast("decimal(38,0)"))).alias("part")).collect()
    parts = {r["cluster"]: None if r["part"] is None else int(r["part"]) for r in sums}
    every = None if None in parts.values() else sum(parts.values())

    def fits(n: int | None) -> int | None:
        return n if n is not None and n <= _LONG else None
    per_cluster = spark.createDataFrame([(c, fits(parts.get(c, 0)), fits(every), _hash(v)) for c, v in enumerate(centroids)],
                                        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
