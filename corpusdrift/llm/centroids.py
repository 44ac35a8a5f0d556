"""Clusters of vectors around centroids, in whole numbers and in built-in functions only.

Vectors become whole numbers, so that sums and distances are exact and don't depend on the order
in which tasks add them up.  In each round the centroids are literal arrays in the plan:
``zip_with`` and ``aggregate`` give the squared distance to each, ``array_min`` of structs the nearest one,
and one sum for each component, combined before the shuffle, moves the centroids.  What reaches the
driver in a round is one row for each centroid.
"""

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import shared

#: Components are held to this size, so that a distance of any two vectors of 64 of them is less than 2^62.
MOST = 2**27


@dataclass(frozen=True)
class Centroids:
    """What decides the result."""

    size: int = 64
    scale: int = 1024
    count: int = 8
    rounds: int = 10
    seed: int = 3


def whole_vectors(vectors: DataFrame, spec: Centroids) -> DataFrame:
    """``vec_id, v`` of the vectors with the right number of components, none of them null or not finite."""
    x = F.col("embedding").cast("array<double>")
    held = lambda c: F.floor(F.least(F.greatest(c * spec.scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == spec.size)
    kept = kept.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return kept.select("vec_id", F.transform("x", held).alias("v"))


def _first(rows: DataFrame, spec: Centroids) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; a missing id counts as an empty one."""
    name = F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.select("v", F.sha2(name, 256).alias("hash")).orderBy("hash", "v").limit(spec.count)
    return [list(row.v) for row in chosen.collect()]


def _array(values: Sequence[int | None]) -> Column:
    """A literal array of whole numbers."""
    return F.expr(f"array({', '.join('CAST(null AS bigint)' if x is None else f'{x}L' for x in values)})")


def nearest(centroids: list[list[int]]) -> Column:
    """The nearest of the centroids to ``v``: a struct of ``distance`` and ``cluster``; of equal ones the first."""

    def distance(centroid: list[int]) -> Column:
        squares = F.zip_with("v", _array(centroid), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    each = (F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))
    return F.array_min(F.array(*each))


def _moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The mean of each centroid's vectors, rounded down; a centroid without vectors stays."""
    size = len(centroids[0])
    placed = rows.select(nearest(centroids)["cluster"].alias("cluster"), *(F.col("v")[i].alias(f"v{i}") for i in range(size)))
    sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(size)))
    moved = list(centroids)
    for row in sums.collect():  # one row for each centroid
        moved[row.cluster] = [row[f"v{i}"] // row.n for i in range(size)]
    return moved


def cluster(vectors: DataFrame, spec: Centroids = Centroids()) -> DataFrame:
    """Assign vectors to centroids that move to the mean of their vectors for some rounds.

    Takes ``vec_id`` and ``embedding``; other columns are ignored.  Kept are the vectors with exactly ``size``
    components, none null or not finite; a component ``x`` counts as ``floor(scale * x)``.  Of components
    beyond ``MOST`` either way only that size counts.  The first centroids are the ``count`` vectors (or all,
    if there are fewer) with the smallest SHA-256 of ``seed:vec_id``; a missing id counts as empty text,
    and of equal ids the smaller vector comes first.  Squared distances decide, ties go to the smaller number.

    Returns one row for each kept row, repeated ones too: ``vec_id, cluster, distance`` (squared),
    ``cluster_inertia`` and ``inertia`` (distances summed over its cluster and over all; null beyond 64 bits),
    ``centroid_sha256`` (of its final centroid's components, joined by commas).  No kept row gives no row.
    """
    rows = shared.written(whole_vectors(vectors, spec))
    centroids = _first(rows, spec)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return rows.sparkSession.createDataFrame([], empty)
    for _ in range(spec.rounds):
        centroids = _moved(rows, centroids)
    placed = shared.written(rows.select("vec_id", nearest(centroids).alias("nearest")).select("vec_id", "nearest.*"))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    inertia = [0] * len(centroids)
    for row in sums.collect():  # one row for each centroid
        inertia[row.cluster] = int(row.inertia)
    bounded = [x if x < 2**63 else None for x in [*inertia, sum(inertia)]]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    place = F.col("cluster") + 1
    return placed.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(_array(bounded[:-1]), place).alias("cluster_inertia"),
        F.lit(bounded[-1]).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, hashes)), place).alias("centroid_sha256"),
    )
