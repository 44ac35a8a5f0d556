"""Connected components of a graph given as a table of links."""

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import shared

#: Links that one task joins up by itself.
TASK_LINKS = 500_000


def _links(rows: DataFrame, low: str, high: str) -> DataFrame:
    return rows.select(F.col(low).alias("low"), F.col(high).alias("high")).where("low < high").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, with every node tied to the smallest node it reaches over them."""
    lead: dict[int, int] = {}

    def top(node: int) -> int:
        root = node
        while (up := lead.setdefault(root, root)) != root:
            root = up
        while lead[node] != root:
            lead[node], node = root, lead[node]
        return root

    for batch in batches:
        for low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(low), top(high)
            lead[max(a, b)] = min(a, b)
    nodes = [node for node in lead if top(node) != node]
    yield pa.RecordBatch.from_arrays(
        [pa.array([lead[n] for n in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["low", "high"]
    )


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """``node, component`` of every node with a link to another: the smallest node reachable.

    Tasks of ``task_links`` links each join up what they have, which leaves at most one link for each of
    their nodes.  If there is more than one task, rounds over all links follow: each ties all larger
    neighbours of a node to its smallest one, then all smaller neighbours likewise, until every link
    points to its component's smallest node.  The rounds grow with the logarithm of the longest chain.
    Minima are combined before each shuffle; no neighbourhood is gathered.  Every round is written, so a
    lost executor costs its tasks only.
    """
    ends = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    links = shared.written(ends.where("low < high"))
    tasks = max(1, math.ceil(links.count() / task_links))
    links, before = shared.written(links.repartition(tasks).mapInArrow(_joined_up, "low long, high long")), None
    while tasks > 1 and (now := _mark(links)) != before:
        before = now
        both = links.select(F.col("low").alias("x"), F.col("high").alias("y")).union(
            links.select(F.col("high").alias("x"), F.col("low").alias("y"))
        )
        least = both.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select("m", "y")
        large = shared.written(_links(large, "m", "y"))
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select("m", "low").union(least.select("m", F.col("high").alias("low")))
        links = shared.written(_links(small, "m", "low"))
    found = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return found.union(links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
