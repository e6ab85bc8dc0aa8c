"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrace.llm.common import discard, scratch

#: Links of one task of the local step.
HELD = 250_000


def roots(links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node of its component for every node of a task's links."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in links:
        if (a := top(a)) != (b := top(b)):
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (a, b) as stars of its own components, in (node, smallest node)."""
    links = [(a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    stars = [(x, y) for x, y in roots(links).items() if x != y]
    yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])


def connected_components(links: DataFrame, held: int = HELD) -> DataFrame:
    """(node, component) of every node of links (a, b); component is its smallest reachable node.

    Each round first turns the links of every task, about ``held`` at most, into stars. If that took one
    task, they are the components. Otherwise a large-star and a small-star contraction follow, until
    the links stay the same, about the logarithm of the longest chain. A contraction joins links with
    the smallest neighbour of each node, an aggregate that combines before it shuffles, so a node with
    very many links is a skewed join, not a large group. Each round is written and the former removed.

    Edge cases: repeated links and links of a node with itself change nothing (a node with no other link
    has no row); an empty table gives no rows.
    """
    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        tasks = -(-edges.count() // held)
        stars = scratch(edges.coalesce(max(tasks, 1)).mapInArrow(forest, "a long, b long"), "stars")
        discard(edges)
        edges = stars
        if tasks <= 1:
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        contracted = scratch(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = contracted
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
