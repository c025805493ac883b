"""Connected components of links, as joins and aggregates over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.storage import RunTables


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node among it and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (
        both.filter("b > a").join(least, "a")
        .select(F.col("least").alias("a"), "b").filter("a < b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").filter("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), "b")).distinct()


def components(links: DataFrame, run: RunTables, name: str = "links") -> DataFrame:
    """(node, component) of every node in ``links`` (a long, b long); the component is its least node.

    Alternates large and small stars until nothing moves; then each component is a star around its
    least node. Every round is written to the shared folder, which ends its lineage. A node with very
    many links costs rows of a join whose other side has one row for it, so its rows can be split.
    """
    edges = run.write(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
        f"{name}-0",
    )

    def state(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row.n, row.h

    before, turn = state(edges), 0
    while before[0]:
        turn += 1
        next_edges = run.write(_small_star(_large_star(edges)), f"{name}-{turn}")
        run.drop(f"{name}-{turn - 1}")
        edges, after = next_edges, state(next_edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select("a", F.col("a").alias("component")).distinct()
    )
