"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """For each end of an edge (``a``, ``b``) the smallest node it can reach: ``node``, ``component``.

    In each round every node takes its smallest neighbour as parent if that is smaller than itself, two
    pointer jumps shorten the paths, and edges move to the parents; equal edges become one, so the graph
    at least halves its nodes. The written rounds are then composed. Nodes move by joins alone, which
    adaptive execution splits where many nodes have one parent. Null ends and loops are left out.
    """
    left = edges.select("a", "b").filter("a <> b")
    left = written(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = written(parents.select("node", F.least("node", "parent").alias("parent")), "parents")
        for _ in range(2):
            parents = _followed(parents, parents)
        parents = written(parents, "parents")
        rounds.append(parents)
        moved = left
        for end in ("a", "b"):
            moved = moved.join(parents.select(F.col("node").alias(end), F.col("parent").alias(f"_{end}")), end)
        moved = moved.filter("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
        left = written(moved.distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        found = _followed(earlier, found)
    return written(found.select("node", F.col("parent").alias("component")), "components")


def _followed(parents: DataFrame, further: DataFrame) -> DataFrame:
    """Each node with the parent of its parent, where ``further`` has one."""
    step = further.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
    return parents.join(step, "parent", "left").select("node", F.coalesce("_next", "parent").alias("parent"))
