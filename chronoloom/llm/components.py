"""Connected components of an edge table, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """One step of star contraction: neighbours of a node are tied to the smallest of them all."""
    if larger:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    least = least.withColumn("low", F.least("node", "low"))
    joined = both.join(least, F.col("a") == F.col("node"))
    kept = F.col("b") > F.col("a") if larger else F.lit(True)
    tied = joined.filter(kept).select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not larger:
        tied = tied.union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return tied.filter(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node it reaches.

    Alternates large-star and small-star steps until nothing changes, about log² of the component
    size at worst. Each step joins edges with one row per node, so a node with very many
    neighbours is split like any skewed join; its lineage ends at a checkpoint.
    """
    pairs = cut(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(pairs)
    for _ in range(most_steps):
        pairs = cut(_stars(_stars(pairs, True), False))
        now = _mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select(F.col("root").alias("node"), "root")
    )


def _mark(pairs: DataFrame) -> tuple:
    """Equal for equal edge sets: count, sum of hashes and xor of hashes."""
    row = pairs.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("a", "b")),
    ).first()
    return tuple(row)
