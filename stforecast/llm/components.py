"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stforecast.llm.shared import written


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free checksum, to see whether anything moved."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b): the smallest node it is connected to.

    Each round hangs the neighbours of a node under the smallest one it knows, first the larger
    neighbours, then the smaller; paths shrink geometrically. The table is written after every
    round. Minima are combined before the shuffle, so a node with many links is no hot group.
    """
    edges = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = (0, None)  # without links nothing is left to do
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``joined`` after further ``links`` (a, b).

    Only links between two of the components so far are followed, from component to component,
    so the rounds work on what the new links change and not on all links again.
    """
    def known(end: str) -> DataFrame:
        return joined.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))

    between = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = written(components(between))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = joined.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.unionByName(merged.join(joined, "node", "left_anti").select("node", "component"))
