"""Connected components with DataFrame joins, and on the driver where links are few."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import cut


def with_least(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the least ``value`` of the row's ``group``. ``df`` is read twice, so it should be a checkpoint.

    The minima are a table of their own, so rows meet them in a plain join of
    two exchanges, which adaptive execution splits where a group holds a
    large share of the rows.
    """
    return df.join(cut(df.groupBy(group).agg(F.min(value).alias(name))), group)


def _stars(links: DataFrame) -> bool:
    """Every node of ``links`` (a, b) is either the centre of its links or has one link."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e"))
    each = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least"))
    return each.filter("out > 1 OR (out = 1 AND least = 0)").isEmpty()


def _on_driver(links: DataFrame) -> DataFrame:
    """``components`` of few ``links`` (a, b; longs), by union and find."""
    table, root = links.toArrow(), {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = list(root)
    made = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(map(find, nodes), pa.int64())})
    return links.sparkSession.createDataFrame(made)


def components(edges: DataFrame, local: int = 0) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the least node reachable.

    Up to ``local`` links are joined on the driver, as a step costs more than
    they do. More alternate large-star and small-star steps until the links
    are stars. Each step is checkpointed, so a lost executor costs one step at
    most.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.count() <= local:
        return _on_driver(links)
    while not _stars(links):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = with_least(both, "u", "v", "m").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = with_least(cut(large.distinct()), "u", "v", "m")
        small = small.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("a"), F.col("m").alias("b"))
        links = cut(small.distinct())
    nodes = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("e"))
    return cut(nodes.select("e.node", "e.root").distinct())
