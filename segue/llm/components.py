"""Connected components of a link table, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Links a task works on, where their number is known; few links need few tasks.
LINKS = 100_000


def few(df: DataFrame, rows: int, each: int = LINKS) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than these fill."""
    return df.coalesce(1 + rows // each)


def _only_stars(edges: DataFrame, n: int) -> bool:
    """Whether every node hangs on one smaller node, and none hangs on a node that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return few(each.filter("hangs > 1 or (hangs = 1 and holds = 1)"), n).limit(1).count() == 0


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after the links (a, b): only components they join are worked on."""
    links = materialise(links.select("a", "b"))
    n = links.count()
    if not n:
        return found
    ends = links
    for end in ("a", "b"):
        names = found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(names, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    merged = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), n)
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
    fresh = few(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti"), n)
    every = found.unionByName(fresh.withColumn("component", F.col("node")))
    return materialise(every.join(merged, "component", "left").select("node", F.coalesce("now", "component").alias("component")))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    ``rows`` is about how many links there are, where that is known.

    Alternates two steps until only stars are left: every node hangs its larger neighbours,
    then its smaller ones, on the smallest (Kiveris et al. 2014).  Stars are never taken apart
    into pairs, and a node's neighbours are never collected.  Each round is written, which
    cuts the lineage.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges if rows is None else few(edges, rows))
    n = edges.count()
    while not _only_stars(edges, n):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(few(large.filter("a <> b").distinct(), n))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        edges = materialise(few(small, n))
    roots = few(edges.select(F.col("b").alias("node")).distinct(), n).withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
