"""Ranks and chunks inside groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_ROW_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a number without gaps, from 0; the rows are written once, so that it stays.

    Rows keep their place in their partition; what is broadcast is a row for each partition.
    """
    placed = materialise(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _ROW_BITS)
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(starts), "_p")
        .withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_p", "_m", "_start")
    )


def rank_by_position(df: DataFrame, keys: list[str], pos: str, name: str = "rank", times: str | None = None) -> DataFrame:
    """Add the 1-based rank of ``pos`` (integer, unique in its group) per group.

    With ``times``, a row stands for so many, and its rank is that of the first of them.

    A group may hold a large share of all rows, so no task ever sees a whole one.  The rows
    are written once, range-partitioned by group and position: most groups lie in one
    partition, and large ones are cut by Spark's own sample of the positions, however those
    are spread.  Rows are numbered inside their partition and shifted by the sizes of the
    partitions before it.  Only a partition's first group can have begun earlier, so the
    shifts are at most as many rows as partitions, which bounds their broadcast.
    """
    placed = materialise(df.repartitionByRange(*keys, pos).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*keys, "_part")
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("_size"))
        .withColumn("_shift", F.sum("_size").over(earlier))
        .filter(F.col("_shift").isNotNull())
        .select("_shift", *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_part"]])
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_part"]])
    inside = Window.partitionBy("_part", *keys).orderBy(pos)
    place = F.row_number().over(inside)
    if times:
        place = F.coalesce(F.sum(times).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return (
        placed.withColumn("_inside", place)
        .join(F.broadcast(shifts), same, "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_shift", F.lit(0)))
        .drop("_part", "_inside", "_shift", *[f"_of_{c}" for c in [*keys, "_part"]])
    )


def first_positions(df: DataFrame, keys: list[str], ident: str, pos: str) -> DataFrame:
    """Distinct ids of each group with the position of their first occurrence."""
    return df.groupBy(*keys, ident).agg(F.min(pos).alias(pos))


def chunked(ranked: DataFrame, keys: list[str], ident: str, size: int, rank: str = "rank") -> DataFrame:
    """Batches of at most ``size`` ids in order: (keys, chunk, ids)."""
    return (
        ranked.select(*keys, F.expr(f"({rank} - 1) div {size}").alias("chunk"), F.struct(rank, ident).alias("_item"))
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        .withColumn("ids", F.transform("_items", lambda i: i[ident]))
        .drop("_items")
    )


def service_uri(service: str, kind: str, ident):
    """``service:kind:id``."""
    return F.concat_ws(":", F.lit(service), F.lit(kind), ident)
