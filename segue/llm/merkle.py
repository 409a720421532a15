"""Merkle manifest of a dataset by time-forward processing.

A leaf is the SHA-256 of a row's fields, each ``-`` where null, else its UTF-8 byte count, a
colon and the value.  The leaves of a group, in order, form a tree: 16 consecutive nodes become
their digest until one is left.  The digests left of all groups form one more tree, whose top
is the root.  Digests enter other digests as lower-case hexadecimal text.

A node's label is (place of the last leaf below it, its level), so ordering by label puts
children before parents.  Nodes are worked off in that order: a priority queue holds the
digests sent to parents not yet reached, and a parent takes all that is addressed to it when
its label comes up.  In this order the queue holds at most 16 digests for each level.  The
reversed sweep goes through the same labels from the top down; here the queue holds proof
suffixes sent to children, and each leaf receives its whole proof.

Across tasks, Spark's sorted shuffle is the queue: a tree is cut into blocks of 16^3 nodes, a
block's sweep is one stretch of a task, and its top is a message to the next pass, which has a
4096th of the rows.  No group, however large, meets in one task, and every pass is written, so
a lost executor costs one pass at most.

Defined results: every field may be null; a null group is a group of its own and comes first,
as do null ids; rows of one id are ordered by their leaves, and equal rows are leaves of their
own; texts of any length are hashed whole in the JVM; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_by_position
from ..session import materialise, ship_package

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Levels worked off in one pass; a block has FAN ** SPAN nodes at most.
SPAN = 3
BLOCK = FAN**SPAN
HEX = 64
BATCH = 2000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields, in their order."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[told(c) for c in fields.values()]), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes of which one pass works off SPAN at most."""
    levels = 0
    while levels < SPAN and FAN**levels < n:
        levels += 1
    return levels


def sweep_up(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of each block: (grp, block, n, level, last, digest, children).

    ``rows`` are (grp, block, pos, n, digest), sorted by the first three.  A tree of one node
    gives that node itself, at level 0.
    """
    for (grp, block), members in groupby(rows, key=lambda r: r[:2]):
        queue: list[tuple[int, int, int, str]] = []
        for _, _, pos, n, own in members:
            top = height(n)
            if not top:
                yield grp, block, n, 0, pos, own, None
                continue

            def send(level: int, index: int, value: str, n: int = n) -> None:
                width = FAN ** (level + 1)
                last = min((index // FAN + 1) * width, n) - 1
                heappush(queue, (last, level + 1, index % FAN, value))

            send(0, pos, own)
            while queue and queue[0][0] == pos:
                last, level = queue[0][:2]
                children = ""
                while queue and queue[0][:2] == (last, level):
                    children += heappop(queue)[3]
                value = digest(children)
                yield grp, block, n, level, last, value, children
                if level < top:
                    send(level, last // FAN**level, value)


def sweep_down(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What reaches each node of level 0: (grp, last, row, claimed, proof, shape).

    ``rows`` are (grp, block, last, level, children, row, claimed, proof, shape): of each block
    first the message to its top, then its nodes by label, from the last to the first.  ``proof``
    holds the siblings of all levels, ``shape`` their number and the own place at each level.
    """
    for (grp, _), members in groupby(rows, key=lambda r: r[:2]):
        message = next(members)
        queue: list[tuple[int, int, str, list[int]]] = []
        for _, _, last, level, children, row, claimed, _, _ in members:
            if message:
                heappush(queue, (-last, -level, message[7], message[8]))
                message = None
            _, _, proof, shape = heappop(queue)
            if not level:
                yield grp, last, row, claimed, proof, shape
                continue
            width = FAN ** (level - 1)
            first = last // FAN**level * FAN
            for place in range(len(children) // HEX):
                below = min((first + place + 1) * width - 1, last)
                siblings = children[: place * HEX] + children[(place + 1) * HEX :]
                heappush(queue, (-below, 1 - level, siblings + proof, [len(siblings) // HEX, place, *shape]))


def fold(own: str, proof: str, shape: list[int]) -> str:
    """The root that a digest and its proof lead to."""
    at = 0
    for count, place in zip(shape[0::2], shape[1::2], strict=True):
        cut, end = at + place * HEX, at + count * HEX
        own = digest(proof[at:cut] + own + proof[cut:end])
        at = end
    return own


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


_NODES = "grp string, block bigint, n bigint, level int, last bigint, digest string, children string"
_NODE_TYPES = pa.schema(
    [("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("last", pa.int64()), ("digest", pa.string()), ("children", pa.string())]
)
_PATHS = "grp string, block bigint, proof string, shape array<int>"
_PATH_TYPES = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("proof", pa.string()), ("shape", pa.list_(pa.int32()))])
_CHECKED = "row bigint, proof_sha256 string, folded_root string"
_CHECKED_TYPES = pa.schema([("row", pa.int64()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def build(members: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Trees over ``members`` (grp, pos, n, digest, ...), pos from 0 in a group of n.

    Returns the tops (grp, digest) and, for each pass, its level-0 nodes and the nodes above.
    """
    passes = []
    while True:
        rows = members.select("grp", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest")

        def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batched(sweep_up(_streamed(batches)), _NODE_TYPES)

        nodes = materialise(
            rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(swept, _NODES)
        )
        passes.append((members, nodes.filter("level > 0")))
        levels = sum((F.col("n") > FAN**k).cast("int") for k in range(SPAN))
        tops = nodes.filter(F.col("level") == levels).select(
            "grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "digest"
        )
        if not (tops.agg(F.max("n")).first()[0] or 1) > 1:
            return tops.select("grp", "digest"), passes
        members = tops


def _down(paths: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sorted rows of a reversed sweep: messages to the blocks' tops, nodes, level 0."""
    none = F.lit(None)
    held = "row" in members.columns

    def columns(kind, block, last, level, children=none, row=none, claimed=none, proof=none, shape=none):
        return [
            F.col("grp"), F.expr(block).alias("block"), F.expr(last).cast("bigint").alias("last"), F.expr(level).alias("level"),
            children.cast("string").alias("children"), row.cast("bigint").alias("row"), claimed.cast("string").alias("claimed"),
            proof.cast("string").alias("proof"), shape.cast("array<int>").alias("shape"), F.lit(kind).alias("kind"),
        ]

    messages = paths.select(*columns(0, "block", "null", "0", proof=F.col("proof"), shape=F.col("shape")))
    inner = nodes.select(*columns(1, "block", "last", "level", children=F.col("children")))
    own = {"row": F.col("row"), "claimed": F.col("claimed")} if held else {}
    outer = members.select(*columns(1, f"pos div {BLOCK}", "pos", "0", **own))
    return (
        messages.unionByName(inner)
        .unionByName(outer)
        .repartition("grp", "block")
        .sortWithinPartitions("grp", "block", "kind", F.desc("last"), F.desc("level"))
        .drop("kind")
    )


def suffixes(paths: DataFrame, passes: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(grp, block, proof, shape) of the level-0 nodes of the last of ``passes``, which go from the top down."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sweep_down(_streamed(batches))
        yield from _batched(((grp, pos, proof, shape) for grp, pos, _, _, proof, shape in found), _PATH_TYPES)

    for members, nodes in passes:
        paths = materialise(_down(paths, members, nodes).mapInArrow(swept, _PATHS))
    return paths


def check(paths: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, proof_sha256, folded_root) of every leaf, folded from what it claims to be."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sweep_down(_streamed(batches))
        yield from _batched(
            ((row, digest(proof), fold(claimed, proof, shape)) for _, _, row, claimed, proof, shape in found), _CHECKED_TYPES
        )

    return _down(paths, members, nodes).mapInArrow(swept, _CHECKED)


def manifest(
    docs: DataFrame,
    group: str = "source",
    ident: str = "doc_id",
    fields: tuple[str, ...] = FIELDS,
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """(ident, group, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    ``changed`` gives values of fields as they are found at checking; a row whose fields are
    not as they were folds to another root and is not verified.
    """
    spark = docs.sparkSession
    ship_package(spark)
    as_built = {f: F.col(f) for f in fields}
    as_found = as_built | (changed or {})
    # numbers given once and written, so that equal rows keep their places
    base = materialise(
        docs.select(
            F.col(ident).alias("id"),
            F.col(group).cast("string").alias("grp"),
            leaf(as_built).alias("digest"),
            leaf(as_found).alias("claimed"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    placed = rank_by_position(base.select("grp", "row", "claimed", F.struct("id", "digest", "row").alias("at")), ["grp"], "at", "pos")
    placed = materialise(placed.select("grp", "row", "claimed", F.col("at.digest").alias("digest"), (F.col("pos") - 1).alias("pos")))
    sizes = materialise(placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    members = placed.join(sizes.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    members = materialise(members)

    subroots, passes = build(members)
    tops = rank_by_position(subroots.select(F.col("grp").alias("name"), "digest", F.lit("").alias("grp")).withColumn("at", F.struct("name")), ["grp"], "at", "pos")
    tops = materialise(tops.select("grp", "name", "digest", (F.col("pos") - 1).alias("pos")))
    n_groups = tops.count()
    roots, upper = build(tops.select("grp", "pos", F.lit(n_groups).cast("bigint").alias("n"), "digest"))
    found = roots.first()
    root = F.lit(found["digest"] if found else None).cast("string")

    start = spark.createDataFrame([("", 0, "", [])], _PATHS) if found else spark.createDataFrame([], _PATHS)
    named = suffixes(start, upper[::-1]).withColumnRenamed("block", "pos").drop("grp").join(tops.select("pos", "name"), "pos")
    paths = named.select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("block"), "proof", "shape")
    checked = check(suffixes(paths, passes[:0:-1]), *passes[0])
    return (
        base.join(checked, "row")
        .join(tops.select(F.col("name").alias("of"), F.col("digest").alias("subroot")), F.col("grp").eqNullSafe(F.col("of")))
        .select(
            F.col("id").alias(ident),
            F.col("grp").alias(group),
            F.col("digest").alias("leaf"),
            "subroot",
            root.alias("root"),
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == root).alias("verified"),
        )
    )
