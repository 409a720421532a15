"""Approximate nearest neighbours by shifted space-filling curves.

1. Equal vectors are one entry with its few smallest ids, so a vector that very many rows
   hold is one point, and ties among them are exact.
2. Every curve projects the directions of all vectors on a few random axes, shifts them at
   random, cuts them into a grid and orders the cells along a Hilbert curve.  The entries of
   all curves are range-partitioned by (curve, key) in one sort, which gives each its place;
   ``window`` neighbouring places are a window.
3. A query is compared with all entries of its own window and of the two beside it, on every
   curve; the best of each are merged, scored again in double precision on the original
   vectors, and ranked.

4. Recall is measured: a bounded number of queries is compared with all entries, in blocks, and
   curves are doubled until so many of their answers are found.  More curves cost more passes,
   never more memory, as windows stay as they are.

Every vector is on every curve.  The axes are random and fitted to nothing.  Ties at the last
rank go to the smaller id among what is found.

Defined results: vectors that are null, zero, empty or hold null or non-finite components
take no part, nor do rows whose id is null; vectors are compared with those of their own
length; rows equal in id and vector are one; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship_package

CURVES = 16
AXES = 8
BITS = 7
WINDOW = 1024
SEED = 11
#: Entries whose answers are compared with brute force, and the share of these to be found.
TRIAL = 64
RECALL = 0.95


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve of each row of cell numbers below 2**bits (Skilling 2004)."""
    x = cells.T.astype(np.uint64)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        at = one << np.uint64(level)
        low = at - one
        for axis in x:
            on = (axis & at) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ axis) & low)
            flip = np.where(on, low, np.uint64(0))
            axis ^= swap
            x[0] ^= swap | flip
    x = np.bitwise_xor.accumulate(x, axis=0)
    undo = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        at = one << np.uint64(level)
        undo = np.where((x[-1] & at) != 0, undo ^ (at - one), undo)
    x ^= undo
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(level)) & one)
    return key.view(np.int64)


def curve_keys(vectors: np.ndarray, curve: int, axes: int = AXES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of one curve: its own axes, its own shift."""
    dims = vectors.shape[1]
    rng = np.random.default_rng([seed, curve, dims])
    seen = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ rng.normal(size=(dims, axes))
    # directions on a random axis are about standard normal; four deviations fit the grid
    place = (np.clip(seen / 8 + 0.5, 0, 1) + rng.uniform(0, 1, axes)) / 2
    return hilbert_keys(np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def valid(embeddings: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    return (
        embeddings.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter("id is not null and v is not null")
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .filter(F.exists(v, lambda x: x != 0))
    )


_LINE = ["curve", "dims"]
_FOUND = "asking bigint, entry bigint, score double"


def sorted_lines(vectors: DataFrame, first: int, last: int) -> DataFrame:
    """(curve, dims, entry, place) of all entries on the curves from ``first`` to before ``last``."""
    spark = vectors.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, held_vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(held_vectors):
                by_length.setdefault(len(v), []).append(i)
            for dims, places in sorted(by_length.items()):
                held = np.array([held_vectors[i] for i in places])
                for curve in range(first, last):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(places), curve, np.int32)),
                            pa.array(np.full(len(places), dims, np.int32)),
                            pa.array(curve_keys(held, curve)),
                            pa.array(numbers[places]),
                        ],
                        names=["curve", "dims", "key", "entry"],
                    )

    keys = vectors.select("entry", "v").mapInArrow(keyed, "curve int, dims int, key bigint, entry bigint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = materialise(
        keys.repartitionByRange(n, *_LINE, "key", "entry")
        .sortWithinPartitions(*_LINE, "key", "entry")
        # consecutive in a partition; its number is in the upper bits
        .select(*_LINE, "entry", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    )
    # as many rows as partitions and curves together at most
    before = Window.partitionBy(*_LINE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sorted_rows.groupBy(*_LINE, "part")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
        .withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .drop("size")
    )
    return sorted_rows.join(F.broadcast(starts), [*_LINE, "part"]).select(*_LINE, "entry", (F.col("at") - F.col("first") + F.col("shift")).alias("place"))


def best_of(asking: np.ndarray, candidates: np.ndarray, least: np.ndarray, near: int) -> tuple[np.ndarray, ...]:
    """(row of asking, row of candidates, score) of the ``near`` best; equal scores go by ``least``.

    A quick product tells what can be among them, with all that is about as good as the last;
    their scores are then computed row by row, so that a pair has one score wherever it meets.
    """
    size_a, size_c = np.sqrt((asking * asking).sum(axis=1)), np.sqrt((candidates * candidates).sum(axis=1))
    rough = (asking / size_a[:, None]) @ (candidates / size_c[:, None]).T
    keep = min(near, len(candidates))
    bound = np.partition(rough, len(candidates) - keep, axis=1)[:, len(candidates) - keep] - 1e-9
    q, c = np.nonzero(rough >= bound[:, None])
    scores = np.empty(len(q))
    for first in range(0, len(q), 65_536):
        i, j = q[first : first + 65_536], c[first : first + 65_536]
        scores[first : first + 65_536] = (asking[i] * candidates[j]).sum(axis=1) / (size_a[i] * size_c[j])
    order = np.lexsort((least[c], -scores, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    order = order[place < near]
    return q[order], c[order], scores[order]


def probe(vectors: DataFrame, lines: DataFrame, asking: DataFrame, window: int, near: int) -> DataFrame:
    """(asking, entry, score): what each asking entry finds in its windows and those beside them."""
    windows = (
        lines.withColumn("window", F.expr(f"place div {window}L"))
        .select(*_LINE, "window", "entry")
        .join(vectors, "entry")
        .join(asking.select("entry").withColumn("asks", F.lit(True)), "entry", "left")
    )
    # an entry is told in its own window; a query asks there and in those beside
    told = windows.select(
        *_LINE,
        F.explode(
            F.when(F.col("asks"), F.sequence(F.col("window") - 1, F.col("window") + 1)).otherwise(F.array("window"))
        ).alias("in"),
        "window",
        "entry",
        "v",
        "least",
        F.coalesce("asks", F.lit(False)).alias("asks"),
    )

    def compared(table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        held = flat.reshape(table.num_rows, -1)
        entry, least = table.column("entry").to_numpy(), table.column("least").to_numpy()
        inside = table.column("in").to_numpy() == table.column("window").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        candidates, asked = np.flatnonzero(inside), np.flatnonzero(asks)
        out = ([], [], [])
        if len(candidates) and len(asked):
            q, c, scores = best_of(held[asked], held[candidates], least[candidates], near)
            out = (entry[asked[q]], entry[candidates[c]], scores)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["asking", "entry", "score"])

    return told.groupBy(*_LINE, "in").applyInArrow(compared, _FOUND)


def brute_force(vectors: DataFrame, asking: DataFrame, near: int) -> DataFrame:
    """(asking, entry, score): the ``near`` best of all entries, block by block, for a bounded ``asking``."""
    by_length: dict[int, list] = {}
    for row in vectors.join(asking, "entry").select("entry", "v").collect():  # TRIAL rows at most
        by_length.setdefault(len(row["v"]), []).append(row)
    held = vectors.sparkSession.sparkContext.broadcast(
        {d: (np.array([r["entry"] for r in rows]), np.array([r["v"] for r in rows], float)) for d, rows in by_length.items()}
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            entry, least, all_vectors = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
            for dims, (numbers, asked) in held.value.items():
                places = np.array([i for i, v in enumerate(all_vectors) if len(v) == dims], np.int64)
                if len(places):
                    q, c, scores = best_of(asked, np.array([all_vectors[i] for i in places], float), least[places], near)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(entry[places[c]]), pa.array(scores)], names=["asking", "entry", "score"])

    best = Window.partitionBy("asking").orderBy(F.desc("score"), "least")
    found = vectors.select("entry", "v", "least").mapInArrow(batches, _FOUND)
    return found.join(vectors.select("entry", "least"), "entry").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= near).drop("_n", "least")


def measured(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers that were found."""
    seen = found.select("asking", "entry", F.lit(1).alias("seen")).distinct()
    row = exact.join(seen, ["asking", "entry"], "left").agg(F.count("seen").alias("n"), F.count(F.lit(1)).alias("all")).first()
    return row["n"] / row["all"] if row["all"] else 1.0


def nearest(
    embeddings: DataFrame,
    is_query,
    k: int = 5,
    ident: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which ``is_query(id)`` holds.

    Starts with ``curves`` curves and doubles them until the measured recall reaches ``recall``.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = valid(embeddings, ident, vector)
    # at most k + 1 ids of a vector can be in an answer; the window keeps them map-side
    order = Window.partitionBy("v").orderBy("id")
    entries = materialise(
        rows.withColumn("_n", F.dense_rank().over(order))
        .filter(F.col("_n") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .withColumn("entry", F.monotonically_increasing_id())
    )
    queries = materialise(rows.filter(is_query(F.col("id"))).distinct().join(entries.select("v", "entry"), "v").select("id", "entry"))

    near = k + 1
    vectors = materialise(entries.select("entry", "v", F.col("ids")[0].cast("bigint").alias("least")))
    lines = [sorted_lines(vectors, 0, curves)]
    trial = materialise(queries.select("entry").distinct().orderBy(F.xxhash64("entry")).limit(TRIAL))
    n_entries, n_trial = vectors.count(), trial.count()
    if n_trial:
        exact = materialise(brute_force(vectors, trial, near))
        found = materialise(probe(vectors, lines[0], trial, window, near))
        # as soon as windows could cover the table several times, more curves bring nothing
        while measured(found, exact) < recall and 3 * window * curves < 8 * n_entries:
            lines.append(sorted_lines(vectors, curves, 2 * curves))
            curves *= 2
            found = materialise(found.unionByName(probe(vectors, lines[-1], trial, window, near)).distinct())
    asking = queries.select("entry").distinct()
    found = probe(vectors, lines[0], asking, window, near)
    for more in lines[1:]:
        found = found.unionByName(probe(vectors, more, asking, window, near))
    lead = Window.partitionBy("asking").orderBy(F.desc("score"), "id")
    answers = (
        found.distinct()
        .join(entries.select("entry", "ids"), "entry")
        .select("asking", "score", F.explode("ids").alias("id"))
        .withColumn("_n", F.row_number().over(lead))
        .filter(F.col("_n") <= near)
        .select("asking", "id", "score")
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        queries.select(F.col("id").alias("query_id"), F.col("entry").alias("asking"))
        .join(answers, "asking")
        .filter("id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
