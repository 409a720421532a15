"""Hard negatives by an inverted multi-index.

Vectors become integers, ``floor(scale * x)``; a score is an integer inner product, so the same
everywhere.  An anchor's positives are its best rows of the same label; the negatives of a
positive are the best rows of other labels whose score lies in a window below its score.

1. Rows equal in label and vector are one entry with its few smallest ids; nothing beyond them
   can be in an answer.
2. Each half of the vectors has a codebook, fitted on a bounded sample (``SAMPLE`` rows taken
   by hash); every entry is put in the cell of its two nearest codewords.  Radii, the largest
   distances of entries from their codewords, are taken over all entries, of codewords and
   again of cells.
3. A half's score cannot exceed that of the codeword plus the anchor's length times the radius.
   A heap walks the pairs of codewords by the sum of both halves' bounds, greatest first
   (Babenko & Lempitsky 2012).  An anchor takes cells in that order, leaves out those whose own
   radii show that nothing in them can be wanted, and stops once each of its windows is
   certified: its last answer is better than the next bound, or the next bound lies below it.
   So the answers are exact; codebooks decide the work only.
4. Anchors are worked on together, in rounds of growing numbers of cells.  Asked cells meet
   their entries by a shuffle on (cell, block of entries, block of anchors), both blocks of
   bounded size, so a cell that holds much, or is asked by all, is worked on by many tasks.
   Rounds are written, and only a number that tells whether any anchor goes on is collected.

Defined results: rows whose id, label or vector is null, or that hold null or non-finite
components, take no part, nor do those with a component beyond 2^27 after scaling, as scores
could leave a long; vectors are compared with those of their own length; an empty vector scores
0; rows equal in id, label and vector are one, rows that share only the id are different rows;
ties go to smaller ids; an anchor without a positive gives no rows, a positive without a
negative none either; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship_package

SCALE = 256
LARGEST = 2**27
#: Rows by which codebooks are fitted, codewords of a half at most, entries a cell is to hold.
SAMPLE = 20_000
CODEWORDS = 256
CELL = 2048
#: Entries and anchors that meet in one group at most, about: each entry moves once for so many
#: anchors, each anchor once for every cell it asks for.
BLOCK_ENTRIES = 4096
BLOCK_ANCHORS = 2048
#: Anchors of a group that are compared at once, which bounds the table of scores.
SLICE = 256
#: Entries an anchor asks for in its first round; each further one asks for more.
FIRST_ROUND = 8192
GROWTH = 4
SEED = 13


# --------------------------------------------------------------------------- index
def _codebook(vectors: np.ndarray, size: int) -> np.ndarray:
    """Centres of ``vectors`` by a few rounds of k-means."""
    if not vectors.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(SEED)
    distinct = np.unique(vectors, axis=0)
    centres = distinct[rng.choice(len(distinct), min(size, len(distinct)), replace=False)]
    for _ in range(8):
        nearest = nearest_centre(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        count = np.bincount(nearest, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors), np.int64)
    for first in range(0, len(vectors), 8192):
        part = vectors[first : first + 8192]
        out[first : first + 8192] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
    return out


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = vectors.shape[1] // 2
    return vectors[:, :cut], vectors[:, cut:]


def codebooks(entries: DataFrame, sample: int = SAMPLE, most: int = CODEWORDS, cell: int = CELL) -> dict[int, tuple]:
    """Per vector length, the codebooks of both halves.

    Fitted on rows of the least hashes, ``sample`` over all lengths; a length that the sample
    does not hold has one codeword of zeros.
    """
    held = entries.select("v").withColumn("_h", F.xxhash64("v")).orderBy("_h").limit(sample).select("v").collect()
    by_length: dict[int, list] = {}
    for row in held:
        by_length.setdefault(len(row["v"]), []).append(row["v"])
    out = {}
    for row in entries.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect():
        dims, n = row["dims"], row["n"]
        told = by_length.get(dims) or [[0] * dims]
        vectors = np.array(told, np.float64).reshape(len(told), dims)
        size = int(min(most, max(1, round((n / cell) ** 0.5))))
        out[dims] = tuple(_codebook(h, size) for h in halves(vectors))
    return out


_CELLED = "entry bigint, dims int, u int, v_cell int, r1 double, r2 double"


def _celled(entries: DataFrame, books: dict[int, tuple]) -> DataFrame:
    """Each entry with its cell and its distances from the codewords."""
    held = entries.sparkSession.sparkContext.broadcast(books)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            numbers, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths, starts = pc.list_value_length(vectors).to_numpy(), vectors.offsets.to_numpy()
            parts = vectors.values.to_numpy()
            for dims in np.unique(lengths).tolist():
                places = np.flatnonzero(lengths == dims)
                both = halves(parts[starts[places][:, None] + np.arange(dims)].astype(np.float64))
                found, apart = [], []
                for half, centres in zip(both, held.value[dims], strict=True):
                    near = nearest_centre(half, centres)
                    found.append(near.astype(np.int32))
                    apart.append(np.sqrt(((half - centres[near]) ** 2).sum(1)))
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[places]), pa.array(np.full(n, dims, np.int32)), *[pa.array(x) for x in (*found, *apart)]],
                    names=["entry", "dims", "u", "v_cell", "r1", "r2"],
                )

    return entries.select("entry", "v").mapInArrow(batches, _CELLED)


class Walk:
    """Cells of one vector length, walked by an anchor from the greatest bound down."""

    def __init__(self, books: tuple, cells: np.ndarray):
        """``cells``: rows (u, v, entries, r1, r2) of the cells that hold anything."""
        self.books, self.cells = books, cells
        self.at = {(int(c[0]), int(c[1])): i for i, c in enumerate(cells)}
        self.radii = [np.full(len(b), -np.inf) for b in books]
        for half in (0, 1):
            np.maximum.at(self.radii[half], cells[:, half].astype(int), cells[:, 3 + half])

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, float, int]]:
        """(bound of this and all later cells, the cell's own bound, its least score, its number)."""
        bounds, orders, middles, lengths = [], [], [], []
        for half, centres, radii in zip(halves(anchor[None, :]), self.books, self.radii, strict=True):
            middle, length = centres @ half[0], np.sqrt((half[0] ** 2).sum())
            bound = middle + length * np.where(np.isfinite(radii), radii, 0.0)
            bound[~np.isfinite(radii)] = -np.inf  # codewords without entries
            order = np.argsort(-bound, kind="stable")
            order = order[np.isfinite(bound[order])]
            bounds.append(bound)
            orders.append(order)
            middles.append(middle)
            lengths.append(length)
        (first, second), (by_first, by_second) = orders, bounds
        if not len(first) or not len(second):
            return
        heap = [(-(by_first[first[0]] + by_second[second[0]]), 0, 0)]
        while heap:
            less, i, j = heappop(heap)
            if j + 1 < len(second):
                heappush(heap, (-(by_first[first[i]] + by_second[second[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heappush(heap, (-(by_first[first[i + 1]] + by_second[second[0]]), i + 1, 0))
            u, v = int(first[i]), int(second[j])
            number = self.at.get((u, v))
            if number is None:
                continue
            cell = self.cells[number]
            middle = middles[0][u] + middles[1][v]
            reach = lengths[0] * cell[3] + lengths[1] * cell[4]
            slack = 1 + 1e-9 * (abs(middle) + reach)  # rounding never cuts a cell off
            yield -less + slack, middle + reach + slack, middle - reach - slack, number


# --------------------------------------------------------------------------- search
class Index:
    """Entries in cells, written, with what an anchor's walk needs to know of them."""

    def __init__(self, entries: DataFrame, books: dict[int, tuple], block: int = BLOCK_ENTRIES):
        spark = entries.sparkSession
        celled = materialise(_celled(entries, books))
        cells = celled.groupBy("dims", "u", "v_cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")
        )
        found = cells.collect()  # at most the product of both codebooks for each length
        by_length: dict[int, list] = {}
        for c in sorted(found, key=lambda c: (c["dims"], c["u"], c["v_cell"])):
            by_length.setdefault(c["dims"], []).append((c["u"], c["v_cell"], c["n"], c["r1"], c["r2"]))
        self.walks = {d: Walk(books[d], np.array(rows, np.float64)) for d, rows in by_length.items()}
        self.held = spark.sparkContext.broadcast(self.walks)
        numbered = [(d, c[0], c[1], i, -(-c[2] // block)) for d, rows in by_length.items() for i, c in enumerate(rows)]
        self.numbers = spark.createDataFrame(numbered, "dims int, u int, v_cell int, cell int, blocks long")
        self.rows = materialise(
            celled.drop("r1", "r2")
            .join(F.broadcast(self.numbers), ["dims", "u", "v_cell"])
            .withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")))
            .select("dims", "cell", "block", "entry")
            .join(entries, "entry")
        )


def ask(walk: Walk, anchor: np.ndarray, taken: int, wanted: int, windows: list[tuple]) -> tuple[list[int], int]:
    """Next cells of an anchor after ``taken``, about ``wanted`` entries; none once it is certified.

    ``windows`` are (least, greatest, score of the last answer or None).
    """
    asked, size = [], 0
    for step, (bound, most, least, cell) in enumerate(walk.walk(anchor)):
        if step < taken:
            continue
        open_windows = [w for w in windows if bound >= w[0] and (w[2] is None or bound >= w[2])]
        if not open_windows:
            return asked, step
        if size >= wanted:
            return asked, step
        if any(most >= w[0] and least <= w[1] and (w[2] is None or most >= w[2]) for w in open_windows):
            asked.append(cell)
            size += int(walk.cells[cell, 2])
        taken = step + 1
    return asked, taken


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers, in doubles where these hold them exactly."""
    dims = max(a.shape[1], 1)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_in_windows(
    anchors: np.ndarray, anchor_labels: np.ndarray, windows: list, entries: np.ndarray, labels: np.ndarray, least_ids: np.ndarray, same: bool, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor the entries that can be among the k best of one of its windows, with scores.

    One more than k, as an anchor's own entry may bring nothing but itself.
    """
    of_label: dict[int, np.ndarray] = {}
    for first in range(0, len(windows), SLICE):
        scores = _exact(anchors[first : first + SLICE], entries)
        for i, mine in enumerate(windows[first : first + SLICE], first):
            label = int(anchor_labels[i])
            if label not in of_label:
                of_label[label] = np.flatnonzero((labels == label) == same)
            fits = of_label[label]
            held = scores[i - first][fits]
            wanted = np.zeros(len(fits), bool)
            for low, high, last in mine:
                at = np.flatnonzero((held >= max(low, last if last is not None else low)) & (held <= high))
                if len(at) > k + 1:
                    # what the last of them scores, then the smallest ids among those that tie there
                    least = np.partition(held[at], len(at) - k - 1)[len(at) - k - 1]
                    at = at[held[at] >= least]
                    at = at[np.lexsort((least_ids[fits[at]], -held[at]))[: k + 1]]
                wanted[at] = True
            yield i, fits[wanted], held[wanted]


_WINDOWS = "array<struct<w:int,low:bigint,high:bigint,last:bigint>>"
_REQUESTS = f"anchor bigint, dims int, cell int, taken bigint, v array<int>, label bigint, windows {_WINDOWS}"
_ANSWERS = "anchor bigint, entry bigint, score bigint"


def _rounds(index: Index, anchors: DataFrame, same: bool, k: int, ids: DataFrame, first_round: int, block: int) -> DataFrame:
    """(anchor, w, id, score, rank) of the k best of each window of each anchor, exact.

    ``anchors``: (anchor, id, entry, v, label, windows array<(w, low, high)>).
    """
    spark = anchors.sparkSession
    walks = index.held
    mine = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    spread = anchors.select("anchor", F.col("id").alias("own_id"), F.col("entry").alias("own_entry"), F.inline("windows"))
    spread = materialise(spread)
    best = spark.createDataFrame([], "anchor bigint, w int, id bigint, score bigint, rank int")
    best = best.select("anchor", "w", F.col("id").cast(ids.schema["id"].dataType).alias("id"), "score", "rank")
    taken = None
    wanted = first_round
    types = pa.schema(
        [
            ("anchor", pa.int64()), ("dims", pa.int32()), ("cell", pa.int32()), ("taken", pa.int64()), ("v", pa.list_(pa.int32())), ("label", pa.int64()),
            ("windows", pa.list_(pa.struct([("w", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("last", pa.int64())]))),
        ]
    )
    while True:
        last = best.filter(F.col("rank") == k).select("anchor", "w", F.col("score").alias("last"))
        state = (
            spread.join(last, ["anchor", "w"], "left")
            .groupBy("anchor")
            .agg(F.collect_list(F.struct("w", "low", "high", "last")).alias("windows"))
            .join(anchors.select("anchor", "v", "label"), "anchor")
        )
        state = state.join(taken, "anchor") if taken is not None else state.withColumn("taken", F.lit(0).cast("bigint"))

        def asked(rows: Iterator[pa.RecordBatch], wanted: int = wanted) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for r in batch.to_pylist():
                    walk = walks.value.get(len(r["v"]))
                    if walk is None:
                        continue
                    told = [(w["low"], w["high"], w["last"]) for w in r["windows"]]
                    cells, done = ask(walk, np.array(r["v"], np.float64), r["taken"], wanted, told)
                    columns = [(r["anchor"], len(r["v"]), c, done, r["v"], r["label"], r["windows"]) for c in cells]
                    if columns:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), types.types, strict=True)], schema=types)

        requests = materialise(state.select("anchor", "v", "label", "windows", "taken").mapInArrow(asked, _REQUESTS))
        if requests.isEmpty():
            return best
        taken = requests.select("anchor", "taken").distinct()
        # blocks of anchors for each cell, by how many ask for it
        asking = requests.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"))
        asking = F.broadcast(asking.select("dims", "cell", F.ceil(F.col("n") / block).alias("groups")))
        told = (
            requests.drop("taken")
            .join(asking, ["dims", "cell"])
            .join(F.broadcast(index.numbers.select("dims", "cell", "blocks")), ["dims", "cell"])
            .withColumn("group", F.pmod(F.xxhash64("anchor"), F.col("groups")))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .select("dims", "cell", "block", "group", "anchor", F.lit(None).cast("bigint").alias("entry"), "v", "label", "windows", F.lit(None).cast("bigint").alias("least"))
        )
        held = (
            index.rows.join(asking, ["dims", "cell"])
            .withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
            .select(
                "dims", "cell", "block", "group", F.lit(None).cast("bigint").alias("anchor"), "entry", F.col("v").cast("array<int>").alias("v"), "label",
                F.lit(None).cast(_WINDOWS).alias("windows"), F.col("ids")[0].cast("bigint").alias("least"),
            )
        )

        def compared(table: pa.Table) -> pa.Table:
            dims = table.column("dims")[0].as_py()
            is_anchor = pc.is_valid(table.column("anchor"))
            askers, rest = table.filter(is_anchor), table.filter(pc.invert(is_anchor))

            def vectors(rows: pa.Table) -> np.ndarray:
                return rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dims)

            numbers, entry, least = askers.column("anchor").to_numpy(), rest.column("entry").to_numpy(), rest.column("least").to_numpy()
            labels = askers.column("label").to_numpy(), rest.column("label").to_numpy()
            windows = [[(w["low"], w["high"], w["last"]) for w in r] for r in askers.column("windows").to_pylist()]
            out: tuple[list, list, list] = ([], [], [])
            if len(entry) and len(numbers):
                found = best_in_windows(vectors(askers), labels[0], windows, vectors(rest), labels[1], least, same, k)
                for i, at, scores in found:
                    out[0].append(np.full(len(at), numbers[i]))
                    out[1].append(entry[at])
                    out[2].append(scores)
            columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
            return pa.table([pa.array(c) for c in columns], names=["anchor", "entry", "score"])

        new = told.unionByName(held).groupBy("dims", "cell", "block", "group").applyInArrow(compared, _ANSWERS)
        better = (
            new.join(ids, "entry")
            .join(spread, "anchor")
            .filter((F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high")))
            .filter((F.col("id") != F.col("own_id")) | (F.col("entry") != F.col("own_entry")))
            .select("anchor", "w", "id", "score")
            .unionByName(best.drop("rank"))
            .withColumn("rank", F.row_number().over(mine))
            .filter(F.col("rank") <= k)
        )
        best = materialise(better)
        wanted *= GROWTH


def valid(embeddings: DataFrame, ident: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part, as integers."""
    raw = embeddings.select(F.col(ident).alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    sound = raw.filter("id is not null and label is not null and x is not null").filter(
        F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * scale)) <= LARGEST) & (F.abs(x) <= LARGEST))
    )
    return sound.select("id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def _floor_div(value: Column, by: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    first_round: int = FIRST_ROUND,
    cell: int = CELL,
    block_entries: int = BLOCK_ENTRIES,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (id, label, v) as of ``valid``; anchors those for which ``is_anchor(id)`` holds.
    """
    ship_package(rows.sparkSession)
    keep = max(positives + 1, negatives)
    order = Window.partitionBy("label", "v").orderBy("id")
    entries = materialise(
        rows.withColumn("_n", F.dense_rank().over(order))
        .filter(F.col("_n") <= keep)
        .groupBy("label", "v")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .withColumn("entry", F.monotonically_increasing_id())
    )
    asking = rows.filter(is_anchor(F.col("id"))).distinct().join(entries.select("label", "v", "entry"), ["label", "v"])
    asking = materialise(asking.withColumn("anchor", F.monotonically_increasing_id()))
    books = codebooks(entries, cell=cell)
    if not books:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return rows.sparkSession.createDataFrame([], empty)
    index = Index(entries.select("entry", "v", "label", "ids"), books, block_entries)
    ids = materialise(entries.select("entry", F.explode("ids").alias("id")))

    def windows(*bounds: Column) -> Column:
        return F.struct(bounds[0].cast("int").alias("w"), bounds[1].cast("bigint").alias("low"), bounds[2].cast("bigint").alias("high"))

    whole = F.array(windows(F.lit(0), F.lit(-(2**62)), F.lit(2**62)))
    found = _rounds(index, asking.withColumn("windows", whole), True, positives, ids, first_round, block_anchors)
    low = -_floor_div(-low_percent * F.col("score"), 100)
    high = _floor_div(high_percent * F.col("score"), 100)
    chosen = found.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), windows(F.col("rank"), low, high).alias("window"))
    chosen = materialise(chosen)
    wanted = asking.join(
        chosen.filter("window.low <= window.high").groupBy("anchor").agg(F.sort_array(F.collect_list("window")).alias("windows")), "anchor"
    )
    mined = _rounds(index, materialise(wanted), False, negatives, ids, first_round, block_anchors)
    return (
        mined.withColumnRenamed("id", "negative_id")
        .withColumnRenamed("score", "negative_score")
        .join(chosen.drop("window"), ["anchor", "w"])
        .join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
