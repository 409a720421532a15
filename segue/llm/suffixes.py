"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too.

1. Which suffixes can matter.  Every window of ``length`` bytes has one anchor: the least
   hash among the runs of ``GRAM`` bytes inside it, the leftmost of equal ones.  Equal windows
   have it at the same offset, so a repeated window has a repeated anchor.  An anchor answers
   for a stretch of successive windows, and its stretch of text is its context.
2. Anchors meet by hash, as hashes only.  One that occurs once is done.  Where a whole context
   occurs twice, all its windows do.  What is left are repeated anchors in differing contexts,
   at the ends of repeats.
3. Those contexts are sorted as suffixes that begin at the anchor.  Every task sorts its own,
   front-codes them (bytes shared with the one before, and the rest) and sends one run to each
   bucket.  A bucket merges its runs by a loser tree that carries common prefixes along and
   compares only bytes behind them.  Neighbours that share ``GRAM`` bytes or more are one
   anchor; among them, windows that occur twice are found.
4. The covered bytes of every text are cut out.

Texts are judged whole and as they came.  Hashes are 64 bits wide; contexts are compared by
them, windows of differing contexts as well.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; rows
equal in id and text are two texts and so repeat each other; a null doc_id is kept as it is;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise, ship_package
from .words import mixed

LENGTH = 200
GRAM = 64
#: Bytes worked on at a time; places in them fit PLACE_BITS.
RUN_BYTES = 3_000_000
CHUNK_BYTES = 8_000_000
PLACE_BITS = 24
#: Contexts merged in one task.
BUCKET_CONTEXTS = 20_000
#: Texts asked for contexts that may be broadcast; more meet the texts by a shuffle.
BROADCAST_ROWS = 100_000
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Stretches:
    """Hashes of any stretch of a run of bytes."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(22, int(len(data)).bit_length())
        self.up, down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # brought to one power: multiplying by the base to the start undoes the place
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values, by doubling."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of several texts: (text, place, offset, size, gram hash, context hash).

    The context starts ``offset`` bytes before the place and is ``size`` bytes long.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    stretch = Stretches(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = stretch.hashes(at, at + GRAM)
    key = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    least = sliding_least(key, length - GRAM + 1)
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[text])
    if not len(starts):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = text[starts]
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    first = starts[new]
    last = starts[np.append(new[1:], len(starts)) - 1]
    text, place = text[new], place[new]
    context = stretch.hashes(first, last + length) + mixed((place - first).astype(np.uint64))
    begin = ends[text] - np.array([len(t) for t in texts])[text]
    return text, place - begin, place - first, last + length - first, gram[place], context


def _chunks(texts: list[str | None], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Bytes in runs of bounded size: (row, place in its text, bytes); a long text in chunks whose windows add up."""
    rows, places, run, size = [], [], [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        for begin in range(0, max(1, len(raw) - length + 1), CHUNK_BYTES):
            rows.append(row)
            places.append(begin)
            run.append(raw[begin : begin + CHUNK_BYTES + length - 1])
            size += len(run[-1])
            if size > RUN_BYTES:
                yield rows, places, run
                rows, places, run, size = [], [], [], 0
    if run:
        yield rows, places, run


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text): rows equal in id and text share a key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("key"), text.alias("text"))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "place", "lead", "size", "gram", "context"]
        for batch in rows:
            keys = batch.column(0).to_numpy()
            for row, begin, run in _chunks(batch.column(1).to_pylist(), length):
                text, place, offset, size, gram, context = anchors(run, length)
                columns = [
                    keys[np.array(row)[text]],
                    place + np.array(begin)[text],
                    offset,
                    size,
                    gram.view(np.int64),
                    context.view(np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return keyed(docs).mapInArrow(batches, "key bigint, place bigint, lead bigint, size bigint, gram bigint, context bigint")


# ------------------------------------------------------------------------------ sorted runs
def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes both begin with, of which ``known`` are known."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end  # equal up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_coded(suffixes: list[bytes]) -> list[tuple[int, bytes]]:
    """Sorted suffixes as (bytes shared with the one before, the rest)."""
    coded, before = [], b""
    for s in suffixes:
        shared = common_prefix(before, s)
        coded.append((shared, s[shared:]))
        before = s
    return coded


def front_decoded(coded: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(bytes shared with the one before, suffix)."""
    before = b""
    for shared, rest in coded:
        before = before[:shared] + rest
        yield shared, before


class LoserTree:
    """Merges front-coded sorted runs; every entry knows the prefix it shares with the last output.

    Of two entries the one that shares more with the last output is less.  Only where they
    share equally many bytes are the bytes behind compared, and what is found is kept by the
    loser, who is then compared with the winner as the last output.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.entry: list[tuple[int, bytes] | None] = [None] * self.size
        for i, run in enumerate(self.runs):
            first = next(run, None)
            self.entry[i] = first and (0, first[1])
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.loser[node] = self._play(a, b)
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.entry[a], self.entry[b]
        if y is None or x is None:
            return (a, b) if y is None else (b, a)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        shared = common_prefix(x[1], y[1], x[0])
        less = x[1][shared : shared + 1] <= y[1][shared : shared + 1]
        winner, loser = (a, b) if less else (b, a)
        self.entry[loser] = (shared, self.entry[loser][1])
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(run, bytes shared with the one before, suffix) in order."""
        while self.entry[self.winner] is not None:
            run = self.winner
            yield run, *self.entry[run]
            self.entry[run] = next(self.runs[run], None) if run < len(self.runs) else None
            node, winner = (run + self.size) // 2, run
            while node:
                winner, self.loser[node] = self._play(winner, self.loser[node])
                node //= 2
            self.winner = winner


# ------------------------------------------------------------------------------ repeats among contexts
def repeated_windows(contexts: list[tuple[bytes, int]], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For each (context, place of the anchor in it), the bytes covered by windows that another has too."""
    if len(contexts) == 2:
        (a, p), (b, q) = contexts
        left = common_prefix(a[:p][::-1], b[:q][::-1])
        right = common_prefix(a[p:], b[q:])
        return [(p - left, p + right), (q - left, q + right)] if left + right >= length else [None, None]
    # windows of an anchor are told apart by where it is in them and by their bytes
    hashes = [np.fromiter((hash(c[s : s + length]) for s in range(len(c) - length + 1)), np.int64) for c, _ in contexts]
    offset = [p - np.arange(len(h)) for (_, p), h in zip(contexts, hashes, strict=True)]
    both = np.concatenate(hashes) * np.int64(1009) + np.concatenate(offset)
    _, place, times = np.unique(both, return_inverse=True, return_counts=True)
    twice = np.split(times[place] > 1, np.cumsum([len(h) for h in hashes])[:-1])
    found = []
    for t in twice:
        at = np.flatnonzero(t)
        found.append((int(at[0]), int(at[-1]) + length) if len(at) else None)
    return found


def _merged(table: pa.Table, length: int) -> pa.Table:
    """Covered bytes of the contexts of one bucket, from its front-coded runs."""
    runs, details = [], []
    for row in table.select(["shared", "rest", "key", "place", "left"]).to_pylist():
        runs.append(front_decoded(list(zip(row["shared"], row["rest"], strict=True))))
        details.append(iter(zip(row["key"], row["place"], row["left"], strict=True)))
    out, group = ([], [], []), []

    def close() -> None:
        if len(group) > 1:
            spans = repeated_windows([(left + right, len(left)) for (_, _, left), right in group], length)
            for ((key, place, left), _), span in zip(group, spans, strict=True):
                if span:
                    for column, value in zip(out, (key, place - len(left) + span[0], place - len(left) + span[1]), strict=True):
                        column.append(value)

    for run, shared, suffix in LoserTree(runs):
        if shared < GRAM:
            close()
            group = []
        group.append((next(details[run]), suffix))
    close()
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["key", "start", "end"])


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): bytes covered by strings that also start elsewhere; spans may overlap."""
    gram, context = Window.partitionBy("gram"), Window.partitionBy("gram", "context")
    met = materialise(
        _anchor_rows(docs, length)
        .select(
            "*",
            F.count(F.lit(1)).over(gram).alias("times"),
            (F.min("context").over(gram) < F.max("context").over(gram)).alias("differs"),
        )
        .filter("times > 1")
        .withColumn("same", F.count(F.lit(1)).over(context))
        .withColumn("nth", F.row_number().over(context.orderBy("key", "place")))
        .drop("times", "context")
    )
    whole = met.filter("same > 1").select("key", (F.col("place") - F.col("lead")).alias("start"), (F.col("place") - F.col("lead") + F.col("size")).alias("end"))
    ends = met.filter("differs and nth = 1")
    buckets = max(1, -(-ends.count() // BUCKET_CONTEXTS))
    asked = materialise(ends.groupBy("key").agg(F.collect_set(F.struct("gram", "place", "lead", "size")).alias("asks")))
    run = pa.schema(
        [("bucket", pa.int64()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("key", pa.list_(pa.int64())), ("place", pa.list_(pa.int64())), ("left", pa.list_(pa.binary()))]
    )

    def sorted_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            runs = []
            for bucket, found in sorted(held.items()):
                found.sort()
                coded = front_coded([f[0] for f in found])
                runs.append(
                    {"bucket": bucket, "shared": [c[0] for c in coded], "rest": [c[1] for c in coded], "key": [f[1] for f in found], "place": [f[2] for f in found], "left": [f[3] for f in found]}
                )
            held.clear()
            return pa.RecordBatch.from_pylist(runs, run)

        for batch in rows:
            for key, text, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for a in asks:
                    start, place = a["place"] - a["lead"], a["place"]
                    suffix = raw[place : start + a["size"]]
                    held.setdefault(a["gram"] % buckets, []).append((suffix, key, place, raw[start:place]))
                    size += a["size"]
                if size > 32_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    runs = (
        keyed(docs).join(broadcast_if_small(asked, BROADCAST_ROWS), "key")
        .select("key", "text", "asks")
        .mapInArrow(sorted_runs, "bucket bigint, shared array<int>, rest array<binary>, key array<bigint>, place array<bigint>, left array<binary>")
    )
    partly = runs.groupBy("bucket").applyInArrow(lambda t: _merged(t, length), "key bigint, start bigint, end bigint")
    return materialise(whole.unionByName(partly).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(m) for m in merged]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text without its repeated bytes."""
    ship_package(docs.sparkSession)
    spans = covered(docs, length)
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    read = docs.select("doc_id", text.alias("text"), key.alias("key")).join(spans, "key", "left").select("doc_id", "text", "spans")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            columns: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                runs = union_of([(s["start"], s["end"]) for s in spans or ()])
                free, kept = 0, []
                for start, end in runs:
                    kept.append(raw[free:start])
                    free = end
                kept = b"".join([*kept, raw[free:]])
                for column, value in zip(columns, (len(raw), len(raw) - len(kept), len(runs), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(batches, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

