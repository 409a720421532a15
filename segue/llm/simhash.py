r"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A text's fingerprint has bit j set where over half of its shingles' XXH64 values do.  Equal
   fingerprints are one class; everything below works on classes.
2. Means and joint frequencies of all bits are counted over all classes.  Bits that go together
   are put in one part, greedily, so that parts differ in how well they tell texts apart.
3. If parts get ``u_1 .. u_m`` units with ``sum u = bound + 1``, two fingerprints that differ in
   ``bound`` bits at most differ in fewer than ``u_i`` bits of some part i (none, where u_i is
   0).  For several numbers of parts, dynamic programming deals out the units so that the
   estimated work is least; the best of these plans is taken.  The estimate of the candidates
   of a part matches the mean and the variance of the bits in which two classes differ there,
   which follow from the counts of step 2, with a beta-binomial law.  It is made for a fixed
   large number of classes, so that tables of every size are treated alike.
4. Probing: a part with u units masks u - 1 of its bits in every way.  Classes that agree on
   what is left unmasked are candidates, and verified by counting differing bits; of a key's
   links as many are kept as connect what they connect.
5. A key that very many classes hold is extended: the bits outside it are cut in ``bound + 1``
   pieces, and two that differ in ``bound`` bits agree on one of them.  This goes on until a key
   is held by few, or covers all but ``bound`` bits; then all that hold it are linked with one
   of them.  So no group gives all its pairs, and no link is lost.

Defined results: a null text is empty; a text without words has fingerprint zero, which is
linked like any other; rows without an id have a fingerprint and link, but name no component
(one made of such rows only has a null name); repeated rows are one class; texts of any length
are hashed in runs of bounded size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship_package
from .components import components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Classes for which the plan is made, whatever the table holds.
PLANNED = 10**9
#: Cost of a candidate in keys.
CANDIDATE_COST = 2.0
#: Numbers of parts that are tried, and masked keys a class may have.
PARTS = (2, 3, 4, 5, 6)
MOST_KEYS = 400
#: Classes of a key that are compared with each other; larger groups are extended.
FEW = 128
RUN_WORDS = 50_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of a text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z, and blanks of ASCII only
    if not words:
        return 0
    set_bits, n = np.zeros(BITS, np.int64), max(1, len(words) - size + 1)
    for first in range(0, n, RUN_WORDS):
        run = words[first : first + RUN_WORDS + size - 1]
        shingles = zip(*[run[k:] for k in range(size)]) if len(words) >= size else [run]
        values = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)]
        octets = np.array(values, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """(id, fp) of every row."""
    read = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    kind = read.schema["id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return read.mapInArrow(batches, f"id {kind}, fp bigint")


# --------------------------------------------------------------------------- plan
def joint_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes, and how many have bits i and j both set."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in rows:
            octets = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        at = np.append(np.arange(BITS * BITS), -1)
        held = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held)], names=["at", "n"])

    summed = classes.select("fp").mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    out, n = np.zeros(BITS * BITS), 0
    for row in summed.collect():  # one row for each pair of bits
        if row["at"] < 0:
            n = row["n"]
        else:
            out[row["at"]] = row["n"]
    return n, out.reshape(BITS, BITS)


def grouped_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, each grown from the bits most alike to it."""
    left, groups = list(range(len(together))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (together[b, left].sum() - together[b, b], -b))]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (together[b, group].sum(), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def _few_differ(width: int, mean: float, variance: float, upto: int) -> list[float]:
    """Chances that 0, 1, .. ``upto`` of ``width`` bits differ: a beta-binomial law."""
    p = min(max(mean / width, 1e-9), 1 - 1e-9)
    spread = variance / (width * p * (1 - p))  # 1 for independent bits
    rho = min(max((spread - 1) / (width - 1), 0.0), 0.999) if width > 1 else 0.0
    if rho < 1e-6:
        return [math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(upto + 1)]
    a, b = p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho

    def log_beta(x: float, y: float) -> float:
        return math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)

    return [math.comb(width, k) * math.exp(log_beta(k + a, width - k + b) - log_beta(a, b)) for k in range(upto + 1)]


def part_cost(bits: list[int], units: int, differ: np.ndarray, both: np.ndarray, planned: int) -> float:
    """Estimated keys and candidates, for each class, of a part that gets ``units``."""
    if not units:
        return 0.0
    width, radius = len(bits), units - 1
    if radius >= width or math.comb(width, radius) > MOST_KEYS:
        return math.inf
    q = differ[bits]
    variance = (both[np.ix_(bits, bits)] - np.outer(q, q)).sum()
    chances = _few_differ(width, float(q.sum()), float(variance), radius)
    met = sum(c * math.comb(width - k, radius - k) for k, c in enumerate(chances))
    return math.comb(width, radius) + CANDIDATE_COST * planned / 2 * met


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Units for each part so that their sum is ``units`` and the summed cost least.

    costs[i][u] is the cost of part i with u units; dynamic programming over the parts.
    """
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (so_far, dealt) in best.items():
            for u in range(units - done + 1):
                total = so_far + cost[u]
                if done + u not in step or total < step[done + u][0]:
                    step[done + u] = (total, [*dealt, u])
        best = step
    return best[units]


def plan(n: int, counts: np.ndarray, distance: int = DISTANCE, planned: int = PLANNED) -> list[tuple[list[int], int]]:
    """Parts with the units they get, from the counts of all classes."""
    joint = counts / max(n, 1)
    p = np.diag(joint)
    neither = 1 - p[:, None] - p[None, :] + joint
    only = p[:, None] - joint
    differ = 2 * p * (1 - p)
    both = 2 * (joint * neither + only * only.T)
    both[np.diag_indices(BITS)] = differ
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    together = np.abs(joint - np.outer(p, p)) / np.where(spread > 0, spread, 1)
    plans = []
    for m in PARTS:
        groups = grouped_bits(together, m)
        costs = [[part_cost(g, u, differ, both, planned) for u in range(distance + 2)] for g in groups]
        plans.append((*allocate(costs, distance + 1), groups))
    _, units, groups = min(plans, key=lambda x: x[0])
    return [(g, u) for g, u in zip(groups, units, strict=True) if u]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """What each key keeps of a fingerprint: the bits of a part without those masked."""
    return [_signed(_mask(set(bits) - set(off))) for bits, units in parts for off in combinations(bits, units - 1)]


# --------------------------------------------------------------------------- links
def _grouped(keyed: DataFrame) -> DataFrame:
    """(mask, value, fp, low, high, n) of the keys that several classes hold.

    A key's rows are counted where they lie, by one shuffle: no join brings the counts back.
    """
    of_key = Window.partitionBy("mask", "value")
    held = keyed.select(
        "mask", "value", "fp", F.min("fp").over(of_key).alias("low"), F.max("fp").over(of_key).alias("high"), F.count(F.lit(1)).over(of_key).alias("n")
    )
    return materialise(held.filter("n > 1"))


def _near(distance: int):
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among a few fingerprints, one less than these at most."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    out, left = [], np.ones(len(prints), bool)
    for start in range(len(prints)):
        reached = [start] if left[start] else []
        left[start] = False
        for at in reached:  # grows while it is gone through
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            reached += new.tolist()
            out += [(at, int(b)) for b in new]
    return out


def _forests(groups: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within each of the bounded lists ``held``."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sides: tuple[list, list] = ([], [])
            for held in batch.column(0):
                prints = held.values.to_numpy()
                for side, places in zip(sides, zip(*forest(prints.view(np.uint64), distance)), strict=False):
                    side.append(prints[list(places)])
            columns = [np.concatenate([np.zeros(0, np.int64), *side]) for side in sides]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

    return groups.select("held").mapInArrow(batches, "a bigint, b bigint")


def links(classes: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE, few: int = FEW) -> DataFrame:
    """Links (a, b) of classes, enough of them to connect whatever is connected."""
    every = F.array(*[F.lit(m) for m in masks(parts)])
    keyed = classes.select("fp", F.explode(every).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    found, level = [], 0
    while True:
        rows = _grouped(keyed)
        star = F.bit_count("mask") >= BITS - distance
        pairs = rows.filter("n = 2 and fp = low").select(F.col("low").alias("a"), F.col("high").alias("b"))
        found.append(pairs.filter(_near(distance)))
        rows = rows.filter("n > 2")
        found.append(rows.filter(star & (F.col("fp") > F.col("low"))).select(F.col("low").alias("a"), F.col("fp").alias("b")))
        small = rows.filter(~star & (F.col("n") <= few)).groupBy("mask", "value").agg(F.collect_list("fp").alias("held"))
        found.append(_forests(small, distance))
        large = rows.filter(~star & (F.col("n") > few))
        if large.isEmpty():
            break
        # the bits outside a key in pieces, dealt anew at each level; two classes agree on one
        deal = np.random.default_rng([SEED, level]).integers(0, distance + 1, BITS)
        pieces = F.array(*[F.lit(_signed(_mask(np.flatnonzero(deal == k).tolist()))) for k in range(distance + 1)])
        keyed = (
            large.select("fp", "mask", F.explode(pieces).alias("piece"))
            .select("fp", F.col("mask").bitwiseOR(F.col("piece")).alias("mask"))
            .distinct()
            .withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        )
        keyed, level = materialise(keyed), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialise(out.distinct())


def near_duplicates(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE, few: int = FEW
) -> DataFrame:
    """(ident, fingerprint, component_id) for every row of ``docs``."""
    ship_package(docs.sparkSession)
    rows = materialise(fingerprints(docs, ident, text, size))
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")))
    joined = links(classes.select("fp"), plan(*joint_counts(classes), distance), distance, few)
    found = components(joined).withColumnRenamed("node", "fp")
    # a class that links with nothing names itself; components are named by their least id
    named = materialise(classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(names, "fp").select(
        F.col("id").alias(ident), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
