r"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct shingles of five words (see words.py), as 64-bit hashes.
Sets are equal or linked when 100 * |both| >= 80 * |either|.

1. Equal sets are one class; everything below works on classes, named by their smallest
   doc_id.
2. Shingles are ordered by how often whole texts hold them, rare ones first.  Linked sets of
   n and m share ceil(80 * (n + m) / 180), so the k-th they share stands, in either, among the
   first ``n - ceil(80 * (n + m) / 180) + k`` (prefix filtering, extended).
3. Of every shingle of the longest such prefix (k = 1) that several classes have, each class is
   first compared with the smallest one of about its size only; links make components.
4. A shingle that still joins different components is a key for every band of sizes the other
   set may have, which shortens the prefix to what that band allows; one without rows of both
   bands is none.  Where at most ``rare`` rows of a key lie outside its largest component, or in
   one of its bands, these are compared with all others of the key.
   Of any other key ``PIVOTS * rare`` such rows are, and leave it, as all their pairs in it are
   met.  If links then leave it frequent, it is extended by each shingle that may be the next common one,
   to combinations of two, three and more, until all are rare.  Rows that have as many shingles
   in their key as a link needs are linked; they are compared as a star.  Nothing is lost, and no
   key gives more pairs at a time than ``PIVOTS * rare`` times its rows.
5. Candidates are verified: by what their prefixes allow, then on the whole sets, with
   shingles cut to 32 bits.  Only where that leaves the decision within a few shingles, which
   accidental equality could turn, the 64-bit sets decide.

Defined results: a null text is empty; an empty set is linked with nothing; rows whose
doc_id is null stand for themselves with a null component; repeated rows are one class; an
empty table gives no rows; columns other than doc_id and text are ignored; very long texts are
read whole, each in its own run.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise, ship_package
from .components import components, few, joined
from .words import Words, mixed, runs

SHINGLE = 5
PERCENT = 80
#: Rows of a key, as counted by ``_torn``, up to which it is rare.
RARE = 12
#: Rows of a frequent key, as a multiple of that, compared with all others before it is extended.
PIVOTS = 4
#: Bands of sizes between a set and the smallest one it may be linked with.
BANDS = 4
#: Pairs a task verifies; few pairs need few tasks.
PAIRS = 2_000
#: Rows of open keys a task pairs.
TORN = 20_000
#: Shingles counted at a time in a task, to find the frequent ones.
COUNTED = 3_000_000
#: Shingles ordered last: so many at most, which bounds what is broadcast.
ORDERED_LAST = 200_000
#: Common shingles by which a decision on 32 bits must be clear, beside those expected by accident.
DOUBT = 4
#: Ids that may be broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_NAMES = 500_000
_LOW = np.uint64(2**63 - 1)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, as non-negative 63-bit values."""
    words = Words(texts)
    hashes, text = words.windows(size)
    n_words = np.diff(words.bounds)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order] & _LOW, text[order]
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = []
    for i, n in enumerate(n_words):
        if n >= size:
            sets.append(np.unique(hashes[at[i] : at[i + 1]]).view(np.int64))
        elif n:  # the whole sequence is the one shingle
            own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            total = np.full(1, n, np.uint64)
            for h in own:  # four words at most
                total = mixed(total * np.uint64(31) + h)
            sets.append((total & _LOW).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n among which every linked one shares one."""
    return min(n, n - (percent * n + 99) // 100 + 1)


def _frequent(docs: DataFrame) -> DataFrame:
    """Shingles found in several sets within tasks, with how many; every text is counted."""

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
        keep = times > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(values[keep]), pa.array(times[keep].astype(np.int64))], names=["token", "times"]
        )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for _, texts in runs(batch.column(0).to_pylist()):
                for s in shingle_sets(texts):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if digest not in held:
                        held[digest] = s
                        size += len(s) + 20  # what holding a set takes
                if size > COUNTED:
                    yield repeated(list(held.values()))
                    held, size = {}, 0
        yield repeated(list(held.values()))

    return (
        docs.select("text").mapInArrow(counted, "token bigint, times bigint").groupBy("token").agg(F.sum("times").alias("times"))
    )


def _ordered_sets(docs: DataFrame, last: np.ndarray, times: np.ndarray, percent: int, whole: bool = False) -> DataFrame:
    """(doc_id, n, sig, prefix) for every row: shingles in ``last`` (sorted) follow by ``times``.

    The prefix is the longest any link needs, or with ``whole`` the whole set.
    """
    read = docs.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((last, times))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, often = held.value
        for batch in rows:
            for first, texts in runs(batch.column(1).to_pylist()):
                sets = shingle_sets(texts)
                prefixes = []
                for s in sets:
                    if len(late) and len(s):
                        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        s = s[np.argsort(np.where(late[at] == s, often[at], 0), kind="stable")]
                    prefixes.append(s if whole else s[: prefix_length(len(s), percent)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "sig", "prefix"],
                )

    return read.mapInArrow(batches, f"doc_id {kind}, n bigint, sig string, prefix array<bigint>")


def _whole_sets(docs: DataFrame, wide: bool) -> DataFrame:
    """(node, tokens) for every row of ``docs``, its id as node; narrow tokens are the upper 32 bits."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, texts in runs(batch.column(1).to_pylist()):
                sets = shingle_sets(texts)
                if not wide:
                    sets = [(s >> 31).astype(np.uint32).view(np.int32) for s in sets]
                tokens = pa.array(sets, pa.list_(pa.int64() if wide else pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), tokens], names=["node", "tokens"])

    read = docs.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(batches, f"node {kind}, tokens array<{'bigint' if wide else 'int'}>")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose whole sets are similar enough.

    Prefixes come first: of two, that which ends earlier in the order has all its common
    shingles in the other one, so the shingles both prefixes hold and the longer rest bound
    what the sets can have in common.  Whole sets are made for the pairs that are left.
    """

    def paired(rows: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
        """The pairs, each with ``column`` of both its rows, by one shuffle of what they need."""
        ends = _ends(pairs)
        held = F.min(F.when(F.col("first"), F.col(column))), F.min(F.when(~F.col("first"), F.col(column)))
        both = rows.join(broadcast_if_small(ends, BROADCAST_NAMES), "node").groupBy("a", "b", "n_a", "n_b")
        return few(both.agg(held[0].alias("in_a"), held[1].alias("in_b")), pairs.count(), PAIRS)

    rest = F.greatest(F.col("n_a") - F.size("in_a"), F.col("n_b") - F.size("in_b"))
    most = F.size(F.array_intersect("in_a", "in_b")) + rest
    close = materialise(
        paired(classes, pairs, "prefix")
        .filter((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
        .select("a", "b", "n_a", "n_b")
    )
    if close.isEmpty():
        return close.select("a", "b")

    def compared(pairs: DataFrame, wide: bool) -> DataFrame:
        """The pairs with the hundredfold number of common shingles they have above the bound."""
        need = _ends(pairs).select(F.col("node").alias("doc_id"))
        of_need = docs.select("doc_id", "text").join(broadcast_if_small(need, BROADCAST_IDS), "doc_id", "left_semi")
        both = paired(_whole_sets(of_need, wide), pairs, "tokens")
        common = F.size(F.array_intersect("in_a", "in_b"))
        above = (100 + percent) * common - percent * (F.col("n_a") + F.col("n_b"))
        return materialise(both.select("a", "b", "n_a", "n_b", above.alias("above")))

    narrow = compared(close, False)
    # shingles that 32 bits make equal by accident grow with both sizes
    by_accident = (F.col("n_a") + F.col("n_b")) * (F.col("n_a") + F.col("n_b")) / float(2**33)
    doubt = (100 + percent) * (DOUBT + 3 * by_accident)
    sure = narrow.filter(F.col("above") > doubt)
    unsure = narrow.filter(F.abs("above") <= doubt).drop("above")
    if unsure.isEmpty():
        return sure.select("a", "b")
    return sure.unionByName(compared(unsure, True).filter("above >= 0")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    """Both nodes of every pair (a, b, n_a, n_b), as rows."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("first")), F.struct(F.col("b").alias("node"), F.lit(False).alias("first")))
    return pairs.select("a", "b", "n_a", "n_b", F.inline(ends))


def _need(n, m, percent: int):
    """Shingles that linked sets of n and m share at least."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent)).cast("bigint")


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, n, pos) once for each band of sizes that a linked set may have.

    ``need`` is what a link with a set of that band takes at least; rows whose shingle lies
    behind the prefix this leaves are gone.
    """
    step = math.log(100 / percent) / BANDS
    band = F.floor(F.log(F.col("n")) / step)
    smallest = F.ceil(F.exp(F.col("other") * step) * (1 - 1e-9))
    biggest = F.exp((F.col("other") + 1) * step) * (1 + 1e-9)
    bounded = F.greatest(smallest, F.ceil(percent * F.col("n") / 100)).cast("bigint")
    return (
        rows.withColumn("band", band)
        .withColumn("other", F.explode(F.sequence(F.col("band") - BANDS - 1, F.col("band") + BANDS + 1)))
        .filter((percent * smallest <= 100 * F.col("n")) & (100 * biggest >= percent * F.col("n")))
        .withColumn("need", _need(F.col("n"), bounded, percent))
        .filter("pos <= n - need")
        .select(
            F.xxhash64("token", F.least("band", "other"), F.greatest("band", "other")).alias("key"),
            *["node", "n", "pos", "band", "other", "need", F.lit(1).alias("level")],
        )
    )


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the component of their node."""
    known = broadcast_if_small(found, BROADCAST_NAMES)
    return rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of shingles that join several components."""
    labelled = _labelled(shared, found)
    torn = labelled.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return labelled.drop("component").join(torn.filter("least < most").select("token"), "token")


def _torn(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of keys in which rows of different components may be linked, with ``outside`` and ``major``.

    Every such pair of a key has a row that is not ``major``, and ``outside`` rows are not.  They
    are those outside the largest component, or, where the key is for two bands of sizes and they
    are fewer, those of the band with fewer rows; a key with rows of only one of its bands is gone.
    """
    labelled = materialise(_labelled(rows, found))
    lower, higher = F.col("band") < F.col("other"), F.col("band") > F.col("other")
    least = F.when(F.col("lows") + F.col("highs") > 0, F.least("lows", "highs"))
    largest = (
        labelled.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("size"), F.count_if(lower).alias("lows"), F.count_if(higher).alias("highs"))
        .groupBy("key")
        .agg(F.sum("size").alias("times"), F.sum("lows").alias("lows"), F.sum("highs").alias("highs"), F.max(F.struct("size", "component")).alias("top"))
        .select("key", (F.col("times") - F.col("top.size")).alias("others"), F.col("top.component").alias("top"), least.alias("least"), (F.col("lows") <= F.col("highs")).alias("by_lows"))
        .withColumn("outside", F.least("others", "least"))
        .filter("outside > 0")
    )
    of_less = F.when(F.col("by_lows"), lower).otherwise(higher)
    major = F.when(F.col("least") < F.col("others"), ~of_less).otherwise(F.col("component") == F.col("top"))
    return labelled.join(largest, "key").withColumn("major", major).drop("top", "others", "least", "by_lows")


def _pair(node: str, n: str, other: str, m: str) -> list:
    """Two nodes as the columns (a, b, n_a, n_b), the smaller one first."""
    up = F.col(node) < F.col(other)
    return [
        F.least(node, other).alias("a"), F.greatest(node, other).alias("b"),
        F.when(up, F.col(n)).otherwise(F.col(m)).alias("n_a"), F.when(up, F.col(m)).otherwise(F.col(n)).alias("n_b"),
    ]


def _met(left: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a row of ``left`` and any other row of its key."""
    left = left.select("key", "band", "other", "level", "node", "n", "pos", "component")
    right = rows.select(
        "key", F.col("other").alias("band"), F.col("band").alias("other"),
        *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "component")],
    )
    need = _need(F.col("n"), F.col("n_b"), percent)
    room = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    return (
        left.join(right, ["key", "band", "other"])
        .filter("component <> component_b")
        .filter(100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
        .filter(room + F.col("level") - 1 >= need)
        .select(*_pair("node", "n", "node_b", "n_b"))
        .distinct()
    )


def _full(rows: DataFrame, percent: int) -> DataFrame:
    """A star for each key and two sizes whose links need no more shingles than the key has.

    All its pairs of these sizes are linked, so the smallest of one size with all of the other
    joins them; a size the key does not hold gives nothing.
    """
    sizes = F.sequence(F.ceil(percent * F.col("n") / 100).cast("bigint"), F.floor(100 * F.col("n") / percent).cast("bigint"))
    done = (
        rows.filter("need <= level")
        .withColumn("m", F.explode(sizes))
        .filter(_need(F.col("n"), F.col("m"), percent) <= F.col("level"))
        .select("key", "node", "n", "m")
    )
    lows = done.groupBy("key", F.col("n").alias("m"), F.col("m").alias("n")).agg(F.min("node").alias("low"))
    pairs = done.join(lows, ["key", "n", "m"]).filter("low <> node")
    return pairs.select(*_pair("node", "n", "low", "m")).distinct()


def _extended(rows: DataFrame, wholes: DataFrame) -> DataFrame:
    """Every key with each shingle that may be the next common one of a link."""
    kept = ["node", "n", "band", "other", "need"]
    room = F.greatest(F.col("n") - F.col("need") + F.col("level") - F.col("pos"), F.lit(0)).cast("int")
    return (
        rows.select("key", "pos", "level", *kept)
        .join(wholes, "node")
        .withColumn("nexts", F.slice("tokens", F.col("pos").cast("int") + 2, room))
        .select("key", "pos", "level", *kept, F.posexplode("nexts").alias("i", "token"))
        .withColumns({"key": F.xxhash64("key", "token"), "pos": F.col("pos") + F.col("i") + 1, "level": F.col("level") + 1})
        .select("key", "pos", "level", *kept)
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rare: int = RARE, ordered_last: int = ORDERED_LAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    frequent = _frequent(docs).filter(F.col("times") > rare).orderBy(F.desc("times"), "token").limit(ordered_last)
    order = np.array([(r["token"], r["times"]) for r in frequent.collect()], np.int64).reshape(-1, 2)
    last, times = order[order[:, 0].argsort()].T.copy()
    sets = materialise(_ordered_sets(docs, last, times, percent))

    # one class for each set; rows without an id are in it but do not name it
    named = sets.filter("n > 0 and doc_id is not null")
    names = materialise(named.groupBy("sig").agg(F.min("doc_id").alias("node")))
    classes = named.select("doc_id", "sig", "n", "prefix").join(
        broadcast_if_small(names.withColumnRenamed("node", "doc_id"), BROADCAST_NAMES), ["sig", "doc_id"], "left_semi"
    ).select(F.col("doc_id").alias("node"), "n", "prefix")
    every, alike = Window.partitionBy("token"), Window.partitionBy("token", "about")
    about = F.floor(F.log(F.col("n")) / math.log(100 / percent))
    shared = materialise(
        classes.select("node", "n", about.alias("about"), F.posexplode("prefix").alias("pos", "token"))
        .select("*", F.count(F.lit(1)).over(every).alias("times"), F.min(F.struct("node", "n", "pos")).over(alike).alias("low"))
        .drop("about")
        .filter("times > 1")
        .drop("times")
    )
    need = _need(F.col("n"), F.col("low.n"), percent)
    stars = materialise(
        shared.filter("low.node < node")
        .filter((F.col("n") - F.col("pos") >= need) & (F.col("low.n") - F.col("low.pos") >= need))
        .filter(100 * F.least("n", "low.n") >= percent * F.greatest("n", "low.n"))
        .select(F.col("low.node").alias("a"), F.col("node").alias("b"), F.col("low.n").alias("n_a"), F.col("n").alias("n_b"))
        .distinct()
    )
    linked = materialise(_verified(docs, classes, stars, percent))
    found = materialise(components(linked, linked.count()))

    # keys that still join different components, extended until all are rare
    keys, wholes = _banded(_open(shared.drop("low"), found), percent), None
    some = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"))
    while True:
        torn = materialise(_torn(keys, found))
        if torn.isEmpty():
            break
        many = torn.filter(F.col("outside") > rare)
        pivots = materialise(many.filter("not major").withColumn("place", F.row_number().over(some)).filter(F.col("place") <= PIVOTS * rare))
        scarce = torn.filter(F.col("outside") <= rare)
        left = scarce.filter("not major").unionByName(pivots.drop("place"))
        met = _met(left, torn, percent).unionByName(_full(many, percent)).distinct()
        met = materialise(few(met.join(stars.select("a", "b"), ["a", "b"], "left_anti"), torn.count(), TORN))
        if not met.isEmpty():
            found = joined(found, _verified(docs, classes, met, percent))
        if many.isEmpty():
            break
        rest = many.join(pivots.select("key", "node", "pos"), ["key", "node", "pos"], "left_anti")
        rest = materialise(_torn(rest.select("key", "pos", "level", "node", "n", "band", "other", "need"), found))
        if wholes is None:
            open_ids = broadcast_if_small(materialise(rest.select(F.col("node").alias("doc_id")).distinct()), BROADCAST_IDS)
            of_open = docs.join(open_ids, "doc_id", "left_semi")
            wholes = materialise(
                _ordered_sets(of_open, last, times, percent, whole=True)
                .dropDuplicates(["doc_id", "sig"])
                .select(F.col("doc_id").alias("node"), F.col("prefix").alias("tokens"))
            )
        settled = rest.filter(F.col("outside") <= rare)
        keys = _extended(rest.filter(F.col("outside") > rare), wholes)
        keys = keys.unionByName(settled.select(keys.columns))
    return (
        sets.select("doc_id", "n", "sig")
        .join(names, "sig", "left")
        .join(found, "node", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
        )
    )
