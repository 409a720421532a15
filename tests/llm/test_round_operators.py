"""SimHash near-duplicates, the Merkle manifest and hard negatives beside brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from check_oracle import connect
from segue.llm import merkle, negatives, simhash
from segue.llm.oracle import ORACLE
from segue.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --------------------------------------------------------------------------- SimHash
def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=3):
    """Component number of each fingerprint, by comparing all pairs."""
    values = np.array(prints, np.uint64)
    root = np.arange(len(values))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= distance) for v in values]
    while changed:
        least = np.array([root[n].min() for n in near])
        changed = bool((least != root).any())
        root = least
    return root


def told(ids, prints):
    root = slow_components(prints)
    names = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            names[r] = min(names.get(r, i), i)
    return sorted(((i, f"{p:016x}", names.get(r)) for i, p, r in zip(ids, prints, root, strict=True)), key=repr)


def test_simhash_of_the_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_simhash_near_dedup"](spark, SF).collect()]
    assert sorted(got, key=repr) == told([d for d, _ in docs], [slow_fingerprint(t) for _, t in docs])


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    texts = [None, "", " \t ", "one", "ONE", "one two", "straße ÄB c", "a b c d", "a b c d", long, long + " more", "a b c d"]
    ids = [9, 8, None, 7, 6, 5, 4, 3, 3, 2, 1, None]
    rows = [(i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, mask string, id int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == told(ids, [slow_fingerprint(t) for t in texts])
    assert (8, "0" * 16, 8) in got and (None, "0" * 16, 8) in got
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("few", [12, 128])
def test_links_of_dense_groups(spark, few):
    """Groups around shared middles, some large: no link lost, however keys are extended."""
    rng = np.random.default_rng(few)
    prints = {0, 2**64 - 1}
    for size, flips in [(150, 5), (80, 9), (40, 3), (30, 14)]:
        middle = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(size):
            prints.add(middle ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, flips + 1)))))
    prints = sorted(prints)
    classes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint").repartition(4)
    parts = simhash.plan(*simhash.joint_counts(classes))
    assert sum(u for _, u in parts) == simhash.DISTANCE + 1
    found = simhash.links(classes, parts, few=few).collect()
    at = {int(np.uint64(p).astype(np.int64)): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
        a, b = top(at[a]), top(at[b])
        root[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(prints))] == slow_components(prints).tolist()


def test_simhash_plan():
    """Alike bits come together, and a part that tells little apart gets few units."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, :32] = bits[:, :1] ^ (rng.random((4000, 32)) < 0.02)  # 32 bits that go together
    order = rng.permutation(64)
    counts = bits[:, order].T.astype(float) @ bits[:, order]
    n, alike = len(bits), {i for i, b in enumerate(order) if b < 32}
    groups = simhash.grouped_bits(np.abs(np.corrcoef(bits[:, order].T)), 2)
    assert {frozenset(g) for g in groups} == {frozenset(alike), frozenset(range(64)) - alike}
    parts = simhash.plan(n, counts, planned=10**6)
    units = {len(alike & set(g)) * 2 > len(g): u for g, u in parts}
    assert units.get(True, 0) < units[False] and sum(u for _, u in parts) == 4
    costs = rng.random((5, 5)).tolist()
    best = min((sum(c[u] for c, u in zip(costs, us, strict=True)), us) for us in np.ndindex(5, 5, 5, 5, 5) if sum(us) == 4)
    assert simhash.allocate(costs, 4)[1] == list(best[1])


# --------------------------------------------------------------------------- Merkle manifest
def slow_manifest(rows, found):
    """rows: lists of the five fields; found: the text each has at checking."""

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(own, nodes, at, claimed):
        """(top, siblings on the way, folded top)."""
        siblings = ""
        while len(nodes) > 1:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            siblings += "".join(run[: at % 16] + run[at % 16 + 1 :])
            claimed = sha("".join(run[: at % 16]) + claimed + "".join(run[at % 16 + 1 :]))
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            at //= 16
        return nodes[0], siblings, claimed

    groups = {}
    for number, row in enumerate(rows):
        groups.setdefault(row[1], []).append((row[0] is not None, row[0], leaf(row), number))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, out = [], []
    for g in order:
        groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        tops.append(climb("", [x[2] for x in groups[g]], 0, "")[0])
    for place, g in enumerate(order):
        leaves = [x[2] for x in groups[g]]
        for at, (_, ident, own, number) in enumerate(groups[g]):
            row = rows[number]
            claimed = leaf([*row[:4], found[number]])
            top, siblings, folded = climb(own, leaves, at, claimed)
            root, above, folded = climb(top, tops, place, folded)
            out.append((ident, g, own, top, root, sha(siblings + above), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [3, 1, 40, 257], [4100, 1, 2] + [1] * 20, [5] * 300])
def test_manifest(spark, sizes):
    rows = [[i * 3 % 100_003, f"s{k:03}", "en", i, f"Text {i}"] for k, n in enumerate(sizes) for i in range(n)]
    found = [t.lower() if i % 5 == 0 else t for i, (*_, t) in enumerate(rows)]
    docs = spark.createDataFrame([(*r, f) for r, f in zip(rows, found, strict=True)], "doc_id bigint, source string, lang string, n_chars bigint, text string, seen string")
    got = merkle.manifest(docs.repartition(3), changed={"text": F.col("seen")})
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_manifest(rows, found)


def test_manifest_odd_rows(spark):
    rows = [
        [None, None, None, None, None], [1, None, "de", 3, ""], [2, "", "de", None, "ß A"], [2, "", "de", None, "ß A"],
        [2, "", "de", None, "Other"], [None, "é", None, 0, "x" * 200_000], [5, "z", "en", 1, "lower"], [-7, "z", "en", 1, "ABC"],
    ]
    found = [r[4] and r[4].lower() for r in rows]
    extra = "row string, grp int, digest string, pos int, level int, claimed int"
    docs = spark.createDataFrame(
        [(*r, f, "a", 1, "b", 2, 3, 4) for r, f in zip(rows, found, strict=True)],
        f"doc_id bigint, source string, lang string, n_chars bigint, text string, seen string, {extra}",
    )
    got = sorted((tuple(r) for r in merkle.manifest(docs, changed={"text": F.col("seen")}).collect()), key=repr)
    assert got == slow_manifest(rows, found)
    assert [r[-1] for r in got].count(False) == 4
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_proof_is_all_it_takes():
    own, proof = merkle.digest("leaf"), "".join(merkle.digest(str(i)) for i in range(3))
    one = merkle.digest(proof[:64] + own + proof[64:128])
    assert merkle.fold(own, proof, [2, 1, 1, 0, 0, 0]) == merkle.digest(merkle.digest(one + proof[128:]))


# --------------------------------------------------------------------------- hard negatives
def slow_negatives(rows, is_anchor, positives=5, negatives_wanted=10):
    """rows: distinct (id, label, integer vector)."""
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1] == a[1]) for r in rows if r is not a and len(r[2]) == len(a[2]))
        for s, ident, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and -30 * s <= -100 * x[0] <= -90 * s][:negatives_wanted]
            out += [(a[0], ident, k, n, -s, -score) for k, (score, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>").repartition(3)
    found = negatives.hard_negatives(frame, lambda ident: ident % 10 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("options", [{}, {"first_round": 1, "cell": 4, "block_entries": 8, "block_anchors": 3}])
def test_hard_negatives(spark, options):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 40, (12, 9))
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in middles[rng.integers(0, 12)] + rng.normal(0, 9, 9)]) for i in range(600)]
    rows += [(600 + i, i % 3, rows[7][2]) for i in range(90)]  # one vector very many times
    rows += [(700 + i, 1, [i - 5] * 2) for i in range(12)]  # shorter ones
    rows += [(720 + i, i % 2, []) for i in range(5)]
    rows += [(0, 1, [3] * 9), (0, 2, [3] * 9), (0, 1, [4] * 9), (2**53 + 1, 1, [3] * 9), (2**53 + 7, 0, [5] * 9)]  # ids met again
    assert mined(spark, rows, **options) == slow_negatives(rows, lambda ident: ident % 10 == 0)
    assert mined(spark, [*rows, *rows[:50]], **options) == slow_negatives(rows, lambda ident: ident % 10 == 0)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, 0.25], [0.5, 0.24], [0.4, 0.2], [0.3, -0.1], None, [0.5, None], [nan, 1.0], [inf, 0.0], [1e300, 0.0], [-0.001, 0.3]]
    schema = "vec_id bigint, embedding array<float>, label int, v int, entry string, score double"
    rows = [(i, v, i % 2, 1, "x", 0.5) for i, v in enumerate(vectors)] + [(50, [0.5, 0.5], None, 1, "", 0.1), (None, [0.5, 0.5], 1, 1, "", 0.1)]
    taken = negatives.valid(spark.createDataFrame(rows, schema), "vec_id", "embedding", "label")
    held = sorted((r["id"], r["label"], r["v"]) for r in taken.collect())
    assert [h[0] for h in held] == [0, 1, 2, 3, 9] and held[-1][2] == [-1, 76]
    assert mined(spark, held) == slow_negatives(held, lambda ident: ident % 10 == 0)
    assert mined(spark, held[:0]) == [] and mined(spark, held[:1]) == []


def test_anchors_ask_for_few_large_cells(spark):
    """What moves and is walked for an anchor is a row for thousands of entries, not for dozens."""
    rows = [(i, 0, [i % 141, i // 141]) for i in range(20_000)]
    entries = spark.createDataFrame(rows, "entry bigint, label bigint, v array<bigint>")
    ((first, second),) = negatives.codebooks(entries).values()
    assert len(first) * len(second) <= 16
    rng = np.random.default_rng(3)
    entries, anchors = rng.integers(-9, 9, (400, 3)).astype(np.int32), rng.integers(-9, 9, (negatives.SLICE + 40, 3)).astype(np.int32)
    labels, of_anchor, ids = rng.integers(0, 3, 400), rng.integers(0, 3, len(anchors)), rng.permutation(400)
    windows = [[(-(2**62), 2**62, None), (0, 50, None), (-20, 30, 25)]] * len(anchors)
    for same in (True, False):
        found = list(negatives.best_in_windows(anchors, of_anchor, windows, entries, labels, ids, same, 4))
        assert [i for i, *_ in found] == list(range(len(anchors)))
        for i, at, scores in found:
            exact = [int(x) for x in entries.astype(int) @ anchors[i].astype(int)]
            fits = [(-s, ids[e], e) for e, s in enumerate(exact) if (labels[e] == of_anchor[i]) == same]
            wanted = {e for low, high, last in windows[i] for *_, e in sorted(f for f in fits if max(low, last or low) <= -f[0] <= high)[:5]}
            assert set(at) == wanted and list(scores) == [exact[e] for e in at]


def test_walk_is_certified():
    """A walk never goes up, covers all cells, and stops before cells that cannot matter."""
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 100, (8, 6))
    vectors = np.rint(middles[rng.integers(0, 8, 2000)] + rng.normal(0, 2, (2000, 6)))
    books = [negatives._codebook(h, 8) for h in negatives.halves(vectors)]
    near = [negatives.nearest_centre(h, b) for h, b in zip(negatives.halves(vectors), books, strict=True)]
    apart = [np.sqrt(((h - b[n]) ** 2).sum(1)) for h, b, n in zip(negatives.halves(vectors), books, near, strict=True)]
    keys = sorted(set(zip(*near, strict=True)))
    inside = {k: np.flatnonzero((near[0] == k[0]) & (near[1] == k[1])) for k in keys}
    cells = np.array([(*k, len(inside[k]), *[a[inside[k]].max() for a in apart]) for k in keys], float)
    walk = negatives.Walk(books, cells)
    for anchor in vectors[:20]:
        seen = list(walk.walk(anchor))
        assert sorted(s[3] for s in seen) == list(range(len(cells)))
        assert all(a[0] >= b[0] - 1e-6 for a, b in zip(seen, seen[1:], strict=False))
        for bound, most, least, cell in seen:
            scores = vectors[inside[keys[cell]]] @ anchor
            assert least <= scores.min() and scores.max() <= min(bound, most)
        last = float(np.sort(vectors @ anchor)[-10])
        cells_asked, _ = negatives.ask(walk, anchor, 0, 10**9, [(-(2**62), 2**62, last)])
        assert len(cells_asked) < len(cells) / 2


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    mine = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(ORACLE[name])
    at = [[d[0] for d in cursor.description].index(c) for c in mine.columns]
    theirs = sorted((tuple(row[i] for i in at) for row in cursor.fetchall()), key=repr)
    assert theirs and sorted((tuple(r) for r in mine.collect()), key=repr) == theirs


def test_simhash_keys_are_counted_where_they_lie(spark):
    """Each row of a shared key once, with the key's count and ends; no join of all keys brings them."""
    keyed = spark.createDataFrame([(i, m, v) for m in (1, 2) for v in (0, 1, 2) for i in range(10 * v, 10 * v + v + 1)], "fp bigint, mask bigint, value bigint")
    got = sorted((r["mask"], r["value"], r["fp"], r["low"], r["high"], r["n"]) for r in simhash._grouped(keyed).collect())
    assert got == [(m, v, i, 10 * v, 10 * v + v, v + 1) for m in (1, 2) for v in (1, 2) for i in range(10 * v, 10 * v + v + 1)]
