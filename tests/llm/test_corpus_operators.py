"""Corpus-wide operators beside brute force on small tables, with hot groups and odd rows."""

import random
import re

import numpy as np
import pytest

from segue.llm import ann, neardup, substring, suffixes
from segue.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, node string, n int")


def corpus(rng, n=120):
    """Unique texts, exact and near copies in chains, a shared passage in a third of all."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    base = rng.choices(vocabulary, k=150)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            words = rng.choices(vocabulary, k=rng.randint(20, 60)) + [passage] + rng.choices(vocabulary, k=20)
        elif i % 3 == 1:
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            words = base
        else:
            words = rng.choices(vocabulary, k=rng.randint(1, 80))
        rows.append((i * 3, " ".join(words)))
    rows += [(1000 + i, rows[4][1]) for i in range(60)]
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (None, "a b c d e f"), (2003, "one"), (2004, "ONE"), (2005, "a b c"), (6, rows[2][1])], passage


# ------------------------------------------------------------------------------ Jaccard join
def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("rare, last", [(12, 200_000), (2, 0), (3, 5)])
def test_near_duplicates_equal_brute_force(spark, rare, last):
    rows, _ = corpus(random.Random(rare))
    rows = [r for r in rows if r[0] != 6 or r[1] == rows[2][1]]
    got = neardup.near_duplicates(documents(spark, rows), rare=rare, ordered_last=last).collect()
    want = brute_components([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 2
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """Texts that share a template and are not linked meet in few pairs; none that is linked is lost."""
    rng, pairs = random.Random(5), []
    pool = [f"p{i}" for i in range(40)]
    template = [f"t{i}" for i in range(44)]
    rows = [(i, " ".join([*template, *(f"{i}x{j}" for j in range(4 + i % 5)), *rng.choices(pool, k=4)])) for i in range(400)]
    rows += [(500 + i, " ".join([*template[:20], *rng.choices(pool[:3], k=8)])) for i in range(200)]
    verified = neardup._verified

    def counting(docs, classes, met, percent):
        pairs.append(met.count())
        return verified(docs, classes, met, percent)

    monkeypatch.setattr(neardup, "_verified", counting)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), rare=4).collect()}
    assert got == brute_components(rows)
    assert sum(pairs) < 20 * len(rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, [(1, "x")]).limit(0)).isEmpty()
    alone = neardup.near_duplicates(documents(spark, [(5, None), (7, "x y")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in alone) == [(5, 0, 5), (7, 1, 7)]


def test_components_of_stars_and_chains(spark):
    links = [(1, i) for i in range(2, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (1060, 2000), (299, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 300)}, **{i: 1000 for i in range(1000, 1061)}, 2000: 1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


# ------------------------------------------------------------------------------ repeated passages
def test_planted_passages_are_found_and_cut_once(spark):
    rng = random.Random(5)
    rows, passage = corpus(rng)
    fuzzy = passage.split()
    for at in (9, 25, 41):
        fuzzy[at] = "changed"
    del fuzzy[33]
    rows = [*rows, (3000, "start here " + " ".join(fuzzy) + " end"), (3001, "clean text " + " ".join(f"u{i}" for i in range(200)))]
    docs = documents(spark, rows)
    found = substring.repeats(docs)
    by_doc = {}
    for r in found.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    holders = [i for i, t in rows if t and passage in t and i is not None]
    assert all(i in by_doc for i in holders[1:]) and 3000 in by_doc and 3001 not in by_doc
    left = {r.doc_id: r.text for r in substring.cut(docs, found).collect()}
    assert sum(passage in (t or "") for t in left.values()) == 1 and passage in left[holders[0]]
    assert left[3000].startswith("start here") and left[3000].endswith("end") and "changed" not in left[3000]
    assert left[3001] == rows[-1][1] and left[2000] is None and left[2001] == ""
    assert len(left) >= len({i for i, _ in rows}) - 1 and substring.cut(docs, found).columns == docs.columns
    assert substring.repeats(docs.limit(0)).isEmpty()


def test_a_text_in_circles_keeps_one_round(spark):
    lines = "\n".join(["the quick brown fox jumps over the lazy dog today"] * 40)
    docs = documents(spark, [(1, lines)])
    left = substring.cut(docs, substring.repeats(docs)).collect()[0].text
    assert 10 <= len(left.split()) < 120


def test_rows_of_one_id_lose_only_their_own_repeats(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared, same = say(70), say(80)
    rows = [(1, same)] * 3 + [(2, f"{say(30)} {shared}"), (2, f"{shared} {say(45)}"), (2, say(60)), (2, "short one"), (2, "short one"), (None, same), (3, say(90)), (2, None)]
    docs = documents(spark, rows).repartition(4)
    found = substring.repeats(docs)
    assert sorted((r.doc_id, r.first_word, r.n_words, r.leader_id) for r in found.collect() if r.doc_id == 1) == [(1, 0, 80, 1)] * 2
    left = sorted((str(r.doc_id), r.text or "") for r in substring.cut(docs, found).collect())
    assert [t for i, t in left if i == "1"] == ["", "", same]
    own = [t.strip() for i, t in left if i == "2"]
    first, second = rows[3][1], rows[4][1]
    # one of the two keeps the passage, the other loses it and nothing else
    assert sorted(own) in (sorted(["", rows[5][1], "short one", "short one", a, b]) for a, b in ((first, second[len(shared) + 1 :]), (first[: -len(shared) - 1], second)))
    assert ("None", same) in left and ("3", rows[9][1]) in left and len(left) == len(rows)


def best_chain_score(matches, k, gap):
    """Quadratic definition."""
    best = [0.0] * len(matches)
    for i, (x, y) in enumerate(matches):
        best[i] = k + max([0.0, *[best[j] - gap * ((x - u) + (y - v) - 2) for j, (u, v) in enumerate(matches[:i]) if u < x and v < y]])
    return max(best)


def test_chains_reach_the_best_score():
    rng = random.Random(1)
    for _ in range(200):
        matches = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(2, 40))})
        found = substring.chains(matches, 7, 0.1)
        for chain in found:
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:], strict=False))
        if found:
            scores = [7 * len(c) - sum(0.1 * ((b[0] - a[0]) + (b[1] - a[1]) - 2) for a, b in zip(c, c[1:], strict=False)) for c in found]
            assert max(scores) == pytest.approx(best_chain_score(matches, 7, 0.1))


# ------------------------------------------------------------------------------ repeated bytes
def brute_removed(rows, length):
    times = {}
    for _, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            times[raw[i : i + length]] = times.get(raw[i : i + length], 0) + 1
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for j in range(len(raw) - length + 1):
            if times[raw[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        out.append((str(i), len(raw), int(gone.sum()), runs, kept))
    return sorted(out)


def test_removed_bytes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_CONTEXTS", 15)
    rng = random.Random(11)
    say = lambda n: "".join(rng.choices("abcdé xyz", k=n))
    shared, other = say(400), say(260)
    rows = [(i, say(rng.randint(0, 300)) + shared[rng.randint(0, 120) : rng.randint(280, 400)] + say(rng.randint(0, 200))) for i in range(60)]
    rows += [(100 + i, say(150) + other[:230] + say(50) + other[10:]) for i in range(8)]
    rows += [(200, "a" * 1500), (201, "ab" * 700), (202, say(199)), (203, None), (204, ""), (None, say(500)), (205, rows[0][1]), (205, rows[0][1]), (206, say(3000))]
    got = suffixes.remove_repeats(documents(spark, rows).repartition(7)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_removed(rows, 200)
    assert suffixes.remove_repeats(documents(spark, rows).limit(0)).isEmpty()


def test_loser_tree_merges_with_true_prefixes():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [suffixes.front_coded(r) for r in runs]
    assert [[s for _, s in suffixes.front_decoded(c)] for c in coded] == runs
    merged = list(suffixes.LoserTree([suffixes.front_decoded(c) for c in coded]))
    assert [s for _, _, s in merged] == sorted(s for r in runs for s in r)
    before = b""
    for _, shared, s in merged:
        assert shared == suffixes.common_prefix(before, s)
        before = s


def test_a_long_text_is_cut_into_chunks_without_loss(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 500)
    text = "".join(random.Random(2).choices("abc", k=2300))
    pieces = [(b, r) for rows, places, run in suffixes._chunks([text], 200) for b, r in zip(places, run, strict=True)]
    windows = [b + i for b, r in pieces for i in range(len(r) - 199)]
    assert windows == list(range(2101))


# ------------------------------------------------------------------------------ neighbours
def test_hilbert_keys_visit_neighbouring_cells():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(ann.hilbert_keys(cells, 3))
    assert sorted(ann.hilbert_keys(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, rng.normal(size=8))) for _ in range(900)]
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[7]) for i in range(400)]
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (None, vectors[3]), (2200, [1.0, 2.0]), (0, vectors[0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, entry string")
    got = {}
    for r in ann.nearest(frame, lambda i: i % 50 == 0, window=64).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    ids = [i for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    held = dict((i, np.array(v, np.float32).astype(float)) for i, v in rows if i in set(ids))
    ids = sorted(held)
    x = np.stack([held[i] for i in ids])
    size = np.sqrt((x * x).sum(axis=1))
    hits = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        cos = x @ held[q] / size / np.sqrt((held[q] ** 2).sum())
        best = [i for _, i in sorted((-c, i) for c, i in zip(cos.round(12), ids, strict=True) if i != q)[:5]]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[ids.index(i)]) < 1e-12 for _, i, s in got[q])
        hits += len(set(best) & {i for _, i, _ in got[q]})
        total += 5
    assert hits / total >= 0.9
    assert set(got) == {i for i in ids if i % 50 == 0} | {2200} & set(got)
    hot = [i for _, i, _ in got[1000]]
    assert hot == [7, 1001, 1002, 1003, 1004]
    assert ann.nearest(frame.limit(0), lambda i: i % 50 == 0).isEmpty()


def test_neighbours_of_one_direction_go_by_id(spark):
    """Positive multiples of one direction all tie; the smallest ids answer."""
    rows = [(i, [float(2 ** (i % 7)), float(2 ** (i % 7)) * 2.0, 0.0, -float(2 ** (i % 7))]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, lambda i: i % 50 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [i for i in range(6) if i != q][:5] for q in range(0, 900, 50)}


def test_curves_are_added_until_recall_is_reached(spark):
    """Without structure, in windows of a fiftieth of the table, one curve finds little."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1500, 16))
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")

    def recall(**options):
        got = {}
        for r in ann.nearest(frame, lambda i: i % 50 == 0, curves=1, window=30, **options).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        hits = sum(len(got[q] & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) for q in range(0, 1500, 50))
        return hits / 150

    assert recall(recall=0.0) < 0.5
    assert recall() >= 0.9


def test_cut_keeps_columns_whatever_their_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, 4, "a", True, [1]), (2, "before " + text, 5, "b", False, [2]), (2, "x", 6, "c", None, None), (None, "y", 7, "d", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int, _copy string, _spans boolean, others array<int>")
    left = substring.cut(docs, substring.repeats(docs))
    assert left.columns == docs.columns
    told = {r._copy: (r.text, r._row, r._spans, r.others) for r in left.collect()}
    assert told == {"a": (text, 4, True, [1]), "b": ("before ", 5, False, [2]), "c": ("x", 6, None, None), "d": ("y", 7, None, None)}
