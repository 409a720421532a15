import random

from pyspark.sql import functions as F

from segue.functions.similarity import CATALOG_SIDE, TRACK_SIDE, with_score
from segue.operators import link, search
from segue.operators.pairs import FIELDS, PairScores
from segue.operators.prepare import dedup_groups, prepare_catalog, with_key

TRACK = "library_id string, pos bigint, track_id string, name string, artist string, album string, album_artist string, duration_ms bigint, isrc string"
ENTRY = "cand_id string, name string, artists array<string>, album string, album_id string, duration_s double, popularity int, isrc string"


def sides(spark, tracks, entries):
    t = spark.createDataFrame(tracks, TRACK)
    return link.ready(dedup_groups(with_key(t)), spark.createDataFrame(entries, ENTRY))


def track(i, name, artist, isrc=None, album="Al", ms=0):
    return ("l", i, f"t{i}", name, artist, album, artist, ms, isrc)


def entry(i, name, artist, isrc=None, popularity=0, seconds=None, album="Al"):
    return (f"c{i:04d}", name, [artist], album, f"al{i}", seconds, popularity, isrc)


def brute_search(asked, entries, limit=12):
    """The definition, word for word: {(key, query_no): [(cand_id, weight)]}."""
    df = {}
    for words in {frozenset(w) for *_, w in entries}:
        for w in words:
            df[w] = df.get(w, 0) + 1
    weight = {w: 10**12 // n for w, n in df.items()}
    out = {}
    for key, query_no, terms in asked:
        known = [t for t in terms if t in weight]
        hits = []
        for cand, popularity, words in entries:
            got = sum(weight[t] for t in known if t in words)
            if got:
                hits.append((-got, -popularity, cand))
        out[key, query_no] = [(c, -g) for g, _, c in sorted(hits)[:limit]]
    return {k: v for k, v in out.items() if v}


def test_search_equals_brute_force_under_skew(spark):
    rng = random.Random(7)
    words = ["love", "you", "night", "fire", "rain", "blue", "moon"] + [f"w{i}" for i in range(60)]

    def name():
        return " ".join(rng.choices(words, weights=[30] * 7 + [1] * 60, k=rng.randint(1, 4)))

    # a third of both sides is one title, and a fifth of the catalog exact copies
    tracks = [track(i, "Untitled" if i % 3 == 0 else name(), f"artist{rng.randint(0, 40)}") for i in range(240)]
    entries = [entry(i, "Untitled" if i % 3 == 0 else name(), f"artist{rng.randint(0, 40)}") for i in range(300)]
    entries += [entry(1000 + i, "Love You", "artist1") for i in range(80)]
    t, c = sides(spark, tracks, entries)
    asked = [(r.key, r.query_no, r.terms) for r in search.search_queries(t).collect()]
    words_of = [(r.cand_id, r.popularity, set(f"{r.c_name} {r.c_artist}".split())) for r in c.collect()]
    got = {}
    for r in search.search(t, c).orderBy("rank").collect():
        got.setdefault((r.key, r.query_no), []).append((r.cand_id, r.weight))
    assert got == brute_search(asked, words_of)


def test_a_rare_word_does_not_hide_a_perfect_entry(spark):
    entries = [entry(1, "Blue Moon", "Elvis"), entry(2, "Zanzibar Nights", "Someone")]
    entries += [entry(10 + i, f"Blue Moon v{i}", "Elvis") for i in range(60)]
    found = link.link_tracks(*sides(spark, [track(1, "Blue Moon Zanzibar", "Elvis")], entries)).collect()
    assert [(r.id, r.score >= 78) for r in found] == [("c0001", True)]


def test_equal_answers_go_by_popularity_then_id(spark):
    entries = [entry(i, "Same Title", "Same", popularity=i % 7) for i in range(30)]
    t, c = sides(spark, [track(1, "Same Title", "Same")], entries)
    ranked = [r.cand_id for r in search.search(t, c).filter("query_no = 0").orderBy("rank").collect()]
    assert ranked == [e[0] for e in sorted(entries, key=lambda e: (-e[6], e[0]))[:12]]


def test_code_link_prefers_score_then_popularity_then_id(spark):
    t, c = sides(
        spark,
        [track(1, "Song", "A", "us1"), track(2, "Other", "A", "us2"), track(3, "Qqqq", "A", "us3")],
        [
            entry(1, "Wrong", "Z", "US1", 99), entry(2, "Song", "A", "US1", 1), entry(3, "Song", "A", "US1", 5),
            entry(4, "Song", "A", "US1", 5), entry(5, "Other", "A", "us2"),
        ],
    )
    got = {r.key: (r.id, r.score) for r in link.link_isrc(t, c).collect()}
    assert got == {"isrc:US1": ("c0003", 100.0), "isrc:US2": ("c0005", 100.0)}
    # a code the catalog lacks falls through to the search
    full = {r.key: r.id for r in link.link_tracks(t, c).collect()}
    assert full["isrc:US1"] == "c0003" and set(full) == {"isrc:US1", "isrc:US2", "isrc:US3"} and full["isrc:US3"] is None


def test_fuzzy_link_scores_and_threshold(spark):
    t, c = sides(
        spark,
        [track(1, "Blue Moon", "A", ms=200_000), track(2, "Rare", "B"), track(3, "zzz", "zzz")],
        [entry(1, "Blue Moon", "A", seconds=200.0), entry(2, "Blue Moon", "A", seconds=230.0), entry(3, "Rare Else Thing", "Qqqq", album="no")],
    )
    got = {r.key: (r.id, r.score) for r in link.link_fuzzy(t, c).collect()}
    assert got["q:a|blue moon"] == ("c0001", 103.0)
    assert got["q:b|rare"][0] is None and got["q:b|rare"][1] > 0
    assert got["q:zzz|zzz"] == (None, 0.0)


def test_early_stop_skips_later_queries(spark):
    rows = [("k", "a", 0, 1, 80.0), ("k", "b", 1, 1, 93.0), ("k", "c", 2, 1, 99.0), ("j", "a", 0, 1, 92.0), ("j", "b", 3, 1, 100.0), ("m", "a", 2, 1, 50.0), ("m", "b", 3, 1, 60.0)]
    df = spark.createDataFrame(rows, "key string, cand_id string, query_no int, rank int, score double")
    kept = {(r.key, r.cand_id) for r in link.early_stop(df).collect()}
    assert kept == {("k", "a"), ("k", "b"), ("j", "a"), ("m", "a"), ("m", "b")}


def test_results_do_not_depend_on_partitioning(spark):
    tracks = [track(i, f"Song {i % 7}", f"A{i % 3}") for i in range(60)]
    entries = [entry(i, f"Song {i % 9}", f"A{i % 4}") for i in range(50)]
    one = sorted(map(tuple, link.link_tracks(*sides(spark, tracks, entries)).collect()), key=str)
    t = spark.createDataFrame(tracks[::-1], TRACK).repartition(13)
    c = spark.createDataFrame(entries[::-1], ENTRY).repartition(11)
    two = sorted(map(tuple, link.link_tracks(*link.ready(dedup_groups(with_key(t)), c)).collect()), key=str)
    assert one == two


def test_plan_has_no_cross_join(spark):
    t, c = sides(spark, [track(1, "Song", "A")], [entry(1, "Song", "A")])
    plan = link.link_tracks(t, c)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert prepare_catalog(spark.createDataFrame([entry(1, "S", "A")], ENTRY)).select(F.col("c_title")).first()[0] == "s"


def random_sides(spark, seed):
    rng = random.Random(seed)
    words = ["love", "you", "night"] + [f"w{i}" for i in range(40)]

    def name():
        return " ".join(rng.choices(words, weights=[20] * 3 + [1] * 40, k=rng.randint(1, 5)))

    tracks = [track(i, name() + rng.choice(["", " (Live)"]), f"artist{rng.randint(0, 6)}", album=f"Al{i % 3}", ms=200_000) for i in range(150)]
    entries = [entry(i, t[3], t[4], popularity=i % 5, seconds=200.0) for i, t in enumerate(tracks[::3])]
    entries += [entry(500 + i, name(), f"artist{rng.randint(0, 6)}", seconds=180.0) for i in range(150)]
    return sides(spark, tracks, entries)


def test_stages_ask_for_no_more_than_needed(spark):
    t, c = random_sides(spark, 3)
    every = link.candidate_pairs(t, c)
    wanted = sorted(map(tuple, link.early_stop(every).select("key", "cand_id", "query_no", "rank", "score").collect()))
    staged = link.staged_pairs(t, c)
    assert sorted(map(tuple, staged.select("key", "cand_id", "query_no", "rank", "score").collect())) == wanted
    assert len(wanted) < every.count()
    counted = {r.query_no: (r.n_keys, r.n_pairs, r.n_settled) for r in link.stage_counts(staged).collect()}
    first = [w for w in wanted if w[2] == 0]
    assert counted[0] == (len({w[0] for w in first}), len(first), len({w[0] for w in first if w[4] >= 92}))


def test_strings_are_compared_once(spark):
    t, c = random_sides(spark, 4)
    scores = PairScores(t, c)
    pairs = link.first_query_pairs(search.search(t, c)).select("key", "cand_id")
    half = pairs.filter(F.crc32("key") % 2 == 0)
    scores.score(half)
    one = sorted(map(tuple, scores.score(pairs).collect()))
    seen = [(r.a, r.b) for r in scores.ratios.select("a", "b").collect()]
    texts = {r.string: r.text for r in scores.strings.collect()}
    assert len(texts) == len(set(texts.values()))
    sides_of = pairs.join(t, "key").join(c.withColumnsRenamed({"name": "c_own", "album": "c_of"}), "cand_id").collect()
    wanted = {(r[a], r[b]) for r in sides_of for a, b in FIELDS.values()}
    assert len(seen) == len(set(seen)) and {(texts[a], texts[b]) for a, b in seen} == wanted
    rows = pairs.join(t.select("key", *TRACK_SIDE), "key").join(c.select("cand_id", *CATALOG_SIDE), "cand_id")
    assert one == sorted(map(tuple, with_score(rows).select("key", "cand_id", "score").collect()))


def test_lookups_stop_at_the_floor(spark):
    """Words that half the catalog holds are looked up in whole for no query that has rarer ones enough."""
    entries = [entry(i, f"common rare{i // 20}", "same") for i in range(400)]
    t, c = sides(spark, [track(1, "common rare3", "same"), track(2, "common", "same"), track(3, "common rare3 rare4", "same")], entries)
    index = search.build_index(c)
    assert index.entries.count() == 20 and index.heads.groupBy("code").count().agg(F.max("count")).first()[0] <= search.HEAD
    many = [entry(i, f"common r{i // 20} x{i}", "same") for i in range(400)]
    t, c = sides(spark, [track(1, "common r3", "same")], many)
    index = search.build_index(c)
    asked = search.lookups(search.distinct_searches(search.known_words(t, index)), index)
    whole = {r.code >> search.NUMBER_BITS for r in asked.filter(F.col("at") < F.size("codes") - 1).collect()}
    assert whole == {20}
    weights = [10**12 // 20 + 2 * (10**12 // 400)] * 12
    assert [r.weight for r in search.search(t, c).filter("query_no = 0").collect()] == weights


def test_scoring_moves_no_keys_and_reads_each_side_once(spark):
    """Pairs are joined once by entry and once by track number, not once for each compared field."""
    t, c = random_sides(spark, 5)
    scored = link.candidate_pairs(t, c)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "cand_id#" in line for line in plan.splitlines()) == 1
    rows = scored.select("key", "cand_id").join(t.select("key", *TRACK_SIDE), "key").join(c.select("cand_id", *CATALOG_SIDE), "cand_id")
    wanted = sorted(map(tuple, with_score(rows).select("key", "cand_id", "score").collect()))
    assert sorted(map(tuple, scored.select("key", "cand_id", "score").collect())) == wanted
    assert sorted(map(tuple, link.needed_pairs(t, c).select("key", "cand_id", "query_no", "rank", "score").collect())) == sorted(
        map(tuple, link.early_stop(scored).select("key", "cand_id", "query_no", "rank", "score").collect())
    )


def test_postings_tell_what_an_entry_can_still_weigh(spark):
    t, c = random_sides(spark, 6)
    index = search.build_index(c)
    for r in search._postings(index.entries).collect():
        later = [x for x in r.entry_codes if x >= r.code]
        assert r.rest == sum(10**12 // (x >> search.NUMBER_BITS) for x in later)
    assert {"rest"} <= set(index.heads.columns)


def test_code_link_needs_only_tracks_with_a_known_code(spark):
    tracks = spark.createDataFrame([track(1, "Song", "A", "us1"), track(2, "Song", "A"), track(3, "Song", "A", "none"), track(4, "Song", "A", "")], TRACK)
    c = prepare_catalog(spark.createDataFrame([entry(1, "Song", "A", "US1"), entry(2, "Song", "A", "")], ENTRY))
    assert [r.track_id for r in link.coded(tracks, c).collect()] == ["t1"]


def test_words_of_a_search_move_once(spark):
    """What is looked up carries no list of the search's words, and neither do the pairs met."""
    t, c = random_sides(spark, 8)
    index = search.build_index(c)
    searches = search.distinct_searches(search.known_words(t, index))
    met = search._met(search.lookups(searches, index), index.heads)
    assert met.columns == ["search", "floor", "entry", "later"]
    by_search = {r.search: r.codes for r in searches.collect()}
    of_entry = {r.entry: set(r.codes) for r in index.entries.collect()}
    for r in search._judged(met, searches).collect():
        assert r.weight <= sum(10**12 // (x >> search.NUMBER_BITS) for x in set(by_search[r.search]) & of_entry[r.entry])


def test_entry_columns_that_are_alike_score_as_given(spark):
    """A name like its title or a lead like its artist is not moved; nulls and differences stay."""
    t, _ = random_sides(spark, 9)
    columns = "cand_id string, c_title string, c_name string, c_artist string, c_lead string, c_album string, c_duration_s double"
    rows = [("a", "w1 w2", "w1 w2", "artist1", "artist1", "al1", 1.0), ("b", "w1", "w1 live", "artist1 artist2", "artist1", "al1", None),
            ("c", "w1", None, "artist1", None, None, 200.0), ("d", None, "w1", None, "artist1", "al2", 200.0), ("e", None, None, None, None, None, None)]
    c = spark.createDataFrame(rows, columns)
    pairs = t.select("track").crossJoin(c.select("cand_id"))
    wanted = with_score(pairs.join(c, "cand_id").join(t.select("track", *TRACK_SIDE), "track")).select("track", "cand_id", "score")
    assert sorted(map(tuple, link.scored(t, c, pairs, "track").collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_known_words_are_those_of_each_query(spark):
    """A word's queries are told by bits; only numbers are collected for a track."""
    tracks = [track(1, "Blue Moon (Live)", "A feat. B"), track(2, "Moon", "Moon"), ("l", 3, "t3", "Rain", "A & B", "Al", "C", 0, None), ("l", 4, "t4", "Blue Blue", "", "", "", 0, None), ("l", 5, "t5", "Fire", None, None, None, None, None)]
    entries = [entry(i, n, a) for i, (n, a) in enumerate([("Blue Moon live", "a"), ("Rain", "b"), ("Moon feat", "c"), ("Fire Blue", "a b")])]
    t, c = sides(spark, tracks, entries)
    index = search.build_index(c)
    code = {r.term: r.code for r in index.terms.collect()}
    wanted = {(r.key, r.query_no): sorted(code[w] for w in r.terms if w in code) for r in search.search_queries(t).collect()}
    got = {(r.key, r.query_no): r.codes for r in search.known_words(t, index).collect()}
    assert got == {k: v for k, v in wanted.items() if v and k[0] is not None}
    plan = search.with_queries(t.drop("asked", "terms", "track"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(struct" not in plan and "filter(array(CASE" not in plan


def test_queries_of_a_track_are_searched_at_once(spark, monkeypatch):
    """Entries are met once for all queries of a track; each answers at the first query that returns it."""
    tracks = [
        track(1, "Blue Moon (Live)", "A feat. Zed"), track(2, "Zed - feat. Moon", "Moon"), ("l", 3, "t3", "Rain Rain", "A & B", "Al", "C", 0, None),
        ("l", 4, "t4", "Blue", "", "", "", 0, None), ("l", 5, "t5", "Moon", None, None, None, None, None), track(6, "nothing", "known"),
    ]
    entries = [entry(i, f"{['Blue', 'Moon', 'Rain', 'Zed', 'Live'][i % 5]} {['moon', 'x'][i % 2]}", ["a", "b", "c", "zed"][i % 4], popularity=i % 3) for i in range(90)]
    for t, c in (sides(spark, tracks, entries), random_sides(spark, 11)):
        every = search.search_by(["track"], t, c)
        wanted = sorted(map(tuple, link.first_query_pairs(every, "track").select("track", "cand_id", "query_no", "rank").collect()))
        assert {w[2] for w in wanted} > {0}
        index = search.build_index(c)
        words = search.known_ways(t, index)
        searches = search.told_apart(words.select("search_id", "codes", "lacks").distinct())
        found = words.join(searches.select("search_id", "search"), "search_id").join(search.answer_ways(searches, index), "search")
        assert sorted(map(tuple, found.select("track", "cand_id", "query_no", "rank").collect())) == wanted
        calls = []
        monkeypatch.setattr(link, "answer_ways", lambda *a: calls.append(1) or search.answer_ways(*a))
        staged = link.staged_pairs(t, c)
        assert calls == [1]
        kept = link.early_stop(link.candidate_pairs(t, c)).select("key", "cand_id", "query_no", "rank", "score")
        assert sorted(map(tuple, staged.select("key", "cand_id", "query_no", "rank", "score").collect())) == sorted(map(tuple, kept.collect()))


def test_an_id_listed_twice_answers_twice(spark):
    entries = [entry(1, "Blue Moon", "Elvis"), entry(1, "Blue Moon", "Elvis"), entry(2, "Blue Sky", "Elvis")]
    staged = link.staged_pairs(*sides(spark, [track(1, "Blue Moon Zanzibar", "Elvis")], entries))
    assert sorted((r.cand_id, r.query_no, r["rank"]) for r in staged.collect()) == [("c0001", 0, 1)] * 2 + [("c0001", 0, 2)] * 2 + [("c0002", 0, 3)]
