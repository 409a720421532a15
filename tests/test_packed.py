import random

import pytest
from test_link import entry, sides, track

from segue.operators import link, packed, search


def odd_sides(spark):
    rng = random.Random(13)
    words = ["love", "you", "night"] + [f"w{i}" for i in range(30)]

    def name():
        return " ".join(rng.choices(words, weights=[20] * 3 + [1] * 30, k=rng.randint(1, 5)))

    tracks = [track(i, name() + rng.choice(["", " (Live)"]), rng.choice(["artist1", "artist2 feat. zed", ""]), ms=200_000) for i in range(80)]
    tracks += [("l", 100, "t100", "Love", None, None, None, None, None), ("l", 101, "t101", None, "artist1", "Al", "x", 0, None), track(102, "nothing", "known")]
    tracks += [track(103, "Coded", "artist1", "us1"), track(104, "Love You", "artist1", "us2")]
    entries = [entry(i, name(), f"artist{rng.randint(0, 3)}", popularity=rng.choice([None, 1, 2]), seconds=rng.choice([None, 200.0, 260.0])) for i in range(160)]
    entries += [entry(1, "love you", "artist1"), entry(1, "love you", "artist1"), entry(200, None, "artist1"), entry(201, "love", None), entry(202, "Coded", "artist1", "US1")]
    entries.append((None, "love night", ["artist1"], None, None, None, 9, None))
    return sides(spark, tracks, entries)


def told(rows, *columns):
    return sorted(map(tuple, (rows.select(*columns) if columns else rows).collect()), key=str)


def test_packed_answers_are_those_of_the_shuffles(spark, monkeypatch):
    t, c = odd_sides(spark)
    pair = ["key", "cand_id", "query_no", "rank", "score"]

    def all_of():
        return [
            told(search.search(t, c), "key", "query_no", "cand_id", "weight", "rank"), told(link.candidate_pairs(t, c), *pair), told(link.needed_pairs(t, c), *pair),
            told(link.staged_pairs(t, c), *pair), told(link.link_tracks(t, c)), told(link.found_pairs(t, c, 12, None, "t_title")),
        ]

    assert search.build_index(c).packed
    here = all_of()
    monkeypatch.setattr(packed, "ENTRIES", 0)
    assert search.build_index(c).packed is None
    for mine, wanted in zip(here, all_of(), strict=True):
        assert wanted and mine == wanted


@pytest.mark.parametrize("few", [3, 100_000])
def test_tracks_and_pairs_stay_where_they_are(spark, monkeypatch, few):
    """Nothing that is searched, met, weighed or scored goes through a shuffle."""
    monkeypatch.setattr(packed, "ROWS", few)
    t, c = odd_sides(spark)
    for rows in (search.search(t, c), link.candidate_pairs(t, c), link.needed_pairs(t, c), link.staged_pairs(t, c), link.link_fuzzy(t, c)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert link.staged_pairs(t, c).count() > 0


def test_an_empty_catalog_answers_nothing(spark):
    t, c = sides(spark, [track(1, "Song", "A")], [entry(1, "Song", "A")])
    none = c.limit(0)
    assert search.search(t, none).collect() == [] and link.staged_pairs(t, none).collect() == []
    assert told(link.link_fuzzy(t, none), "key", "id", "score") == [("q:a|song", None, 0.0)]
