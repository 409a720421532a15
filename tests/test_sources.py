"""Readers: page libraries, property lists, what cannot be read, the dictionary of names."""

import json
import plistlib

import pytest
from pyspark.sql import functions as F

from segue.operators import decisions as dec
from segue.operators import forms
from segue.plans import report, reset
from segue.schemas import DECISIONS, TRACK_PAGE
from segue.sources import json_export, page_dumps, plist_export

PAGE = "collection string, offset bigint, body string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


# --------------------------------------------------------------------------- page libraries
def track(ident, name="N", **more):
    return {"id": ident, "name": name, "artists": [{"name": "A"}], "album": {"name": "Al", "artists": [{"name": "B"}]}, **more}


def test_page_library(spark):
    saved = [
        ("l", 0, {"items": [{"track": track("t1", "First")}, None, {"track": track("t2", is_local=True)}]}),
        ("l", 50, {"items": [{"track": track("t1", "Later")}, {"track": track("t3", type="episode")}, {"track": track(None)}]}),
        ("m", 0, {"items": [{"track": track("t1", "Other library")}]}),
    ]
    lists = [
        ("l", 0, {"items": [{"id": "p1", "name": "Mine", "owner": {"id": "me"}}, {"id": "p2", "owner": {"id": "you"}}]}),
        ("l", 50, {"items": [{"id": "p3", "name": None, "collaborative": True}, {"id": "p4", "name": "Empty", "owner": {"id": "me"}}]}),
    ]
    listed = [
        ("p3", 0, {"items": [{"item": track("t5", "Of p3")}, {"track": track("t4", "Of p3")}]}),
        ("p1", 50, {"items": [{"track": track("t4", "Of p1")}, {"track": track("t4", "Of p1")}]}),
        ("p1", 0, {"items": [{"track": track("t1", "Listed")}]}),
        ("p2", 0, {"items": [{"track": track("t9")}]}),
        ("p4", 0, {"items": [None, {"track": None}]}),
    ]
    albums = [("l", 0, {"items": [{"album": {"name": "X", "total_tracks": 3, "external_ids": {"upc": "1"}}}, {"album": {"name": ""}}, {}]})]
    pages = [spark.createDataFrame([(c, o, json.dumps(b)) for c, o, b in p], PAGE) for p in (saved, lists, listed, albums)]
    library = page_dumps.page_library(*pages, me=F.lit("me"))
    assert rows(library.tracks, "library_id", "track_id", "name", "loved", "album_artist") == [
        ("l", "t1", "First", True, "B"), ("l", "t4", "Of p1", False, "B"), ("l", "t5", "Of p3", False, "B"), ("m", "t1", "Other library", True, "B"),
    ]
    assert rows(library.playlists, "playlist_id", "name", "n_items") == [("p1", "Mine", 3), ("p3", "", 2)]
    assert rows(library.items, "playlist_id", "pos", "track_id") == [("p1", 0, "t1"), ("p1", 50, "t4"), ("p1", 51, "t4"), ("p3", 0, "t5"), ("p3", 1, "t4")]
    assert rows(library.albums, "library_id", "pos", "name", "artist", "track_count", "upc") == [("l", 0, "X", "", 3, "1")]


# --------------------------------------------------------------------------- quarantine
def test_json_quarantine(spark):
    good = json.dumps({"songs": [{"id": "1", "name": "S"}]})
    texts = spark.createDataFrame([("a", good), ("b", good[:-2]), ("c", ""), ("d", None), ("e", "[1"), ("f", "{}")], "library_id string, body string")
    split = json_export.split_exports(texts)
    assert rows(split.rows, "library_id") == [("a",), ("f",)]
    assert split.counts.get == {"n_read": 6, "n_rejected": 4}
    assert rows(split.rejected, "source", "reason", "body") == [("b", "malformed", good[:-2]), ("c", "empty", ""), ("d", "empty", None), ("e", "malformed", "[1")]
    assert rows(json_export.song_rows(json_export.parse_exports(texts)), "library_id", "track_id") == [("a", "1")]
    pages = page_dumps.split_pages(spark.createDataFrame([("c", 0, '{"items":[]}'), ("c", 50, '{"items":[')], PAGE), TRACK_PAGE)
    assert rows(pages.rejected, "reader", "source", "body") == [("page", "c", '{"items":[')]


def test_decision_quarantine(spark):
    nan = float("nan")
    told = [("q:a", "1", 90.0, 78.0), (None, "1", 90.0, 78.0), ("", "1", 90.0, 78.0), ("q:b", None, nan, 78.0), ("q:c", None, 0.0, None)]
    frame = spark.createDataFrame([(k, i, s, "t", "a", None, h) for k, i, s, h in told], DECISIONS)
    split = dec.split_sound(frame)
    assert rows(split.rows, "key") == [("q:a",)]
    assert rows(split.rejected, "source", "reason") == [("", "no key"), ("q:b", "no score"), ("q:c", "no threshold"), (None, "no key")]


# --------------------------------------------------------------------------- property lists
LIBRARY = {
    "Major Version": 1,
    "Tracks": {
        "10": {"Name": "One & <two>", "Artist": "Ä", "Total Time": 1000, "Loved": True, "Year": 1999, "Kind": "audio", "Extra": {"Name": "not this"}},
        "11": {"Name": "Film", "Has Video": True, "Tags": ["Name", "x"]},
        "12": {"Name": "", "Kind": "audio"},
    },
    "Folder": "/x",
    "Playlists": [
        {"Name": "Library", "Master": True, "Playlist Items": [{"Track ID": 10}]},
        {"Name": "Mix", "Smart Info": b"x", "Playlist Items": [{"Track ID": 10}, {"Track ID": 11}, {"Track ID": 10}], "All Items": True},
        {"Playlist Items": []},
        {"Name": "Empty"},
    ],
}


def test_property_list_events_equal_the_whole_parse():
    content = plistlib.dumps(LIBRARY)

    def told(found):
        return sorted((json.dumps({k: v for k, v in r.items() if v is not None}, sort_keys=True) for r in found))

    assert told(plist_export._file_rows("l", content)) == told(plist_export._binary_rows("l", content))
    binary = plistlib.dumps(LIBRARY, fmt=plistlib.FMT_BINARY)
    assert told(plist_export._file_rows("l", binary)) == told(plist_export._binary_rows("l", content))


def test_property_lists(spark):
    content = plistlib.dumps(LIBRARY)
    files = spark.createDataFrame([("l", content), ("cut", content[:-30]), ("none", None), ("junk", b"\x00\x01")], "library_id string, content binary")
    parsed = plist_export.parsed_once(files)
    assert rows(plist_export.tracks(parsed), "library_id", "track_id", "name", "artist", "duration_ms", "loved", "year") == [
        ("l", "10", "One & <two>", "Ä", 1000, True, 1999)
    ]
    assert rows(plist_export.items(parsed), "playlist_name", "smart", "pos", "track_id") == [("Mix", True, 0, "10"), ("Mix", True, 2, "10")]
    assert rows(plist_export.rejected(parsed), "source", "reason") == [("cut", "malformed"), ("junk", "malformed"), ("l", "no name"), ("none", "malformed")]
    plan = plist_export.items(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "what=item" not in plan and plan.count("PartitionFilters") >= 2
    plist_export.register(spark)
    files.createOrReplaceTempView("plist_files")
    found = spark.sql("select p.id, p.Name from plist_files f, lateral property_list(f.library_id, f.content) p where p.what = 'track'")
    assert rows(found) == [("10", "One & <two>"), ("11", "Film"), ("12", "")]


# --------------------------------------------------------------------------- names
def test_dictionary_of_names(spark, tmp_path):
    table = forms.forms_table(spark, str(tmp_path), buckets=4)
    plain = spark.createDataFrame([("Abc & D",), ("É b",), ("Abc & D",), (None,)], "name string")
    assert rows(forms.learn(plain, table)) == [("Abc & D", "abc and d"), ("É b", "e b")]
    done = table.current()
    forms.learn(plain, table)
    assert table.current() == done  # nothing new: nothing written
    assert "Arrow" not in forms.normalised(plain)._jdf.queryExecution().executedPlan().toString()
    more = plain.unionByName(spark.createDataFrame([("ﬁne ΣΑΣ",), ("1 ½",)], "name string"))
    told = forms.with_normal(more.withColumn("n", F.lit(1)), "name", "normal", table)
    assert rows(told, "name", "normal") == [
        ("1 ½", "1 1 2"), ("Abc & D", "abc and d"), ("Abc & D", "abc and d"), ("É b", "e b"), ("ﬁne ΣΑΣ", "fine σας"), (None, None),
    ]


# --------------------------------------------------------------------------- plans
def test_report_cells_are_bounded_by_names(spark):
    tracks = spark.createDataFrame([("l", "t", "q:a", "A", "T", "Al")], "library_id string, track_id string, key string, artist string, name string, album string")
    lists = spark.createDataFrame([("l", "p", 1, "Often"), ("l", "q", 0, "Once")], "library_id string, playlist_id string, pos bigint, name string")
    uses = spark.range(2500).select(F.lit("l").alias("library_id"), F.lit("p").alias("playlist_id"), F.col("id").alias("pos"), F.lit("t").alias("track_id"))
    uses = uses.unionByName(spark.createDataFrame([("l", "q", 0, "t")], uses.schema))
    none = spark.createDataFrame([], DECISIONS)
    told = report.unmatched_report(tracks, tracks, none, uses, lists)
    cells = {r.part: r.playlists.split("; ") for r in told.collect()}
    assert {p: len(c) for p, c in cells.items()} == {0: 1000, 1: 1000, 2: 501}
    assert cells[0][:2] == ["Once", "Often"] and set(cells[1]) == {"Often"}


@pytest.mark.parametrize("left", [[], [("a", "p", 0, "Mix", True)]])
def test_reset_holds_back_what_is_not_verified(spark, left):
    shape = "library_id string, playlist_id string, pos bigint, name string, own boolean"
    lists = spark.createDataFrame([("a", "p", 0, "Mix", True), ("a", "f", 1, "Followed", False), ("b", "r", 0, "Mix", True)], shape)
    items = spark.createDataFrame([("a", "p", 0, "t1", "N")], "library_id string, playlist_id string, pos bigint, track_id string, track_name string")
    stars = spark.createDataFrame([("a", "track", "t1", "N", 0), ("a", "artist", "x", "X", 1)], "library_id string, kind string, id string, name string, pos bigint")
    backup, deletions = reset.plan(lists, items, stars, None, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert rows(deletions, "library_id", "kind", "id") == [("a", "playlist", "p"), ("a", "track", "t1"), ("b", "playlist", "r")]
    done = reset.verify(backup, deletions, spark.createDataFrame(left, shape), stars.limit(0))
    assert rows(done.gate) == [("a", not left), ("b", True)]
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "library_id string, n int")
    assert rows(reset.gated(new, done.gate), "library_id") == [("a",)] * (not left) + [("b",), ("c",)]


def test_union_moves_the_values_of_a_row_once(spark):
    """A row counts for the song list or for the playlists; ties and places are as before."""
    from segue.sources import json_export as je

    fields = [c for c in je.TRACK_FIELDS]
    text = lambda v: [{"duration_ms": 1, "loved": False}.get(c, v) for c in fields]
    kinds = ", ".join(f"{c} {dict(duration_ms='bigint', loved='boolean').get(c, 'string')}" for c in fields)
    songs = spark.createDataFrame([("l", "a", 0, *text("first")), ("l", "a", 2, *text("last"))], f"library_id string, track_id string, pos bigint, {kinds}")
    extra = spark.createDataFrame(
        [("l", "a", 0, 0, *text("x")), ("l", "b", 1, 0, *text("late")), ("l", "b", 0, 4, *text("m")), ("l", "b", 0, 4, *text("k"))],
        f"library_id string, track_id string, playlist_pos int, pos bigint, {kinds}",
    )
    out = je.union_tracks(songs, extra)
    assert "min(CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.track_id, r.part, r.playlist_pos, r.pos, r.name) for r in out.collect()) == [("a", 0, 0, 0, "last"), ("b", 1, 0, 4, "k")]
