import json
import plistlib
import random

import pytest
from pyspark.sql import functions as F

from segue.operators import account, albums, ranking, selection
from segue.operators import decisions as dec
from segue.plans import report, writes
from segue.schemas import ALBUM_PAGE, DECISIONS, SEARCH_PAGE, TRACK_PAGE
from segue.sinks import tables as sinks
from segue.sources import json_export, page_dumps, plist_export


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ----------------------------------------------------------------- ranks and chunks
def test_rank_of_hot_and_small_groups(spark):
    rng = random.Random(7)
    rows = [("hot", p) for p in rng.sample(range(10**12), 500)] + [(f"g{i}", p) for i in range(50) for p in rng.sample(range(100), 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, pos bigint")
    got = {(r.g, r.pos): r["rank"] for r in ranking.rank_by_position(df, ["g"], "pos").collect()}
    expected = {}
    for g in {g for g, _ in rows}:
        for n, pos in enumerate(sorted(p for h, p in rows if h == g), 1):
            expected[g, pos] = n
    assert got == expected


def test_chunks_keep_order(spark):
    df = spark.createDataFrame([("g", n, f"i{n}") for n in range(1, 246)], "g string, rank int, id string")
    got = {r.chunk: r.ids for r in ranking.chunked(df.repartition(7), ["g"], "id", 100).collect()}
    assert [len(got[c]) for c in sorted(got)] == [100, 100, 45]
    assert got[0] + got[1] + got[2] == [f"i{n}" for n in range(1, 246)]


# ----------------------------------------------------------------- decisions
@pytest.mark.parametrize(
    "ident,score,known,rematch,needed",
    [
        (None, None, None, False, True), ("c", 80.0, True, False, False), ("c", 77.0, True, False, True),
        (None, 80.0, True, False, True), (None, 70.0, True, False, False), (None, 70.0, True, True, True),
        ("c", 80.0, True, True, False), (None, None, True, False, False), ("c", None, True, False, True),
    ],
)
def test_needs_match(spark, ident, score, known, rematch, needed):
    df = spark.createDataFrame([(ident, score, known)], "id string, score double, known boolean")
    assert df.select(dec.needs_match(78.0, rematch)).first()[0] is needed


def decision(key, ident, score):
    return (key, ident, score, "", "", None, 78.0)


def test_merge_then_no_work(spark):
    old = spark.createDataFrame([decision("q:a", "1", 90.0), decision("q:b", None, 90.0)], DECISIONS)
    keys = spark.createDataFrame([("q:a",), ("q:b",), ("q:c",)], "key string")
    work = dec.work_list(keys, old)
    assert tuples(work, "key", "stale") == [("q:b", True), ("q:c", False)]
    new = work.select("key", F.lit("9").alias("id"), F.lit(99.0).alias("score"), F.lit("").alias("title"), F.lit("").alias("artist"), F.lit(None).cast("string").alias("album_id"), F.lit(78.0).alias("threshold"))
    merged = dec.merge(old, new)
    assert tuples(merged, "key", "id") == [("q:a", "1"), ("q:b", "9"), ("q:c", "9")]
    assert dec.work_list(keys, merged).count() == 0


def test_rekey_and_legacy_names(spark):
    tracks = spark.createDataFrame([("t1", "q:a|x"), ("t2", "q:a|x"), ("t3", "q:b|y")], "track_id string, key string")
    shape = "key string, pos bigint, id string, old_id string, score double"
    old = spark.createDataFrame([("t2", 0, None, "2", 1.0), ("t1", 1, "1", None, 1.0), ("t3", 2, None, None, 50.0), ("gone", 3, "7", None, 1.0)], shape)
    assert tuples(dec.rename_legacy(dec.rekey(old, tracks), "old"), "key", "id") == [("q:a|x", "2"), ("q:b|y", None)]
    current = spark.createDataFrame([("q:a|x", 0, "2", None, 1.0), ("t1", 1, "1", None, 1.0)], shape)
    assert tuples(dec.rekey(current, tracks), "key", "id") == [("q:a|x", "2"), ("t1", "1")]


def test_upc_memo(spark):
    declared = spark.createDataFrame([("1",), ("2",), ("3",), ("",), (None,), ("1",)], "upc string")
    memo = spark.createDataFrame([("1", "a"), ("2", None)], "upc string, album_id string")
    catalog = spark.createDataFrame([("2", "z", 5), ("2", "b", 1)], "upc string, album_id string, pos bigint")
    assert tuples(dec.upc_todo(declared, memo), "upc") == [("3",)]
    assert tuples(dec.upc_memo(declared, memo, catalog), "upc", "album_id") == [("1", "a"), ("2", None), ("3", None)]
    assert tuples(dec.upc_memo(declared, memo, catalog, True), "upc", "album_id") == [("1", "a"), ("2", "b"), ("3", None)]


# ----------------------------------------------------------------- albums
def test_albums(spark):
    shape = "library_id string, pos bigint, key string, album string, album_artist string"
    rows = [("l", i, f"k{i}", "Big", "A") for i in range(5)] + [("l", 9, "k9", "Tie", "A"), ("l", 10, "k10", "Tie", "A"), ("l", 11, "k11", "", "A")]
    tracks = spark.createDataFrame(rows, shape)
    found = spark.createDataFrame([("k0", "x"), ("k1", "x"), ("k2", "y"), ("k3", "x"), ("k9", "p"), ("k10", "q")], "key string, album_id string")
    got = tuples(albums.album_majority(tracks, found), "album_key", "n_tracks", "n_matched", "album_id")
    assert got == [("big", 5, 4, "x"), ("tie", 2, 2, None)]
    assert tuples(albums.guess_albums(tracks, found), "name", "artist", "track_count", "album_id") == [("Big", "A", 5, "x")]
    declared = spark.createDataFrame(
        [("l", 0, "Big", "a", 1, None), ("l", 1, "Coded", "B", 1, "u1"), ("l", 2, "Again", "B", 1, "u1"), ("l", 3, "Tie", "A", 1, "u2")],
        "library_id string, pos bigint, name string, artist string, track_count int, upc string",
    )
    codes = spark.createDataFrame([("u1", "c"), ("u2", None)], "upc string, album_id string")
    assert tuples(albums.resolve_albums(declared, tracks, found, codes), "name", "album_id", "source") == [("Big", "x", "tracks"), ("Coded", "c", "upc")]


# ----------------------------------------------------------------- sources
def test_json_export_file(spark, tmp_path):
    export = {
        "songs": [
            {"id": 1, "name": "A", "artist": "x", "isrc": "", "year": "", "duration_ms": None},
            {"id": "2", "name": "", "artist": "x"},
            {"id": "1", "name": "A2", "artist": "y", "album_artist": "", "year": "1999", "loved": True},
        ],
        "playlists": [
            {"name": "P", "tracks": [{"id": "1", "name": "zz"}, {"id": "3", "name": "C"}, {"id": "4"}, {"id": "3", "name": "C2"}]},
            {"name": "Empty", "tracks": []},
        ],
        "albums": [{"name": "Al", "upc": 77}, {"artist": "nameless"}],
    }
    (tmp_path / "lib.json").write_text(json.dumps(export, indent=1))
    tables = json_export.read_exports(spark, str(tmp_path))
    songs, listed = json_export.song_rows(tables), json_export.playlist_rows(tables)
    assert tuples(songs, "track_id", "name", "album_artist", "year", "isrc") == [("1", "A", "x", None, None), ("1", "A2", "y", 1999, None)]
    assert tuples(json_export.playlists(listed), "name", "n_items") == [("P", 3)]
    assert tuples(json_export.album_rows(tables), "name", "artist", "track_count", "upc") == [("Al", "", 0, "77")]
    # last values of a repeated song at its first place; library before playlist; first playlist row
    assert tuples(json_export.union_tracks(songs, listed), "track_id", "part", "pos", "name", "loved") == [("1", 0, 0, "A2", True), ("3", 1, 1, "C", False)]
    assert tuples(json_export.union_tracks(songs, listed, True), "track_id", "name", "loved") == [("1", "A", True), ("3", "C", False)]


def test_plist_export_file(spark, tmp_path):
    library = {
        "Tracks": {
            "1": {"Name": "A", "Artist": "x", "Total Time": 5000, "Loved": True, "Year": 2001},
            "2": {"Name": "Clip", "Kind": "MPEG-4 Video file"}, "3": {"Name": "Cast", "Podcast": True}, "4": {"Artist": "x"},
            "5": {"Name": "B", "Artist": "y", "Album Artist": ""}, "6": {"Name": "Film", "Movie": True},
        },
        "Playlists": [
            {"Name": "Library", "Playlist Items": [{"Track ID": 1}]}, {"Name": "M", "Master": True, "Playlist Items": [{"Track ID": 1}]},
            {"Name": "Mine", "Playlist Items": [{"Track ID": 5}, {"Track ID": 2}, {"Track ID": 1}, {"Track ID": 1}]},
            {"Name": "Auto", "Smart Info": b"", "Playlist Items": [{"Track ID": 1}]}, {"Name": "Videos", "Playlist Items": [{"Track ID": 2}]},
        ],
    }
    (tmp_path / "lib.xml").write_bytes(plistlib.dumps(library))
    rows = plist_export.parse_exports(plist_export.read_exports(spark, str(tmp_path)))
    assert tuples(plist_export.tracks(rows), "track_id", "name", "album_artist", "duration_ms", "loved", "year") == [("1", "A", "x", 5000, True, 2001), ("5", "B", "", 0, False, None)]
    assert tuples(plist_export.items(rows), "playlist_name", "smart", "pos", "track_id") == [("Auto", True, 0, "1"), ("Mine", False, 0, "5"), ("Mine", False, 2, "1"), ("Mine", False, 3, "1")]


def test_page_dumps(spark):
    def dump(body, root=None):
        text = json.dumps({root: body} if root else body)
        return spark.createDataFrame([("c", 50, text)], "collection string, offset bigint, body string")

    track = {"id": "1", "name": "A", "artists": [{"name": "x"}, {"name": "y"}], "album": {"name": "L", "release_date": "1999-05", "artists": []}, "external_ids": {"isrc": "Q"}, "duration_ms": 9}
    page = {"items": [{"track": track}, None, {"track": {"id": "2", "is_local": True}}, {"item": {"id": "3", "type": "episode"}}, {"track": {"name": "no id"}}, {"track": None}]}
    items = page_dumps.page_items(dump(page), TRACK_PAGE)
    assert tuples(items, "pos") == [(50,), (52,), (53,), (54,), (55,)]
    assert tuples(page_dumps.saved_tracks(items), "track_id", "artist", "album_artist", "year", "isrc", "pos") == [("1", "x", "x", 1999, "Q", 50)]
    found = {"items": [{"id": "1", "name": "A", "is_playable": None, "duration_ms": 0}, {"id": "2", "is_playable": False}, {"name": "none"}, {"id": "4", "is_playable": True, "duration_ms": 1500, "artists": [{"name": "x"}]}]}
    entries = page_dumps.catalog_entries(page_dumps.page_items(dump(found, "tracks"), SEARCH_PAGE, "tracks"))
    assert tuples(entries, "cand_id", "duration_s", "popularity", "artists") == [("1", None, 0, []), ("4", 1.5, 0, ["x"])]
    saved = {"items": [{"album": {"name": "L", "total_tracks": 3, "artists": [{"name": "x"}], "external_ids": {"upc": "7"}}}, {"album": {"name": ""}}]}
    assert tuples(page_dumps.saved_albums(page_dumps.page_items(dump(saved), ALBUM_PAGE)), "name", "artist", "track_count", "upc") == [("L", "x", 3, "7")]


# ----------------------------------------------------------------- plans and account
def test_playlist_plan_counts_repeats_as_missing(spark):
    items = spark.createDataFrame([("l", "p", 0, "1"), ("l", "p", 1, "2"), ("l", "p", 2, "1"), ("l", "p", 3, "3"), ("l", "e", 0, "3")], "library_id string, playlist_id string, pos bigint, track_id string")
    ids = spark.createDataFrame([("l", "1", "b"), ("l", "2", "a"), ("l", "3", None)], "library_id string, track_id string, id string")
    matched = writes.matched_items(items, ids)
    lists = spark.createDataFrame([("l", "p", "N"), ("l", "e", "N"), ("l", "none", "N")], "library_id string, playlist_id string, name string")
    plan = writes.playlist_plan(lists, matched)
    assert tuples(plan, "playlist_id", "n_items", "n_kept", "n_missing", "skip") == [("e", 1, 0, 1, True), ("p", 4, 2, 2, False)]
    assert tuples(writes.playlist_entries(matched), "rank", "id") == [(1, "b"), (2, "a")]
    for existing, overwrite, action in [([], False, "create"), (["N"], False, "skip_exists"), (["N"], True, "replace"), (["N", "N"], True, "skip_ambiguous")]:
        have = spark.createDataFrame([("l", n) for n in existing], "library_id string, name string")
        assert tuples(writes.playlist_actions(plan, have, overwrite), "playlist_id", "action") == [("e", "skip_no_match"), ("p", action)]


def test_report_continues_long_cells(spark):
    tracks = spark.createDataFrame([("l", "t", "k", "A", "N", "Al")], "library_id string, track_id string, key string, artist string, name string, album string")
    lists = spark.createDataFrame([("l", f"p{i}", i, f"P{i}") for i in range(5)], "library_id string, playlist_id string, pos bigint, name string")
    items = spark.createDataFrame([("l", f"p{i}", j, "t") for i in range(5) for j in range(1 + (i == 1))], "library_id string, playlist_id string, pos bigint, track_id string")
    none = spark.createDataFrame([], DECISIONS)
    assert tuples(report.unmatched_report(tracks, tracks, none, items, lists), "best_score", "playlists", "part") == [(0.0, "P0; P1; P1; P2; P3; P4", 0)]
    assert tuples(report.unmatched_report(tracks, tracks, none, items, lists, 2), "playlists", "part") == [("P0; P1; P1", 0), ("P2; P3", 1), ("P4", 2)]


def test_dry_run_needs_every_track_where_nothing_else_does(spark):
    tracks = spark.createDataFrame([("a", "1", True), ("a", "2", False), ("b", "3", False)], "library_id string, track_id string, loved boolean")
    items = spark.createDataFrame([], "library_id string, track_id string")
    need = lambda **o: tuples(selection.select_needed(tracks, items, selection.Options(**o)), "track_id")
    assert need(loved=True) == [("1",)]
    assert need(loved=True, dry_run=True) == [("1",), ("3",)]
    assert need(dry_run=True) == [("1",), ("2",), ("3",)]
    assert need() == []


def test_deletions(spark):
    lists = spark.createDataFrame([("l", str(i), i, f"N{i}", i != 7) for i in range(8)], "library_id string, playlist_id string, pos bigint, name string, own boolean")
    favs = spark.createDataFrame([("l", "track", "t1", "T", 1), ("l", "track", "", "no id", 2)], "library_id string, kind string, id string, name string, pos bigint")
    plan = account.deletion_plan(lists, favs, ["playlist", "track"])
    assert tuples(plan, "kind", "id") == [("playlist", str(i)) for i in range(7)] + [("track", "t1")]
    verified = account.verify_deletions(plan, lists, favs, ["playlist", "track"])
    assert tuples(verified, "kind", "n_left", "preview", "ok") == [("playlist", 7, "N0, N1, N2, N3, N4 …", False), ("track", 2, "", False)]
    assert not account.reset_gate(verified).first()["may_import"]
    clean = account.verify_deletions(plan, lists.filter("not own"), favs.limit(0), ["playlist", "track"])
    assert account.reset_gate(clean).first()["may_import"]
    assert account.reset_gate(account.verify_deletions(plan, lists, favs, ["playlist"], dry_run=True)).first()["may_import"]


def test_backup_keeps_every_item_in_parts(spark):
    lists = spark.createDataFrame([("l", "p", "N", True), ("l", "e", "E", False)], "library_id string, playlist_id string, name string, own boolean")
    items = spark.createDataFrame([("l", "p", i, f"t{i}", f"T{i}") for i in range(25)], "library_id string, playlist_id string, pos bigint, track_id string, track_name string")
    favs = spark.createDataFrame([("l", "track", "f", "F", 1)], "library_id string, kind string, id string, name string, pos bigint")
    backup = sinks.account_backup(lists, items, favs, F.lit("2024-01-02 03:04:05").cast("timestamp"), 10)
    assert tuples(backup, "kind", "id", "part", "n_items", "saved_at") == [
        ("playlist", "e", 0, 0, "2024-01-02 03:04:05"), ("playlist", "p", 0, 10, "2024-01-02 03:04:05"),
        ("playlist", "p", 1, 10, "2024-01-02 03:04:05"), ("playlist", "p", 2, 5, "2024-01-02 03:04:05"), ("track", "", 0, 1, "2024-01-02 03:04:05"),
    ]


def test_backup_and_report_are_read_back(spark, tmp_path):
    lists = spark.createDataFrame([("l", "p", "N", True)], "library_id string, playlist_id string, name string, own boolean")
    items = spark.createDataFrame([("l", "p", i, f"t{i}", f"T{i}", "A") for i in range(3)], "library_id string, playlist_id string, pos bigint, track_id string, track_name string, artist string")
    favs = spark.createDataFrame([("l", "track", "f", "F", 1)], "library_id string, kind string, id string, name string, pos bigint")
    backup = sinks.account_backup(lists, items, favs, F.lit("2024-01-02 03:04:05").cast("timestamp"), 2)
    sinks.write_backup(backup, f"{tmp_path}/backup")
    read = spark.read.json(f"{tmp_path}/backup")
    assert read.count() == backup.count() == 3
    assert [t.artist for t in read.filter("part = 1").first().tracks] == ["A"]

    tracks = spark.createDataFrame([("l", "t", "k", "A", "N", "Al")], "library_id string, track_id string, key string, artist string, name string, album string")
    names = spark.createDataFrame([("l", f"p{i}", i, f"P{i}") for i in range(5)], "library_id string, playlist_id string, pos bigint, name string")
    uses = spark.createDataFrame([("l", f"p{i}", 0, "t") for i in range(5)], "library_id string, playlist_id string, pos bigint, track_id string")
    known = spark.createDataFrame([("k", None, 77.777, "", "", None, 78.0)], DECISIONS)
    sinks.write_report(report.unmatched_report(tracks, tracks, known, uses, names, 2), f"{tmp_path}/report")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/report").orderBy("part").collect()
    assert [(r.track_id, r.part, r.best_score, r.playlists) for r in rows] == [("t", "0", "77.8", "P0; P1"), ("t", "1", "77.8", "P2; P3"), ("t", "2", "77.8", "P4")]
