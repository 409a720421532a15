"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import fixed_values as fv
from .functions import text
from .functions.similarity import token_set_ratio
from .operators import account, albums, forms, link, packed, ranking, search, selection
from .operators import decisions as dec
from .operators.prepare import dedup_groups, prepare_catalog, prepare_tracks, with_key
from .plans import report, reset, transfer, writes
from .schemas import SEARCH_PAGE, TRACK_PAGE
from .session import broadcast_if_small, materialise, shared_folder
from .sinks import tables as sinks
from .sinks import versions
from .sources import filters, json_export, page_dumps, plist_export
from .streaming import incremental


def _r6(name: str):
    return F.round(name, 6).alias(name)


# --------------------------------------------------------------------------- normalisation
def norm_titles(spark, sf):
    return fx.doc_lines(spark, sf).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), text.norm("line").alias("normal")
    )


def norm_dictionary(spark, sf):
    table = forms.forms_table(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    forms.learn(fx.page_titles(spark, sf).select(F.col("title").alias("name")), table)
    lines = fx.doc_lines(spark, sf)
    return forms.with_normal(lines, "line", "normal", table).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "normal")


def clean_titles(spark, sf):
    # titles of documents and pages, with a trailing edition added where one is given
    lines = fx.doc_lines(spark, sf).select(F.concat("line", F.lit(" ("), "lang", F.lit(") - Live [Remix]")).alias("title"))
    titles = fx.page_titles(spark, sf).select(F.concat("title", F.lit(" – Remastered 2011")).alias("title"))
    plain = fx.doc_lines(spark, sf).select(F.col("line").alias("title"))
    return lines.unionByName(titles).unionByName(plain).select(
        F.md5("title").alias("id"), text.clean_title("title").alias("clean")
    )


def clean_artists(spark, sf):
    return fx.doc_lines(spark, sf).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), text.clean_artist("line").alias("lead")
    )


def identity_key(spark, sf):
    return with_key(fx.doc_tracks(spark, sf)).select("library_id", "track_id", "key")


def year_prefix(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stated = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c. "), day)).otherwise(day)
    return fx.table(spark, sf, "orders").select("o_orderkey", text.year_prefix(stated).cast("bigint").alias("year"))


# --------------------------------------------------------------------------- linking
def _sides(spark, sf):
    tracks = dedup_groups(with_key(fx.doc_tracks(spark, sf)))
    return link.ready(tracks, fx.page_catalog(spark, sf))


def dedup_groups_query(spark, sf):
    return dedup_groups(fx.keyed_lib_tracks(spark, sf)).select("key", "n_tracks", "library_id", "track_id")


def token_set_ratio_pairs(spark, sf):
    tracks, catalog = _sides(spark, sf)
    pairs = link.found_pairs(tracks, catalog, fv.SEARCH_LIMIT, None, "key", "t_title")
    return (
        pairs.join(broadcast_if_small(catalog.select("cand_id", "c_title"), packed.ENTRIES), "cand_id")
        .select("key", "cand_id", F.round(token_set_ratio("t_title", "c_title"), 6).alias("ratio"))
    )


def score_pairs(spark, sf):
    return link.candidate_pairs(*_sides(spark, sf)).select(
        "key", "cand_id", F.col("query_no").cast("bigint").alias("query_no"), F.col("rank").cast("bigint").alias("rank"), _r6("score")
    )


def early_stop_window(spark, sf):
    return link.needed_pairs(*_sides(spark, sf)).select(
        "key", "cand_id", F.col("query_no").cast("bigint").alias("query_no"), _r6("score")
    )


def link_stages(spark, sf):
    counted = link.stage_counts(link.staged_pairs(*_sides(spark, sf)))
    return counted.withColumn("query_no", F.col("query_no").cast("bigint"))


def _decision_columns(df):
    return df.select("key", "id", _r6("score"), "title", "artist", "album_id", "threshold")


def link_isrc(spark, sf):
    catalog = materialise(prepare_catalog(fx.page_catalog(spark, sf)))
    # a code is its track's key, so tracks without a code of the catalog meet no entry and share no key with one that does
    coded = link.coded(fx.doc_tracks(spark, sf), catalog)
    return _decision_columns(link.link_isrc(prepare_tracks(dedup_groups(with_key(coded))), catalog))


def link_fuzzy(spark, sf):
    return _decision_columns(link.link_fuzzy(*_sides(spark, sf)))


def link_tracks(spark, sf):
    return _decision_columns(link.link_tracks(*_sides(spark, sf)))


def search_queries(spark, sf):
    tracks = search.with_queries(prepare_tracks(dedup_groups(with_key(fx.doc_tracks(spark, sf)))))
    return search.search_queries(tracks).select("key", F.col("query_no").cast("bigint").alias("query_no"), "query")


def search_candidates(spark, sf):
    return search.search(*_sides(spark, sf)).select(
        "key", F.col("query_no").cast("bigint").alias("query_no"), "cand_id", "weight", F.col("rank").cast("bigint").alias("rank")
    )


def match_metrics(spark, sf):
    # not written: the report needs only numbers of it, and digests of the keys
    keyed = with_key(fx.doc_tracks(spark, sf))
    decisions = link.link_tracks(*link.ready(dedup_groups(keyed), fx.page_catalog(spark, sf)))
    return report.match_metrics(keyed, keyed, decisions)


def transfer_summary(spark, sf):
    tracks = fx.doc_tracks(spark, sf)
    playlists = fx.table(spark, sf, "documents").select(
        F.col("source").alias("library_id"),
        F.col("doc_id").cast("string").alias("playlist_id"),
        F.col("doc_id").alias("pos"),
        F.concat_ws(" ", "source", "lang").alias("name"),
    )
    items = tracks.select("library_id", "playlist_id", "pos", "track_id")
    opts = selection.Options(playlists=True, loved=True)
    done = transfer.transfer(tracks, playlists, items, fx.page_catalog(spark, sf), opts)
    plans = done.playlists.groupBy("library_id").agg(
        F.count_if(~F.col("skip")).alias("n_playlists"), F.sum("n_kept").alias("n_entries"), F.sum("n_missing").alias("n_missing")
    )
    loved = done.favorites.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_favorites"))
    return (
        done.metrics.join(plans, "library_id")
        .join(loved, "library_id", "left")
        .withColumn("n_favorites", F.coalesce("n_favorites", F.lit(0)))
    )


# --------------------------------------------------------------------------- decisions
def _keyed(spark, sf):
    return fx.keyed_lib_tracks(spark, sf)


def decisions_stale(spark, sf):
    work = dedup_groups(_keyed(spark, sf))
    return dec.work_list(work, fx.decisions(spark, sf)).select("key", "track_id", "stale")


def decisions_merge(spark, sf):
    old = fx.decisions(spark, sf)
    # a later run found every overturned or absent key, under a stricter threshold
    new = dec.work_list(dedup_groups(_keyed(spark, sf)), old).select(
        "key",
        F.concat(F.lit("x"), "track_id").alias("id"),
        F.lit(95.0).alias("score"),
        F.col("name").alias("title"),
        "artist",
        F.lit(None).cast("string").alias("album_id"),
        F.lit(90.0).alias("threshold"),
    )
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table = versions.decisions_table(spark, folder, "catalog")
    table.merge(old)
    table.merge(new)
    return table.load()


def decisions_rekey(spark, sf):
    old = fx.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("key"),
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_type") != "LARGE", F.concat(F.lit("c"), F.col("p_partkey"))).alias("old_id"),
        (F.col("p_size") * 2.0).alias("score"),
        F.col("p_name").alias("old_title"),
        F.col("p_brand").alias("old_artist"),
    )
    return dec.rename_legacy(dec.rekey(old, _keyed(spark, sf)), "old").select("key", "id", "score", "title", "artist")


def upc_todo(spark, sf):
    return dec.upc_todo(fx.albums(spark, sf), fx.upc_memo(spark, sf))


def upc_lookup(spark, sf):
    codes = fx.albums(spark, sf).filter("upc is not null").select("upc").distinct()
    return dec.upc_lookup(codes, fx.upc_catalog(spark, sf))


def upc_memo(spark, sf):
    return dec.upc_memo(fx.albums(spark, sf), fx.upc_memo(spark, sf), fx.upc_catalog(spark, sf), rematch=True)


# --------------------------------------------------------------------------- albums
def tracks_by_album(spark, sf):
    return albums.tracks_by_album(_keyed(spark, sf))


def album_majority(spark, sf):
    return albums.album_majority(_keyed(spark, sf), fx.decisions(spark, sf)).select(
        *albums.ALBUM_KEY, "n_tracks", "n_matched", "album_id"
    )


def _album_columns(df):
    return df.select("library_id", "pos", "name", "artist", "track_count", "album_id", "source")


def _resolved(spark, sf):
    memo = dec.upc_memo(fx.albums(spark, sf), fx.upc_memo(spark, sf), fx.upc_catalog(spark, sf))
    return albums.resolve_albums(fx.albums(spark, sf), _keyed(spark, sf), fx.decisions(spark, sf), memo)


def resolve_albums(spark, sf):
    return _album_columns(_resolved(spark, sf))


def guess_albums(spark, sf):
    return _album_columns(albums.guess_albums(_keyed(spark, sf), fx.decisions(spark, sf)))


def favorite_albums_plan(spark, sf):
    have = fx.upc_catalog(spark, sf).select(F.explode(F.array(F.lit("n1"), F.lit("n2"))).alias("library_id"), F.col("album_id").alias("id"))
    return writes.favorite_albums_plan(_resolved(spark, sf), have).select("library_id", "album_id", "rank")


# --------------------------------------------------------------------------- selection
def filter_skip_smart(spark, sf):
    return selection.skip_smart(fx.playlists(spark, sf)).select("library_id", "playlist_id", "name")


def _wanted_names(spark, sf):
    return fx.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.lower(F.concat_ws("-", "c_custkey", F.lit("1-URGENT"))).alias("name")
    )


def filter_only_names(spark, sf):
    return selection.only_names(fx.playlists(spark, sf), _wanted_names(spark, sf)).select("library_id", "playlist_id", "name")


def select_needed_tracks(spark, sf):
    opts = selection.Options(playlists=True, loved=True)
    kept = selection.skip_smart(fx.playlists(spark, sf)).select("library_id", "playlist_id")
    items = fx.items(spark, sf).join(kept, ["library_id", "playlist_id"], "left_semi")
    return selection.select_needed(fx.lib_tracks(spark, sf), items, opts)


def reset_scope_plan(spark, sf):
    imported = fx.playlists(spark, sf).filter("smart")
    return selection.reset_scope(fx.playlists(spark, sf), imported).select("library_id", "playlist_id", "name")


def ambiguous_names(spark, sf):
    return selection.ambiguous_names(fx.playlists(spark, sf))


# --------------------------------------------------------------------------- plans
def _matched(spark, sf):
    ids = writes.track_ids(_keyed(spark, sf), fx.decisions(spark, sf))
    return writes.matched_items(fx.items(spark, sf), ids)


def playlist_plan(spark, sf):
    return writes.playlist_plan(fx.playlists(spark, sf), _matched(spark, sf)).select(
        "library_id", "playlist_id", "n_items", "n_kept", "n_missing", "skip"
    )


def playlist_entries(spark, sf):
    return writes.playlist_entries(_matched(spark, sf)).select("library_id", "playlist_id", "id", "rank")


def playlist_actions(spark, sf):
    plan = writes.playlist_plan(fx.playlists(spark, sf), _matched(spark, sf))
    return writes.playlist_actions(plan, fx.playlists(spark, sf).filter("smart"), overwrite=True).select(
        "library_id", "playlist_id", "name", "action"
    )


def playlist_writes(spark, sf):
    chunks = writes.playlist_chunks(writes.playlist_entries(_matched(spark, sf)), 3)
    return writes.playlist_writes(chunks, playlist_actions(spark, sf)).select(
        "library_id", "playlist_id", "chunk", "mode", F.array_join("ids", ",").alias("ids")
    )


def _favorites(spark, sf, existing=None):
    tracks = fx.lib_tracks(spark, sf)
    ids = writes.track_ids(_keyed(spark, sf), fx.decisions(spark, sf))
    return writes.favorites_plan(tracks, ids, True, existing)


def favorites_plan(spark, sf):
    return _favorites(spark, sf).select("library_id", "id", "rank")


def favorites_new_only(spark, sf):
    have = fx.favorites(spark, sf).filter("kind = 'track'")
    return _favorites(spark, sf, have).select("library_id", "id", "rank")


def chunk_plan(spark, sf):
    ranked = _favorites(spark, sf).withColumn("uri", ranking.service_uri("catalog", "track", F.col("id")))
    return ranking.chunked(ranked, ["library_id"], "uri", fv.FAVORITES_CHUNK).select(
        "library_id", "chunk", F.array_join("ids", ",").alias("uris")
    )


def unmatched_report(spark, sf):
    tracks = _keyed(spark, sf)
    out = report.unmatched_report(tracks, tracks, fx.decisions(spark, sf), fx.items(spark, sf), fx.playlists(spark, sf))
    return report.report_order(out).select("library_id", "track_id", "artist", "title", "album", "best_score", "part", "playlists")


# --------------------------------------------------------------------------- account
def account_summary(spark, sf):
    return account.account_summary(fx.playlists(spark, sf), fx.favorites(spark, sf))


def account_snapshot(spark, sf):
    lists = fx.playlists(spark, sf)
    names = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("track_id"), F.col("p_name").alias("track_name"))
    items = fx.items(spark, sf).join(names, "track_id")
    backup = sinks.account_backup(lists, items, fx.favorites(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return backup.select(
        "library_id", "kind", "id", "name", "own", "part", F.col("n_items").cast("bigint").alias("n_items"),
        F.array_join(F.transform("tracks", lambda t: F.concat_ws("=", t["id"], t["name"])), ",").alias("tracks"), "saved_at",
    )


def _wipe(spark, sf):
    names = fx.playlists(spark, sf).filter("smart").select("library_id", "name")
    kinds = ["playlist", "track", "album", "artist", "followed"]
    return account.deletion_plan(fx.playlists(spark, sf), fx.favorites(spark, sf), kinds, names)


def wipe_plan(spark, sf):
    return account.deletion_chunks(_wipe(spark, sf)).select("library_id", "kind", "id", "chunk")


def _verified(spark, sf):
    after = fx.playlists(spark, sf).filter("o_orderstatus <> 'P'")
    left = fx.favorites(spark, sf).filter("kind = 'album'")
    return account.verify_deletions(_wipe(spark, sf), after, left, ["playlist", "track", "album"])


def verify_deletions(spark, sf):
    return _verified(spark, sf)


def reset_gate(spark, sf):
    return account.reset_gate(_verified(spark, sf))


def reset_import(spark, sf):
    """From snapshot to gated plans: what each library backs up, deletes and then brings in."""
    lists, stars = fx.playlists(spark, sf), fx.favorites(spark, sf)
    names = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("track_id"), F.col("p_name").alias("track_name"))
    items = fx.items(spark, sf).join(names, "track_id")
    backup, deletions = reset.plan(lists, items, stars, lists.filter("smart"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    early = F.col("library_id") < "n2"
    done = reset.verify(backup, deletions, lists.filter(early & (F.col("o_orderstatus") != "P")), stars.filter(early & (F.col("kind") == "album")))
    entries = reset.gated(writes.playlist_entries(_matched(spark, sf)), done.gate)
    favorites = reset.gated(_favorites(spark, sf), done.gate)

    def counted(rows, name):
        return rows.groupBy("library_id").agg(F.count(F.lit(1)).alias(name))

    out = counted(done.backup, "n_backed_up").join(done.gate, "library_id", "left")
    for rows, name in ((done.deletions, "n_deleted"), (entries, "n_entries"), (favorites, "n_favorites")):
        out = out.join(counted(rows, name), "library_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


# --------------------------------------------------------------------------- sources
def _track_columns(df, *extra):
    return df.select(
        "library_id", "track_id", *extra, F.col("pos").cast("bigint").alias("pos"), "name", "artist", "album", "album_artist", "duration_ms", "loved"
    )


def ingest_json_props(spark, sf):
    return _track_columns(json_export.song_rows(json_export.parse_exports(fx.json_exports(spark, sf))))


def ingest_json_playlists(spark, sf):
    exports = json_export.parse_exports(fx.json_exports(spark, sf))
    return json_export.playlists(json_export.playlist_rows(exports)).select("library_id", "name", "n_items", "smart")


def ingest_declared_albums(spark, sf):
    return json_export.album_rows(json_export.parse_exports(fx.json_exports(spark, sf))).select(
        "library_id", "pos", "name", "artist", F.col("track_count").cast("bigint").alias("track_count"), "upc"
    )


def track_union_first_wins(spark, sf):
    exports = json_export.parse_exports(fx.json_exports(spark, sf))  # parsed for either table: writing both moves more
    return _track_columns(
        json_export.union_tracks(json_export.song_rows(exports), json_export.playlist_rows(exports)),
        F.col("part").cast("bigint").alias("part"),
    )


def ingest_xml_udtf(spark, sf):
    rows = plist_export.parse_exports(fx.plist_exports(spark, sf))
    return _track_columns(plist_export.tracks(rows))


def ingest_xml_items(spark, sf):
    rows = plist_export.parsed_once(fx.plist_exports(spark, sf))
    return plist_export.items(rows).select("library_id", "playlist_name", "smart", "pos", "track_id")


def filter_media_kind(spark, sf):
    raw = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "Protected Video file").otherwise(F.col("event_type")).alias("Kind"),
        (F.col("value") > 200).alias("Has Video"),
        F.when(F.col("event_type") == "error", F.col("value") > 50).alias("Podcast"),
        F.lit(False).alias("Movie"),
        (F.col("value") < 1).alias("TV Show"),
        F.when(F.col("event_type") == "signup", F.when(F.col("value") > 20, "")).otherwise(F.col("props")).alias("Name"),
    )
    return filters.music_only(raw).select("event_id", F.col("Name").alias("name"))


def filter_system_playlists(spark, sf):
    status = F.col("o_orderstatus")
    raw = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Music").otherwise(F.col("o_orderpriority")).alias("Name"),
        F.when(status == "F", F.lit(True)).alias("Master"),
        F.when(status == "P", F.lit("")).alias("Smart Info"),
    )
    return filters.user_playlists(raw, ["Master"]).select("o_orderkey", F.col("Name").alias("name"), "smart")


def semi_valid_items(spark, sf):
    music = fx.lib_tracks(spark, sf).filter("album = 'PROMO'")
    kept = filters.valid_items(fx.items(spark, sf), music)
    counts = kept.groupBy("library_id", "playlist_id").agg(F.count(F.lit(1)).alias("n_items"))
    return filters.non_empty(fx.playlists(spark, sf), kept).join(counts, ["library_id", "playlist_id"]).select("library_id", "playlist_id", "n_items")


def explode_pages(spark, sf):
    return page_dumps.page_items(fx.page_dumps(spark, sf), TRACK_PAGE).select(
        "collection", "pos", F.col("item.track.id").alias("id"), F.col("item.track.name").alias("name")
    )


def ingest_nested_tracks(spark, sf):
    found = page_dumps.saved_tracks(page_dumps.page_items(fx.page_dumps(spark, sf), TRACK_PAGE))
    return found.select(
        "collection", "pos", "track_id", "name", "artist", "album", "album_artist", "duration_ms", F.col("year").cast("bigint").alias("year")
    )


def _page_library(spark, sf):
    pages = [make(spark, sf) for make in (fx.page_dumps, fx.playlist_pages, fx.playlist_item_pages, fx.album_pages)]
    return page_dumps.page_library(*pages, me=F.lit("en"))


def ingest_page_library(spark, sf):
    return _track_columns(_page_library(spark, sf).tracks, F.col("part").cast("bigint").alias("part"), F.col("year").cast("bigint").alias("year"))


def ingest_page_playlists(spark, sf):
    library = _page_library(spark, sf)
    distinct = library.items.groupBy("library_id", "playlist_id").agg(F.count_distinct("track_id").alias("n_tracks"))
    return library.playlists.join(distinct, ["library_id", "playlist_id"]).select(
        "library_id", "playlist_id", "playlist_pos", "name", "n_items", "n_tracks"
    )


def ingest_page_albums(spark, sf):
    return _page_library(spark, sf).albums.select(
        "library_id", "pos", "name", "artist", F.col("track_count").cast("bigint").alias("track_count"), "upc"
    )


def catalog_entries(spark, sf):
    found = page_dumps.page_items(fx.search_pages(spark, sf), SEARCH_PAGE, "tracks")
    return page_dumps.catalog_entries(found).select(
        "cand_id", "name", F.array_join("artists", "|").alias("artists"), "album", "album_id", "duration_s",
        F.col("popularity").cast("bigint").alias("popularity"), "isrc",
    )


def ingest_quarantine(spark, sf):
    """Every reader over bodies some of which break off: what each rejects, and what it keeps."""
    lang = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("library_id"), "lang")

    def cut(texts, body, where):
        broken = F.expr(f"substring({body}, 1, length({body}) - 3)")
        return texts.withColumn(body, F.when(where, broken).otherwise(F.col(body)))

    exports = cut(fx.json_exports(spark, sf).join(lang, "library_id"), "body", F.col("lang") == "de")
    pages = cut(fx.page_dumps(spark, sf), "body", F.col("collection") == "src1")
    lists = cut(fx.plist_exports(spark, sf).join(lang, "library_id"), "content", F.col("lang") == "fr")
    known = fx.decisions(spark, sf).select(
        F.when(F.col("album_id").isNotNull(), F.col("key")).alias("key"), F.nullif("score", F.lit(20.0)).alias("score"), "threshold"
    )
    rejected = [
        json_export.split_exports(exports).rejected,
        page_dumps.split_pages(pages, TRACK_PAGE).rejected,
        plist_export.rejected(plist_export.parse_exports(lists)),
        dec.split_sound(known).rejected,
    ]
    told = [r.select("reader", "reason", "source") for r in rejected]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3]).groupBy("reader", "reason", "source").agg(F.count(F.lit(1)).alias("n"))


def song_projection(spark, sf):
    catalog = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("_id"),
        F.struct(
            F.md5(F.col("doc_id").cast("string")).alias("isrc"),
            (F.col("quality") * 1000).alias("duration_ms"),
            F.concat(F.lit(2000) + F.col("toxic"), F.lit("-05")).alias("release_date"),
        ).alias("c"),
    )
    items = fx.table(spark, sf, "documents").select(
        F.col("source").alias("library_id"),
        F.col("doc_id").cast("string").alias("track_id"),
        F.col("doc_id").alias("pos"),
        F.col("doc_id").alias("_id"),
        F.struct(
            F.col("text").alias("name"),
            F.col("lang").alias("artist"),
            F.col("source").alias("album"),
            F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0).cast("int").alias("duration_ms"),
        ).alias("s"),
    ).join(catalog, "_id", "left")
    return json_export.song_projection(items).select(
        "library_id", "track_id", F.md5("name").alias("name"), "artist", F.col("duration_ms").cast("bigint").alias("duration_ms"), "isrc", "year"
    )


def filter_non_tracks(spark, sf):
    raw = fx.table(spark, sf, "events").select(
        F.when(F.col("value") < 200, F.col("event_id").cast("string")).otherwise("").alias("id"),
        F.when(F.col("event_type") == "click", "track").when(F.col("event_type") == "error", "episode").alias("type"),
        F.when(F.col("event_type") != "view", F.col("value") < 5).alias("is_local"),
    )
    return filters.real_tracks(raw).select("id")


def filter_owned(spark, sf):
    raw = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("owner_id"),
        F.lit("1-URGENT").alias("me"),
        F.when(F.col("o_totalprice") > 400000, F.lit(True)).alias("collaborative"),
    )
    return account.owned(raw).select("o_orderkey")


def catalog_projection(spark, sf):
    raw = fx.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("cand_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 25, F.array("p_brand", F.lit(None), "p_type")).otherwise(F.array().cast("array<string>")).alias("artists"),
        F.col("p_brand").alias("artist"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("album"),
        F.lit(None).cast("string").alias("album_id"),
        F.col("p_size").cast("double").alias("duration_s"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("popularity"),
        F.lit(None).cast("string").alias("isrc"),
        (F.col("p_type") != "SMALL").alias("available"),
    )
    return page_dumps.flat_catalog_entries(raw).select(
        "cand_id", "name", text.joined_artists("artists").alias("artists"), text.primary_artist("artists").alias("artist"),
        "album", "duration_s", F.col("popularity").cast("bigint").alias("popularity"),
    )


def album_artist_unambiguous(spark, sf):
    part = fx.table(spark, sf, "part")
    declared = part.select(
        F.concat_ws("/", "p_brand", "p_type").alias("library_id"),
        F.upper(F.concat(F.lit(" "), "p_name")).alias("name"),
        F.col("p_size").cast("string").alias("artist"),
    )
    songs = part.select(
        F.concat_ws("/", "p_brand", "p_type").alias("library_id"),
        "p_partkey",
        F.col("p_name").alias("album"),
        F.col("p_brand").alias("artist"),
    )
    return json_export.with_album_artist(songs, json_export.album_artists(declared)).select("p_partkey", "artist", "album_artist")


def loved_flag_join(spark, sf):
    songs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("track_id"), "source")
    ratings = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("value"))
    return json_export.with_loved(songs, ratings)


# --------------------------------------------------------------------------- streaming
def stream_link(spark, sf):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # as a pattern, so that a folder of files and a single file stream alike
    documents = spark.readStream.schema(fx.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    arriving = (
        documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .filter(F.trim("line") != "")
        .select(
            F.col("source").alias("library_id"),
            F.concat_ws("-", "doc_id", "line_no").alias("track_id"),
            (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("pos"),
            F.col("line").alias("name"),
            F.col("lang").alias("artist"),
            F.col("source").alias("album"),
            F.col("lang").alias("album_artist"),
            (F.length("line") * 100).cast("bigint").alias("duration_ms"),
            F.lit(None).cast("string").alias("isrc"),
        )
    )
    incremental.link_stream(arriving, fx.page_catalog(spark, sf), folder, "catalog").awaitTermination()
    return _decision_columns(versions.decisions_table(spark, folder, "catalog").load())


QUERIES = {
    f.__name__.replace("dedup_groups_query", "dedup_groups"): f
    for f in [
        norm_titles, norm_dictionary, clean_titles, clean_artists, identity_key, year_prefix,
        token_set_ratio_pairs, score_pairs, early_stop_window, link_stages,
        link_isrc, link_fuzzy, link_tracks, search_queries, search_candidates,
        match_metrics, transfer_summary,
        dedup_groups_query, decisions_stale, decisions_merge, decisions_rekey,
        upc_todo, upc_lookup, upc_memo,
        tracks_by_album, album_majority, resolve_albums, guess_albums, favorite_albums_plan,
        filter_skip_smart, filter_only_names, select_needed_tracks, reset_scope_plan, ambiguous_names,
        playlist_plan, playlist_entries, playlist_actions, playlist_writes, favorites_plan, favorites_new_only,
        chunk_plan, unmatched_report,
        account_summary, account_snapshot, wipe_plan, verify_deletions, reset_gate, reset_import,
        ingest_json_props, ingest_json_playlists, ingest_declared_albums, track_union_first_wins,
        ingest_xml_udtf, ingest_xml_items, filter_media_kind, filter_system_playlists, semi_valid_items,
        explode_pages, ingest_nested_tracks, ingest_page_library, ingest_page_playlists, ingest_page_albums, catalog_entries,
        ingest_quarantine, song_projection, filter_non_tracks, filter_owned,
        catalog_projection, album_artist_unambiguous, loved_flag_join, stream_link,
    ]
}
