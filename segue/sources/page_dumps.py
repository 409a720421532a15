"""Stored API pages: collections cut into JSON bodies, read in offset order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.account import owned
from ..schemas import ALBUM_PAGE, PLAYLIST_PAGE, TRACK_PAGE
from . import quarantine
from .filters import real_tracks
from .json_export import union_tracks


def page_items(dumps: DataFrame, schema: str, root: str | None = None) -> DataFrame:
    """Items of all pages: (collection, pos, item), null items dropped.

    ``dumps``: collection, offset, body (JSON).  ``root`` names the object that holds
    the page where it is nested.
    """
    shape = f"{root} struct<{schema.replace('items ', 'items: ', 1)}>" if root else schema
    page = F.from_json("body", shape)
    items = page[root]["items"] if root else page["items"]
    return (
        dumps.select("collection", "offset", F.posexplode(items).alias("at", "item"))
        .filter(F.col("item").isNotNull())
        .select("collection", (F.col("offset") + F.col("at")).alias("pos"), "item")
    )


def split_pages(dumps: DataFrame, schema: str) -> quarantine.Split:
    """Stored pages, those that cannot be read apart."""
    parsed = quarantine.parsed_json(dumps, schema)
    split = quarantine.split(parsed, "page", "collection", quarantine.malformed(), "body")
    return split._replace(rows=split.rows.drop("_parsed"))


def _first_name(artists):
    # present but unnamed is '', no artist at all is null
    return F.when(F.size(artists) > 0, F.coalesce(F.get(artists, F.lit(0))["name"], F.lit("")))


def saved_tracks(items: DataFrame) -> DataFrame:
    """Track columns of page items: (collection, pos, item) with item.track or item.item."""
    raw = items.select(
        "collection", "pos", F.coalesce(F.col("item")["track"], F.col("item")["item"]).alias("i")
    ).select("collection", "pos", "i.*")
    artist = F.coalesce(_first_name(F.col("artists")), F.lit(""))
    return real_tracks(raw).select(
        "collection",
        "pos",
        F.col("id").alias("track_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        artist.alias("artist"),
        F.coalesce("album.name", F.lit("")).alias("album"),
        F.coalesce(_first_name(F.col("album.artists")), artist).alias("album_artist"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        text.year_prefix("album.release_date").alias("year"),
        F.nullif("external_ids.isrc", F.lit("")).alias("isrc"),
    )


def saved_albums(items: DataFrame) -> DataFrame:
    """Declared albums of page items, unnamed ones dropped."""
    return items.select("collection", "pos", "item.album.*").filter(
        F.nullif("name", F.lit("")).isNotNull()
    ).select(
        "collection",
        "pos",
        "name",
        F.coalesce(_first_name(F.col("artists")), F.lit("")).alias("artist"),
        F.coalesce("total_tracks", F.lit(0)).alias("track_count"),
        F.nullif("external_ids.upc", F.lit("")).alias("upc"),
    )


def catalog_entries(items: DataFrame) -> DataFrame:
    """Catalog entries of a track search: with id, and playable unless said otherwise."""
    raw = items.select("item.*")
    return raw.filter(
        F.nullif("id", F.lit("")).isNotNull() & F.coalesce("is_playable", F.lit(True))
    ).select(
        F.col("id").alias("cand_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.transform(F.coalesce("artists", F.array()), lambda a: F.coalesce(a["name"], F.lit(""))).alias("artists"),
        F.coalesce("album.name", F.lit("")).alias("album"),
        F.col("album.id").alias("album_id"),
        (F.nullif("duration_ms", F.lit(0)) / 1000.0).alias("duration_s"),
        F.coalesce("popularity", F.lit(0)).alias("popularity"),
        F.nullif("external_ids.isrc", F.lit("")).alias("isrc"),
    )


def flat_catalog_entries(items: DataFrame) -> DataFrame:
    """Catalog entries of a service that lists ``artists`` or one ``artist`` by name."""
    artists = F.when(F.size("artists") > 0, F.col("artists")).otherwise(F.array("artist"))
    return items.filter("available").select(
        "cand_id",
        "name",
        F.filter(artists, lambda a: a.isNotNull()).alias("artists"),
        F.coalesce("album", F.lit("")).alias("album"),
        "album_id",
        "duration_s",
        F.coalesce("popularity", F.lit(0)).alias("popularity"),
        "isrc",
    )


class PageLibrary(NamedTuple):
    """A library put together from the pages of its collections."""

    tracks: DataFrame
    playlists: DataFrame
    items: DataFrame
    albums: DataFrame


def page_library(saved: DataFrame, playlist_pages: DataFrame, item_pages: DataFrame, album_pages: DataFrame, me: Column) -> PageLibrary:
    """Saved tracks, own playlists with their items, and saved albums of every library.

    Pages hold (collection, offset, body); the collection is the library, that of
    ``item_pages`` the playlist.  Of a track met several times the first place counts, saved
    ones before those of playlists in their order, and it is loved if it was saved anywhere.
    Only playlists that ``me`` owns or shares are read, and only those keep a place that hold
    a track.
    """
    songs = saved_tracks(page_items(saved, TRACK_PAGE)).withColumnRenamed("collection", "library_id")
    lists = page_items(playlist_pages, PLAYLIST_PAGE).select(
        F.col("collection").alias("library_id"),
        F.col("pos").alias("playlist_pos"),
        F.col("item.id").alias("playlist_id"),
        F.coalesce("item.name", F.lit("")).alias("playlist_name"),
        F.col("item.owner.id").alias("owner_id"),
        me.alias("me"),
        F.col("item.collaborative").alias("collaborative"),
    )
    mine = owned(lists).select("library_id", "playlist_pos", "playlist_id", "playlist_name")
    listed = saved_tracks(page_items(item_pages, TRACK_PAGE)).withColumnRenamed("collection", "playlist_id").join(mine, "playlist_id")
    tracks = union_tracks(songs.withColumn("loved", F.lit(True)), listed.withColumn("loved", F.lit(False)), loved_adds_up=True)
    held = listed.groupBy("library_id", "playlist_pos", "playlist_id").agg(
        F.any_value("playlist_name").alias("name"), F.count(F.lit(1)).alias("n_items")
    )
    albums = saved_albums(page_items(album_pages, ALBUM_PAGE)).withColumnRenamed("collection", "library_id")
    return PageLibrary(tracks, held, listed.select("library_id", "playlist_id", "pos", "track_id"), albums)
