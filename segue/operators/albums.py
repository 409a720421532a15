"""Albums: grouping, majority vote, declared and guessed albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text

ALBUM_KEY = ["library_id", "album_artist_key", "album_key"]


def with_album_key(tracks: DataFrame, artist: str = "album_artist", album: str = "album") -> DataFrame:
    return tracks.withColumn("album_artist_key", text.norm(artist)).withColumn("album_key", text.norm(album))


def _first_track():
    return F.min(F.struct("pos", "album", "album_artist"))


def tracks_by_album(keyed_tracks: DataFrame) -> DataFrame:
    """Album groups of a library: size, and name and artist of the first track.

    Counted by the names as written first: only distinct names are normalised.
    """
    written = (
        keyed_tracks.filter(F.col("album") != "")
        .groupBy("library_id", "album_artist", "album")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    )
    return (
        with_album_key(written)
        .groupBy(*ALBUM_KEY)
        .agg(F.sum("n").alias("n_tracks"), _first_track().alias("_first"))
        .select(*ALBUM_KEY, "n_tracks", F.col("_first.album").alias("album"), F.col("_first.album_artist").alias("album_artist"))
    )


def _votes(keyed_tracks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per group and album id found: tracks, with the group's first track carried along."""
    found = decisions.select("key", F.nullif("album_id", F.lit("")).alias("album_id"))
    written = (
        keyed_tracks.filter(F.col("album") != "")
        .join(found, "key", "left")
        .groupBy("library_id", "album_artist", "album", "album_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    )
    return (
        with_album_key(written)
        .groupBy(*ALBUM_KEY, "album_id")
        .agg(F.sum("n").alias("n"), _first_track().alias("first"))
    )


def _majority(votes: DataFrame) -> DataFrame:
    """Per group: size, matched tracks, and the id more than half of them agree on."""
    matched = F.col("album_id").isNotNull()
    return (
        votes.groupBy(*ALBUM_KEY)
        .agg(
            F.sum("n").alias("n_tracks"),
            F.coalesce(F.sum(F.when(matched, F.col("n"))), F.lit(0)).alias("n_matched"),
            F.max(F.when(matched, F.struct("n", "album_id"))).alias("_top"),
            F.min("first").alias("_first"),
        )
        .select(
            *ALBUM_KEY,
            "n_tracks",
            "n_matched",
            F.when(F.col("_top.n") * 2 > F.col("n_matched"), F.col("_top.album_id")).alias("album_id"),
            F.col("_first.pos").alias("pos"),
            F.col("_first.album").alias("album"),
            F.col("_first.album_artist").alias("album_artist"),
        )
    )


def album_majority(keyed_tracks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Strict majority album id of every group, null without one."""
    return _majority(_votes(keyed_tracks, decisions))


def _first_per_album(albums: DataFrame) -> DataFrame:
    """Keep the first album of each id in a library."""
    values = [c for c in albums.columns if c not in ("library_id", "album_id", "pos")]
    return (
        albums.filter(F.col("album_id").isNotNull())
        .groupBy("library_id", "album_id")
        .agg(F.min(F.struct("pos", *values)).alias("_first"))
        .select("library_id", "album_id", "_first.*")
    )


def resolve_albums(
    declared: DataFrame, keyed_tracks: DataFrame, decisions: DataFrame, upc_decisions: DataFrame
) -> DataFrame:
    """Declared albums with their album id: by code, else by the vote of their tracks."""
    votes = album_majority(keyed_tracks, decisions).select(*ALBUM_KEY, F.col("album_id").alias("_voted"))
    by_code = upc_decisions.select("upc", F.col("album_id").alias("_coded"))
    resolved = (
        with_album_key(declared, "artist", "name")
        .join(by_code, "upc", "left")
        .join(votes, ALBUM_KEY, "left")
        .select(
            "library_id",
            "pos",
            "name",
            "artist",
            "track_count",
            F.coalesce("_coded", "_voted").alias("album_id"),
            F.when(F.col("_coded").isNotNull(), F.lit("upc")).otherwise("tracks").alias("source"),
        )
    )
    return _first_per_album(resolved)


def guess_albums(keyed_tracks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Albums of libraries that declare none: large, well matched, agreed groups."""
    groups = album_majority(keyed_tracks, decisions)
    kept = groups.filter(
        (F.col("n_tracks") >= fv.GUESS_MIN_TRACKS)
        & (F.col("n_matched") / F.col("n_tracks") >= fv.GUESS_MIN_SHARE)
    ).select(
        "library_id",
        "pos",
        F.col("album").alias("name"),
        F.col("album_artist").alias("artist"),
        F.col("n_tracks").alias("track_count"),
        "album_id",
        F.lit("tracks").alias("source"),
    )
    return _first_per_album(kept)
