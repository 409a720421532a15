"""Write plans: playlists, favorite tracks, favorite albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.ranking import chunked, first_positions, rank_by_position

PLAYLIST = ["library_id", "playlist_id"]


def matched_items(items: DataFrame, track_ids: DataFrame) -> DataFrame:
    """Playlist items with the id found for their track, null where none was."""
    return items.join(track_ids, ["library_id", "track_id"], "left")


def track_ids(keyed_tracks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(library_id, track_id, id): what the decisions found for each track.

    A key may be as long as the name, so its digest moves for it.
    """
    digest = F.unhex(F.md5("key")).alias("key")
    return keyed_tracks.select("library_id", "track_id", digest).join(
        decisions.select(digest, F.nullif("id", F.lit("")).alias("id")), "key", "left"
    ).drop("key")


def playlist_entries(matched: DataFrame) -> DataFrame:
    """Ids to write, in order, each once per playlist: (…, id, rank)."""
    kept = first_positions(matched.filter(F.col("id").isNotNull()), PLAYLIST, "id", "pos")
    return rank_by_position(kept, PLAYLIST, "pos")


def playlist_plan(playlists: DataFrame, matched: DataFrame) -> DataFrame:
    """Per playlist: items, ids kept, items missing (repeats count), and whether to skip."""
    sizes = matched.groupBy(*PLAYLIST).agg(F.count(F.lit(1)).alias("n_items"))
    kept = (
        matched.filter(F.col("id").isNotNull())
        .select(*PLAYLIST, "id")
        .distinct()
        .groupBy(*PLAYLIST)
        .agg(F.count(F.lit(1)).alias("n_kept"))
    )
    return (
        playlists.join(sizes, PLAYLIST)
        .join(kept, PLAYLIST, "left")
        .withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
        .withColumn("n_missing", F.col("n_items") - F.col("n_kept"))
        .withColumn("skip", F.col("n_kept") == 0)
    )


def playlist_actions(plan: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """What to do with each planned playlist, given the account's own playlists."""
    names = existing.groupBy("library_id", "name").agg(F.count(F.lit(1)).alias("n_existing"))
    n = F.coalesce("n_existing", F.lit(0))
    action = (
        F.when(F.col("skip"), "skip_no_match")
        .when(n > 1, "skip_ambiguous")
        .when((n == 1) & F.lit(not overwrite), "skip_exists")
        .when(n == 1, "replace")
        .otherwise("create")
    )
    return plan.join(names, ["library_id", "name"], "left").withColumn("action", action).drop("n_existing")


def playlist_chunks(entries: DataFrame, size: int = fv.PLAYLIST_CHUNK) -> DataFrame:
    return chunked(entries, PLAYLIST, "id", size)


def playlist_writes(chunks: DataFrame, actions: DataFrame) -> DataFrame:
    """Batches of the playlists to write: the first one of a replaced playlist replaces."""
    written = actions.filter(F.col("action").isin("create", "replace")).select(*PLAYLIST, "action")
    replaces = (F.col("action") == "replace") & (F.col("chunk") == 0)
    return (
        chunks.join(written, PLAYLIST)
        .withColumn("mode", F.when(replaces, "replace").otherwise("append"))
        .drop("action")
    )


def favorites_plan(
    tracks: DataFrame, ids: DataFrame, all_tracks: bool, existing: DataFrame | None = None
) -> DataFrame:
    """Favorite ids of each library in library order: (library_id, id, pos, rank).

    ``existing`` (library_id, id) are favorites already and left out.
    """
    source = tracks if all_tracks else tracks.filter("loved")
    found = source.select("library_id", "track_id", "pos").join(ids, ["library_id", "track_id"])
    first = first_positions(found.filter(F.col("id").isNotNull()), ["library_id"], "id", "pos")
    return rank_by_position(new_only(first, existing), ["library_id"], "pos")


def new_only(planned: DataFrame, existing: DataFrame | None, ident: str = "id") -> DataFrame:
    """Leave out what the account already has."""
    if existing is None:
        return planned
    have = existing.select("library_id", F.col("id").alias(ident)).distinct()
    return planned.join(have, ["library_id", ident], "left_anti")


def favorite_albums_plan(albums: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return rank_by_position(new_only(albums, existing, "album_id"), ["library_id"], "pos")
