"""What an export holds that is no music, and playlists nobody made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def any_flag(flags: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{f}`"), F.lit(False)) for f in flags])


def music_only(tracks: DataFrame, flags: list[str] = fv.NON_MUSIC_FLAGS) -> DataFrame:
    """Drop videos, podcasts, films, shows and unnamed tracks."""
    video = F.lower(F.coalesce("Kind", F.lit(""))).contains(fv.VIDEO_KIND_MARK)
    return tracks.filter(~(video | any_flag(flags)) & F.nullif("Name", F.lit("")).isNotNull())


def user_playlists(playlists: DataFrame, flags: list[str] = fv.SYSTEM_PLAYLIST_FLAGS) -> DataFrame:
    """Drop system playlists by flag or reserved name; mark smart ones."""
    reserved = F.coalesce(F.col("Name").isin(fv.SYSTEM_PLAYLIST_NAMES), F.lit(False))
    return playlists.filter(~any_flag(flags) & ~reserved & F.col("Name").isNotNull()).withColumn(
        "smart", F.col("`Smart Info`").isNotNull()
    )


def valid_items(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """Playlist items whose track survived."""
    return items.join(tracks.select("library_id", "track_id"), ["library_id", "track_id"], "left_semi")


def non_empty(playlists: DataFrame, items: DataFrame) -> DataFrame:
    """Playlists that keep an item."""
    return playlists.join(items.select("library_id", "playlist_id").distinct(), ["library_id", "playlist_id"], "left_semi")


def real_tracks(items: DataFrame) -> DataFrame:
    """Page items that are catalog tracks: not local, with id, of type track or none."""
    return items.filter(
        ~F.coalesce("is_local", F.lit(False))
        & F.nullif("id", F.lit("")).isNotNull()
        & (F.coalesce("type", F.lit("track")) == "track")
    )
