"""Comparable columns of tracks and catalog entries, and one track per identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialise


def with_key(tracks: DataFrame) -> DataFrame:
    """Add the normalised lead artist and title, and the identity key."""
    return (
        tracks.withColumn("_title", text.clean_title("name"))
        .withColumn("_lead", text.clean_artist("artist"))
        .withColumn("t_title", text.norm("_title"))
        .withColumn("t_lead", text.norm("_lead"))
        .withColumn("key", text.identity_key("isrc", "t_lead", "t_title"))
        .drop("_title", "_lead")
    )


TRACK_COLUMNS = [
    "library_id", "pos", "track_id", "name", "artist", "album", "album_artist",
    "duration_ms", "isrc", "t_title", "t_lead",
]


def dedup_groups(keyed: DataFrame) -> DataFrame:
    """One representative track per identity key, across all libraries.

    The first by (library, position) stands for the group: partial minima, so a key
    held by a large share of the tracks costs no more than any other.
    """
    return (
        keyed.groupBy("key")
        .agg(F.min(F.struct(*TRACK_COLUMNS)).alias("_first"), F.count(F.lit(1)).alias("n_tracks"))
        .select("key", "n_tracks", "_first.*")
    )


def prepare_tracks(representatives: DataFrame) -> DataFrame:
    """Score-side columns of the tracks to look up."""
    return (
        representatives.withColumn("_album", text.clean_title("album"))
        # most names are their own title, already normalised for the key
        .withColumn("_whole", F.col("name") == text.clean_title("name"))
        .withColumn("_cut", F.when(~F.col("_whole"), F.col("name")))
        .select(
            "*",
            F.when(F.col("_whole"), F.col("t_title")).otherwise(text.norm("_cut")).alias("t_name"),
            text.norm("artist").alias("t_artist"),
            text.norm("_album").alias("t_album"),
            F.col("duration_ms").alias("t_duration_ms"),
        )
        .drop("_album", "_whole", "_cut")
    )


def written(tracks: DataFrame) -> DataFrame:
    """Keyed tracks written once; a key or a name is written only where it is not told by the title."""
    like = {"key": text.identity_key("isrc", "t_lead", "t_title")}
    if "t_name" in tracks.columns:
        like["t_name"] = F.col("t_title")
    lean = materialise(tracks.withColumns({c: F.when(~F.col(c).eqNullSafe(v), F.struct(c)) for c, v in like.items()}), dense=True)
    return lean.withColumns({c: F.when(F.col(c).isNull(), v).otherwise(F.col(f"{c}.{c}")) for c, v in like.items()})


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """Score-side columns of the catalog, and the words it is found by."""
    return (
        catalog.withColumn("c_primary", text.primary_artist("artists"))
        .withColumn("_joined", text.joined_artists("artists"))
        .withColumn("_title", text.clean_title("name"))
        .withColumn("_lead", text.clean_artist("c_primary"))
        .withColumn("_album", text.clean_title("album"))
        .select(
            "*",
            F.upper(F.nullif("isrc", F.lit(""))).alias("c_isrc"),
            text.norm("_title").alias("c_title"),
            text.norm("name").alias("c_name"),
            text.norm("_joined").alias("c_artist"),
            text.norm("_lead").alias("c_lead"),
            text.norm("_album").alias("c_album"),
            F.col("duration_s").alias("c_duration_s"),
        )
        .drop("_joined", "_title", "_lead", "_album")
    )
