"""JSON library exports as tables.

An export is one row with ``songs``, ``playlists`` and ``albums`` arrays; all tables
come from exploding them where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JSON_EXPORT
from . import quarantine

TRACK_FIELDS = [
    "name", "artist", "album", "album_artist", "duration_ms", "loved", "year", "isrc",
]


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Export files, one library each, named by its file."""
    return (
        spark.read.schema(JSON_EXPORT)
        .option("multiLine", True)
        .json(path)
        .withColumn("library_id", F.col("_metadata.file_path"))
    )


def parse_exports(texts: DataFrame, column: str = "body") -> DataFrame:
    """Exports held as JSON text in a column; malformed ones are left out, see ``split_exports``."""
    return split_exports(texts, column).rows


def split_exports(texts: DataFrame, column: str = "body") -> quarantine.Split:
    """Exports held as JSON text, those that cannot be read apart."""
    parsed = quarantine.parsed_json(texts, JSON_EXPORT, column)
    split = quarantine.split(parsed, "json export", "library_id", quarantine.malformed(column), column)
    rows = split.rows.select("library_id", "_parsed.songs", "_parsed.playlists", "_parsed.albums")
    return split._replace(rows=rows)


def _named(name):
    return F.nullif(name, F.lit("")).isNotNull()


def _song(s: str, loved) -> list:
    artist = F.coalesce(f"{s}.artist", F.lit(""))
    return [
        F.col(f"{s}.id").alias("track_id"),
        F.col(f"{s}.name").alias("name"),
        artist.alias("artist"),
        F.coalesce(f"{s}.album", F.lit("")).alias("album"),
        F.coalesce(F.nullif(f"{s}.album_artist", F.lit("")), artist).alias("album_artist"),
        F.coalesce(f"{s}.duration_ms", F.lit(0)).alias("duration_ms"),
        loved.alias("loved"),
        F.expr(f"try_cast(nullif({s}.year, '') as int)").alias("year"),
        F.nullif(f"{s}.isrc", F.lit("")).alias("isrc"),
    ]


def song_rows(exports: DataFrame) -> DataFrame:
    """Songs of the library list, unnamed ones dropped."""
    return (
        exports.select("library_id", F.posexplode("songs").alias("pos", "s"))
        .filter(_named("s.name"))
        .select("library_id", F.col("pos").cast("bigint"), *_song("s", F.coalesce("s.loved", F.lit(False))))
    )


def playlist_rows(exports: DataFrame) -> DataFrame:
    """Tracks inside playlists, with the place of the playlist and of the track."""
    return (
        exports.select("library_id", F.posexplode("playlists").alias("playlist_pos", "p"))
        .select("library_id", "playlist_pos", "p.name", F.posexplode("p.tracks").alias("pos", "s"))
        .filter(_named("s.name"))
        .select(
            "library_id",
            "playlist_pos",
            F.coalesce("name", F.lit("")).alias("playlist_name"),
            F.col("pos").cast("bigint"),
            *[c for c in _song("s", F.lit(False))],
        )
    )


def album_rows(exports: DataFrame) -> DataFrame:
    """Declared albums with a name."""
    return (
        exports.select("library_id", F.posexplode("albums").alias("pos", "a"))
        .filter(_named("a.name"))
        .select(
            "library_id",
            F.col("pos").cast("bigint"),
            "a.name",
            F.coalesce("a.artist", F.lit("")).alias("artist"),
            F.coalesce("a.track_count", F.lit(0)).alias("track_count"),
            F.nullif("a.upc", F.lit("")).alias("upc"),
        )
    )


def playlists(rows: DataFrame) -> DataFrame:
    """Playlists that keep at least one track; this export marks none as smart."""
    return rows.groupBy("library_id", "playlist_pos").agg(
        F.any_value("playlist_name").alias("name"), F.count(F.lit(1)).alias("n_items"), F.lit(False).alias("smart")
    )


def union_tracks(songs: DataFrame, playlist_tracks: DataFrame, loved_adds_up: bool = False) -> DataFrame:
    """One row per track id of a library.

    A repeated id of the song list keeps the last row's values at the first row's
    place.  A playlist track counts only where the song list lacks its id; of several
    the first stays.  With ``loved_adds_up`` the first row wins everywhere and a track
    is loved when any of its rows is.
    """
    ids = ["library_id", "track_id"]
    values = F.struct(*TRACK_FIELDS)
    listed = songs.select(
        *ids, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("playlist_pos"), "pos", values.alias("v")
    )
    extra = playlist_tracks.select(
        *ids, F.lit(1).alias("part"), F.col("playlist_pos").cast("bigint"), "pos", values.alias("v")
    )
    place = F.struct("part", "playlist_pos", "pos")
    row, is_listed = F.struct(place.alias("at"), "v"), F.col("part") == 0
    # a row's values go into one of the two, so they are moved once
    merged = listed.unionByName(extra).groupBy(*ids).agg(
        F.min(place).alias("first"),
        F.min(row if loved_adds_up else F.when(~is_listed, row)).alias("first_row"),
        F.max(F.when(is_listed, row)).alias("last_listed"),
        F.bool_or(F.col("v.loved")).alias("any_loved"),
    )
    chosen = F.col("first_row.v") if loved_adds_up else F.coalesce("last_listed.v", "first_row.v")
    out = merged.select(*ids, "first.part", "first.playlist_pos", "first.pos", chosen.alias("v"), "any_loved").select(
        *ids, "part", "playlist_pos", "pos", "v.*", "any_loved"
    )
    if loved_adds_up:
        out = out.withColumn("loved", F.col("any_loved"))
    return out.drop("any_loved")


def album_artists(albums: DataFrame) -> DataFrame:
    """Album name (trimmed, lower) to its artist; null where two artists share the name."""
    named = albums.filter(_named(F.col("name")) & _named(F.col("artist")))
    return (
        named.groupBy("library_id", F.lower(F.trim("name")).alias("album_name"))
        .agg(F.min("artist").alias("_lo"), F.max("artist").alias("_hi"))
        .select("library_id", "album_name", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("album_artist"))
    )


def with_album_artist(songs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Give each song its album's artist, its own where that is unknown or ambiguous."""
    own = songs.withColumn("_name", F.lower(F.trim(F.coalesce("album", F.lit("")))))
    return (
        own.join(lookup.withColumnRenamed("album_name", "_name").withColumnRenamed("album_artist", "_of"), ["library_id", "_name"], "left")
        .withColumn("album_artist", F.coalesce(F.nullif("_of", F.lit("")), "artist"))
        .drop("_name", "_of")
    )


def with_loved(songs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Loved are the songs with a rating of 1."""
    ones = ratings.filter("value = 1").select(F.col("id").alias("track_id"), F.lit(True).alias("_one")).distinct()
    return (
        songs.join(ones, "track_id", "left")
        .withColumn("loved", F.col("_one").isNotNull())
        .drop("_one")
    )


def song_projection(items: DataFrame) -> DataFrame:
    """Library item with its catalog relation: ``s`` own attributes, ``c`` the catalog's."""
    return items.select(
        "library_id",
        "track_id",
        "pos",
        F.coalesce("s.name", F.lit("")).alias("name"),
        F.coalesce("s.artist", F.lit("")).alias("artist"),
        F.coalesce("s.album", F.lit("")).alias("album"),
        F.coalesce(F.nullif("s.duration_ms", F.lit(0)), F.nullif("c.duration_ms", F.lit(0)), F.lit(0)).alias("duration_ms"),
        F.nullif("c.isrc", F.lit("")).alias("isrc"),
        F.nullif(F.left(F.coalesce("c.release_date", F.lit("")), F.lit(4)), F.lit("")).alias("year"),
    )
