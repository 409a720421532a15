"""Reports: unmatched tracks and match rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.ranking import rank_by_position

NAMES_PER_ROW = 1000


def _names_of_tracks(items: DataFrame, playlists: DataFrame, names_per_row: int) -> DataFrame:
    """(library_id, track_id, part, playlists): joined playlist names in library order.

    A track several times in a playlist repeats its name; the repeats are counted before
    anything is ranked.  A cell holds at most ``names_per_row`` playlists, a playlist with more
    repeats than that counting name by name; what is more continues in further parts.
    """
    track = ["library_id", "track_id"]
    repeats = items.groupBy(*track, "playlist_id").agg(F.count(F.lit(1)).alias("n"))
    named = repeats.join(
        playlists.select("library_id", "playlist_id", F.col("name").alias("playlist"), F.col("pos").alias("playlist_pos")),
        ["library_id", "playlist_id"],
    )
    often = F.col("n") > names_per_row
    counts = F.when(often, F.col("n")).otherwise(F.lit(1).cast("bigint"))
    placed = named.select(*track, "playlist", "n", counts.alias("counts"), F.struct("playlist_pos", "playlist_id").alias("at"))
    ranked = rank_by_position(placed, track, "at", times="counts")
    first, last = F.expr(f"(rank - 1) div {names_per_row}"), F.expr(f"(rank + counts - 2) div {names_per_row}")
    # what of a playlist that reaches into further cells lies in this one
    inside = F.expr(f"least(rank - 1 + n, (part + 1) * {names_per_row}) - greatest(rank - 1, part * {names_per_row})")
    return (
        ranked.withColumn("part", F.explode(F.sequence(first, last)))
        .withColumn("times", F.when(often, inside).otherwise(F.col("n")).cast("int"))
        .groupBy(*track, "part")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "playlist", "times"))).alias("_n"))
        .select(*track, "part", F.array_join(F.flatten(F.transform("_n", lambda n: F.array_repeat(n["playlist"], n["times"]))), fv.REPORT_NAME_SEPARATOR).alias("playlists"))
    )


def unmatched_report(
    keyed_tracks: DataFrame,
    needed: DataFrame,
    decisions: DataFrame,
    items: DataFrame,
    playlists: DataFrame,
    names_per_row: int = NAMES_PER_ROW,
) -> DataFrame:
    """Needed tracks without a match, one row per track, ordered by artist and title."""
    ids = ["library_id", "track_id"]
    score = decisions.select("key", F.nullif("id", F.lit("")).alias("id"), "score")
    unmatched = (
        keyed_tracks.join(needed.select(*ids), ids, "left_semi")
        .join(score, "key", "left")
        .filter(F.col("id").isNull())
        .select(
            *ids,
            "artist",
            F.col("name").alias("title"),
            "album",
            F.coalesce("score", F.lit(0.0)).alias("best_score"),
        )
    )
    listed = items.join(unmatched.select(*ids), ids, "left_semi")
    return (
        unmatched.join(_names_of_tracks(listed, playlists, names_per_row), ids, "left")
        .withColumn("playlists", F.coalesce("playlists", F.lit("")))
        .withColumn("part", F.coalesce("part", F.lit(0)))
    )


def report_order(report: DataFrame) -> DataFrame:
    """Global order of the report, by range partitions."""
    return report.orderBy(F.lower("artist"), F.lower("title"), "library_id", "track_id", "part")


def match_metrics(keyed_tracks: DataFrame, needed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per library: needed tracks, those with a code, distinct keys, keys and tracks matched.

    A key may be as long as the name, so its digest moves for it.
    """
    ids = ["library_id", "track_id"]
    digest = F.unhex(F.md5("key")).alias("key")
    found = decisions.select(digest, F.nullif("id", F.lit("")).isNotNull().alias("matched"))
    per_key = (
        keyed_tracks.select(*ids, digest, "isrc").join(needed.select(*ids), ids, "left_semi")
        .groupBy("library_id", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.count("isrc").alias("n_isrc"))
        .join(found, "key", "left")
    )
    hit = F.coalesce("matched", F.lit(False))
    return per_key.groupBy("library_id").agg(
        F.sum("n").alias("n_needed"),
        F.sum("n_isrc").alias("n_isrc"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(hit).alias("n_keys_matched"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_matched"),
    )
