"""Sinks: account backups, the report file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.ranking import rank_by_position
from ..plans.report import report_order

ITEMS_PER_ROW = 1000


def account_backup(
    playlists: DataFrame, playlist_items: DataFrame, items: DataFrame, saved_at, items_per_row: int = ITEMS_PER_ROW
) -> DataFrame:
    """Readable backup of an account: one row per playlist and per kind of favorite.

    (library_id, kind, id, name, own, part, n_items, tracks): long lists continue in
    further parts.  Nothing is left out.  Artists of items are kept where they are given.
    """

    def artist(df: DataFrame):
        return (F.coalesce("artist", F.lit("")) if "artist" in df.columns else F.lit("")).alias("item_artist")

    listed = playlist_items.select("library_id", F.col("playlist_id").alias("id"), F.lit("playlist").alias("kind"), "pos", F.col("track_id").alias("item_id"), F.col("track_name").alias("item_name"), artist(playlist_items))
    favorites = items.select("library_id", F.lit("").alias("id"), "kind", "pos", F.col("id").alias("item_id"), F.col("name").alias("item_name"), artist(items))
    group = ["library_id", "kind", "id"]
    ranked = rank_by_position(listed.unionByName(favorites), group, "pos")
    parts = (
        ranked.withColumn("part", F.expr(f"(rank - 1) div {items_per_row}"))
        .groupBy(*group, "part")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("item_id").alias("id"), F.col("item_name").alias("name"), F.col("item_artist").alias("artist")))).alias("_t"))
        .select(*group, "part", F.size("_t").alias("n_items"), F.transform("_t", lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"), t["artist"].alias("artist"))).alias("tracks"))
    )
    heads = playlists.select("library_id", F.lit("playlist").alias("kind"), F.col("playlist_id").alias("id"), "name", "own")
    empty = F.array().cast("array<struct<id:string,name:string,artist:string>>")
    backed_up = heads.join(parts.filter("kind = 'playlist'"), group, "left").unionByName(
        parts.filter("kind <> 'playlist'").select("*", F.lit("").alias("name"), F.lit(True).alias("own"))
    )
    return backed_up.select(
        *group,
        "name",
        "own",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("tracks", empty).alias("tracks"),
        F.date_format(saved_at, fv.SAVED_AT_FORMAT).alias("saved_at"),
    )


def write_backup(backup: DataFrame, folder: str) -> None:
    """JSON lines below ``folder``, one folder per moment of saving."""
    backup.write.partitionBy("saved_at").mode("append").json(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """The unmatched tracks as CSV with a header, in report order.

    The score has one decimal there; the report itself keeps it as it is.  A track whose
    list of playlists goes on in further rows is told by its id and the row's ``part``.
    """
    rounded = report_order(report).withColumn("best_score", F.round("best_score", fv.REPORT_DECIMALS))
    rounded.select(*fv.REPORT_COLUMNS, "library_id", "track_id", "part").write.option("header", True).csv(folder)
