"""Reconcile an account: summary, deletion plan, verification, reset gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .ranking import rank_by_position

ITEM_KINDS = ["track", "album", "artist", "followed"]


def split_playlists(playlists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own playlists and followed ones; a playlist owned is never followed."""
    own = playlists.filter("own")
    followed = playlists.filter("not own").join(
        own.select("library_id", "playlist_id"), ["library_id", "playlist_id"], "left_anti"
    )
    return own, followed


def owned(playlists: DataFrame) -> DataFrame:
    """Playlists the account holder owns or shares: owner_id, me, collaborative."""
    return playlists.filter(
        F.coalesce(F.col("owner_id") == F.col("me"), F.lit(False))
        | F.coalesce(F.col("collaborative"), F.lit(False))
    )


def account_summary(playlists: DataFrame, items: DataFrame) -> DataFrame:
    """What an account holds, per library, in one pass over each table."""
    counted = playlists.select(
        "library_id", F.when(F.col("own"), F.lit("own")).otherwise("followed").alias("kind")
    ).unionByName(items.select("library_id", "kind"))
    return counted.groupBy("library_id").agg(
        F.count_if(F.col("kind") == "own").alias("n_own"),
        F.count_if(F.col("kind") == "followed").alias("n_followed"),
        F.count_if(F.col("kind") == "track").alias("n_tracks"),
        F.count_if(F.col("kind") == "album").alias("n_albums"),
        F.count_if(F.col("kind") == "artist").alias("n_artists"),
    )


def deletion_plan(
    playlists: DataFrame,
    items: DataFrame,
    kinds: list[str],
    names: DataFrame | None = None,
) -> DataFrame:
    """What to delete: (library_id, kind, id, name, pos).

    ``kinds`` from playlist, track, album, artist, followed.  ``names`` limits the own
    playlists by (library_id, name).  Rows without id are left out.
    """
    own, followed = split_playlists(playlists)
    if names is not None:
        own = own.join(names.select("library_id", "name").distinct(), ["library_id", "name"], "left_semi")

    def of(df, kind, ident):
        return df.select("library_id", F.lit(kind).alias("kind"), F.col(ident).alias("id"), "name", "pos")

    parts = []
    if "playlist" in kinds:
        parts.append(of(own, "playlist", "playlist_id"))
    if "followed" in kinds:
        parts.append(of(followed, "followed", "playlist_id"))
    wanted = [k for k in kinds if k in ITEM_KINDS]
    if wanted:
        parts.append(items.filter(F.col("kind").isin(wanted)).select("library_id", "kind", "id", "name", "pos"))
    plan = reduce(DataFrame.unionByName, parts)
    return plan.filter(F.nullif("id", F.lit("")).isNotNull())


def deletion_chunks(plan: DataFrame, size: int = fv.LIBRARY_CHUNK) -> DataFrame:
    """The plan with the batch each row is deleted in."""
    ranked = rank_by_position(plan, ["library_id", "kind"], "pos")
    return ranked.withColumn("chunk", F.expr(f"(rank - 1) div {size}")).drop("rank")


def verify_deletions(
    planned: DataFrame,
    playlists_after: DataFrame,
    items_after: DataFrame,
    kinds: list[str],
    dry_run: bool = False,
) -> DataFrame:
    """Per library and kind: what is left, a preview of names, and whether that is fine.

    A playlist is left over when its name was to be deleted; favorites are fine only
    when none at all remain.  A dry run is always fine.
    """
    libraries = planned.select("library_id").distinct()
    expected = planned.filter("kind = 'playlist'").select("library_id", "name").distinct()
    left = items_after.filter(F.col("kind").isin([k for k in kinds if k in ("track", "album")])).select(
        "library_id", "kind", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("pos")
    )
    if "playlist" in kinds:
        still = playlists_after.join(expected, ["library_id", "name"], "left_semi")
        left = left.unionByName(still.select("library_id", F.lit("playlist").alias("kind"), "name", "pos"))
    # the preview needs five names only: the lowest positions, kept map-side
    counted = left.groupBy("library_id", "kind").agg(F.count(F.lit(1)).alias("n_left"))
    lowest = Window.partitionBy("library_id", "kind").orderBy("pos")
    preview = (
        left.filter(F.col("name").isNotNull())
        .withColumn("_n", F.row_number().over(lowest))
        .filter(F.col("_n") <= fv.PREVIEW_NAMES)
        .groupBy("library_id", "kind")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "name"))).alias("_names"))
        .select("library_id", "kind", F.array_join(F.transform("_names", lambda s: s["name"]), ", ").alias("_shown"))
    )
    asked = libraries.select("library_id", F.explode(F.array(*map(F.lit, [k for k in kinds if k in ("playlist", "track", "album")]))).alias("kind"))
    n_left = F.coalesce("n_left", F.lit(0))
    return (
        asked.join(counted, ["library_id", "kind"], "left")
        .join(preview, ["library_id", "kind"], "left")
        .select(
            "library_id",
            "kind",
            n_left.alias("n_left"),
            F.concat(
                F.coalesce("_shown", F.lit("")),
                F.when((F.col("kind") == "playlist") & (n_left > fv.PREVIEW_NAMES), F.lit(" …")).otherwise(""),
            ).alias("preview"),
            ((n_left == 0) | F.lit(dry_run)).alias("ok"),
        )
    )


def reset_gate(verified: DataFrame) -> DataFrame:
    """Libraries and whether their import may go ahead: everything verified."""
    return verified.groupBy("library_id").agg(F.bool_and("ok").alias("may_import"))
