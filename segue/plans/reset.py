"""Emptying an account before an import: backup, deletions, verification, and the gate behind them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import account
from ..operators.selection import reset_scope
from ..session import materialise
from ..sinks.tables import account_backup

#: What a reset deletes; artists and followed playlists are left alone.
KINDS = ["playlist", "track", "album"]


class Reset(NamedTuple):
    backup: DataFrame
    deletions: DataFrame  #: with the chunk each row is deleted in
    verified: DataFrame
    gate: DataFrame  #: library_id, may_import


def plan(playlists: DataFrame, items: DataFrame, favorites: DataFrame, imported: DataFrame | None, saved_at: Column) -> tuple[DataFrame, DataFrame]:
    """(backup, deletions): everything there is, and what the import will bring anew.

    ``items`` carry track names; ``imported`` names the playlists the import brings, all own
    ones where it is None.
    """
    backup = account_backup(playlists, items, favorites, saved_at)
    own = playlists.filter("own") if imported is None else reset_scope(playlists, imported)
    doomed = account.deletion_plan(own.withColumn("own", F.lit(True)), favorites, KINDS)
    return backup, materialise(account.deletion_chunks(doomed))


def verify(backup: DataFrame, deletions: DataFrame, playlists_after: DataFrame, favorites_after: DataFrame, dry_run: bool = False) -> Reset:
    """What is left of what was to be deleted, and which libraries may be imported to."""
    verified = materialise(account.verify_deletions(deletions, playlists_after, favorites_after, KINDS, dry_run))
    return Reset(backup, deletions, verified, account.reset_gate(verified))


def gated(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of libraries that the gate does not hold back; one with nothing to delete passes."""
    held = gate.filter(~F.col("may_import")).select("library_id")
    return rows.join(held, "library_id", "left_anti")
