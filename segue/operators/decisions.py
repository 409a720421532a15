"""The table of earlier decisions, keyed by identity and threshold."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import fixed_values as fv
from ..schemas import DECISIONS
from ..sources import quarantine


def load(spark: SparkSession, path: str) -> DataFrame:
    """Decisions stored at ``path``; none where nothing was stored yet."""
    try:
        return spark.read.schema(DECISIONS).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], DECISIONS)


def split_sound(decisions: DataFrame) -> quarantine.Split:
    """Stored decisions, those without a key, a score or a threshold apart."""
    return quarantine.split(decisions, "decisions", "key", quarantine.unsound_decision())


def needs_match(threshold: float, rematch: bool = False):
    """Column: is the left-joined decision (id, score, known) absent or overturned?"""
    matched = F.col("id").isNotNull()
    overturned = matched != (F.coalesce("score", F.lit(0.0)) >= threshold)
    stale = overturned | ~matched if rematch else overturned
    return F.col("known").isNull() | stale


def work_list(
    representatives: DataFrame, decisions: DataFrame, threshold: float = fv.DEFAULT_THRESHOLD, rematch: bool = False
) -> DataFrame:
    """Keys to search, each marked ``stale`` when it had a decision."""
    known = decisions.select("key", "id", "score", F.lit(True).alias("known"))
    return (
        representatives.join(known, "key", "left")
        .filter(needs_match(threshold, rematch))
        .withColumn("stale", F.col("known").isNotNull())
        .drop("id", "score", "known")
    )


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New decisions replace old ones of the same key; the others stay."""
    return new.unionByName(old.join(new.select("key"), "key", "left_anti"))


def rekey(decisions: DataFrame, keyed_tracks: DataFrame) -> DataFrame:
    """Bring a table keyed by track id to identity keys.

    Only a table without any identity key is rekeyed.  Where several stored decisions
    reach the same key the first by ``pos`` stays; unknown track ids are dropped.
    """
    prefixes = [fv.CODE_KEY_PREFIX, fv.NAME_KEY_PREFIX, fv.ALBUM_CODE_KEY_PREFIX]
    is_current = reduce(or_, [F.col("key").startswith(prefix) for prefix in prefixes])
    values = [c for c in decisions.columns if c not in ("key", "pos")]
    if not decisions.filter(is_current).isEmpty():
        return decisions.select("key", *values)
    return (
        decisions.withColumnRenamed("key", "track_id")
        .join(keyed_tracks.select("track_id", "key").distinct(), "track_id")
        .groupBy("key")
        .agg(F.min(F.struct("pos", *values)).alias("_first"))
        .select("key", *[F.col(f"_first.{c}").alias(c) for c in values])
    )


def rename_legacy(decisions: DataFrame, prefix: str) -> DataFrame:
    """Fold fields named ``<prefix>_id|title|artist`` into id, title and artist.

    A null id is a decision and stays null.
    """
    out = decisions
    for field in ("id", "title", "artist"):
        legacy = f"{prefix}_{field}"
        if legacy in out.columns:
            value = F.coalesce(field, legacy) if field in out.columns else F.col(legacy)
            out = out.withColumn(field, value).drop(legacy)
    return out


def upc_todo(albums: DataFrame, memo: DataFrame, rematch: bool = False) -> DataFrame:
    """Distinct album codes not settled by the memo; absences reopen on rematch."""
    settled = memo.filter(F.col("album_id").isNotNull()) if rematch else memo
    return (
        albums.filter(F.nullif("upc", F.lit("")).isNotNull())
        .select("upc")
        .distinct()
        .join(settled.select("upc"), "upc", "left_anti")
    )


def upc_lookup(codes: DataFrame, upc_catalog: DataFrame) -> DataFrame:
    """First catalog album of each code; null where the catalog has none."""
    first = upc_catalog.groupBy("upc").agg(F.min(F.struct("pos", "album_id")).alias("_f"))
    return codes.join(first, "upc", "left").select("upc", F.col("_f.album_id").alias("album_id"))


def upc_memo(albums: DataFrame, memo: DataFrame, upc_catalog: DataFrame, rematch: bool = False) -> DataFrame:
    """The memo after looking up what it did not settle, absences included."""
    found = upc_lookup(upc_todo(albums, memo, rematch), upc_catalog)
    return found.unionByName(
        memo.select("upc", "album_id").join(found.select("upc"), "upc", "left_anti")
    )
