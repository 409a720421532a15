"""Scores of candidate pairs.

``scored`` brings the texts of both sides to each pair and compares them there: one shuffle
of the pairs by entry and one by track.  ``PairScores`` keeps a dictionary of strings instead:
candidate pairs carry numbers, two strings are compared once, in whatever fields, rows and
stages they meet, and the result is joined back, by a shuffle of all pairs for each field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import CATALOG_SIDE, TRACK_SIDE, combined_score, token_set_ratio, with_score
from ..session import materialise

#: Compared fields: of the track, of the entry.
FIELDS = {"title": ("t_title", "c_title"), "artist": ("t_artist", "c_artist"), "lead": ("t_lead", "c_lead"), "album": ("t_album", "c_album")}
#: Of an entry, what is mostly like another of its columns.
LIKE = {"c_name": "c_title", "c_lead": "c_artist"}
#: Only tested for equality.
NAME = ("t_name", "c_name")


def _texts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, text) for each of the columns; a null is an empty text, but equals no name."""
    told = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in NAME else F.coalesce(c, F.lit(""))).alias("text")) for c in columns]
    return rows.select(key, F.inline(F.array(*told))).filter("text is not null")


def scored(tracks: DataFrame, catalog: DataFrame, pairs: DataFrame, on: str = "key", few: bool = False) -> DataFrame:
    """``pairs`` (key, cand_id, ...) with their ``score``; other columns are kept.

    ``on`` names the column that tells a track.  The entry comes first, as its texts are the
    shorter ones to move; the pairs of a track then lie together.  An entry's name and lead move
    only where they differ from its title and artist.  ``pairs`` may bring the texts of their tracks, which
    then are not joined and not kept; ``few`` tells that the catalog may lie beside every task.
    """
    brought = set(TRACK_SIDE) <= set(pairs.columns)
    own = [F.when(~F.col(c).eqNullSafe(F.col(like)), F.struct(c)).alias(c) for c, like in LIKE.items()]
    entries = catalog.select("cand_id", *[c for c in CATALOG_SIDE if c not in LIKE], *own)
    met = pairs.join(F.broadcast(entries) if few else entries, "cand_id")
    if not brought:
        met = met.join(tracks.select(on, *TRACK_SIDE), on)
    whole = {c: F.when(F.col(c).isNull(), F.col(like)).otherwise(F.col(f"{c}.{c}")) for c, like in LIKE.items()}
    kept = [c for c in pairs.columns if not brought or c not in TRACK_SIDE]
    return with_score(met.withColumns(whole)).select(*kept, "score")


class PairScores:
    """Scores pairs of the given tracks and entries; remembers what was compared."""

    def __init__(self, tracks: DataFrame, catalog: DataFrame):
        left = [f[0] for f in FIELDS.values()] + [NAME[0]]
        right = [f[1] for f in FIELDS.values()] + [NAME[1]]
        tracks_told, entries_told = _texts(tracks, "key", left), _texts(catalog, "cand_id", right)
        texts = tracks_told.select("text").unionByName(entries_told.select("text")).distinct()
        self.strings = materialise(texts.withColumn("string", F.monotonically_increasing_id()))
        self._tracks = self._numbers(tracks_told, "key", left).join(tracks.select("key", "t_duration_ms"), "key")
        self._tracks = materialise(self._tracks)
        self._entries = self._numbers(entries_told, "cand_id", right).join(catalog.select("cand_id", "c_duration_s"), "cand_id")
        self._entries = materialise(self._entries)
        self.ratios: DataFrame | None = None

    def _numbers(self, told: DataFrame, key: str, columns: list[str]) -> DataFrame:
        numbered = told.join(self.strings, "text")
        return numbered.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col("string"))).alias(c) for c in columns])

    def _compare(self, pairs: DataFrame) -> None:
        """Compare the strings of ``pairs`` (a, b) that were not compared before."""
        new = pairs.distinct()
        if self.ratios is not None:
            new = new.join(self.ratios.select("a", "b"), ["a", "b"], "left_anti")
        of_a = self.strings.select(F.col("string").alias("a"), F.col("text").alias("text_a"))
        of_b = self.strings.select(F.col("string").alias("b"), F.col("text").alias("text_b"))
        found = new.join(of_a, "a").join(of_b, "b").select("a", "b", token_set_ratio("text_a", "text_b").alias("ratio"))
        found = materialise(found)
        self.ratios = found if self.ratios is None else self.ratios.unionByName(found)

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (key, cand_id, ...) with their ``score``; other columns are kept."""
        columns = pairs.columns
        met = materialise(pairs.join(self._tracks, "key").join(self._entries, "cand_id"))
        sides = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in FIELDS.values()]
        self._compare(met.select(F.inline(F.array(*sides))))
        for field, (a, b) in FIELDS.items():
            ratio = self.ratios.select(F.col("a").alias(a), F.col("b").alias(b), F.col("ratio").alias(f"_{field}"))
            met = met.join(ratio, [a, b])
        return met.select(*columns, combined_score("_title", "_artist", "_lead", "_album", F.col(NAME[0]) == F.col(NAME[1])).alias("score"))
