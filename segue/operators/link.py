"""Link tracks to the catalog: exact code first, scored candidates second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.similarity import CATALOG_SIDE, TRACK_SIDE, with_score
from ..session import broadcast_if_small, materialise
from . import packed
from .pairs import scored
from .prepare import prepare_catalog, prepare_tracks, written
from .search import answer_lists, answer_ways, build_index, known_lists, known_ways, search_by, told_apart, with_queries

DECISION_COLUMNS = ["key", "id", "score", "title", "artist", "album_id", "threshold"]


def ready(representatives: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their prepared columns, written once for all link stages."""
    return ready_tracks(representatives), materialise(prepare_catalog(catalog))


def ready_tracks(representatives: DataFrame) -> DataFrame:
    """Prepared tracks, written; words and queries are told when they are read."""
    return with_queries(written(prepare_tracks(representatives).withColumn("track", F.monotonically_increasing_id())))


def coded(tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tracks with a code that the prepared catalog has."""
    codes = catalog.filter(F.col("c_isrc").isNotNull()).select("c_isrc").distinct()
    return tracks.join(codes, F.upper("isrc") == F.col("c_isrc"), "left_semi")


def link_isrc(tracks: DataFrame, catalog: DataFrame, threshold: float = fv.DEFAULT_THRESHOLD) -> DataFrame:
    """Best entry with the track's code: by score, then popularity, then id.

    Tracks are one per code here, so the join is as long as the catalog side.
    Entries that score alike by content are reduced to their best copy first.
    """
    entries = (
        catalog.filter(F.col("c_isrc").isNotNull())
        .groupBy("c_isrc", *CATALOG_SIDE)
        .agg(
            F.min(
                F.struct(
                    (-F.coalesce("popularity", F.lit(0))).alias("unpopular"), "cand_id", "name", "c_primary", "album_id"
                )
            ).alias("entry")
        )
    )
    coded = tracks.filter(F.col("isrc").isNotNull()).select(
        "key", F.upper("isrc").alias("c_isrc"), *TRACK_SIDE
    )
    scored = with_score(coded.join(entries, "c_isrc"), "_score")
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("_score")).alias("s"), "entry")).alias("best"))
    return best.select(
        "key",
        F.col("best.entry.cand_id").alias("id"),
        F.lit(fv.CODE_MATCH_SCORE).alias("score"),
        F.col("best.entry.name").alias("title"),
        F.col("best.entry.c_primary").alias("artist"),
        F.col("best.entry.album_id").alias("album_id"),
        F.lit(float(threshold)).alias("threshold"),
    )


def score_pairs(tracks: DataFrame, catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score (key, cand_id) pairs; other columns of ``pairs`` are kept."""
    return scored(tracks, catalog, pairs)


def first_query_pairs(found: DataFrame, on: str = "key") -> DataFrame:
    """Each candidate of a key once, at the first query that returned it."""
    # as one number, which a hash aggregate can keep
    at = F.shiftleft(F.col("query_no").cast("bigint"), 32).bitwiseOR(F.col("rank").cast("bigint"))
    return (
        found.groupBy(on, "cand_id")
        .agg(F.min(at).alias("_at"))
        .select(
            on,
            "cand_id",
            F.shiftright("_at", 32).cast("int").alias("query_no"),
            F.col("_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("rank"),
        )
    )


def early_stop(scored: DataFrame, good_enough: float = fv.GOOD_ENOUGH_SCORE, on: str = "key") -> DataFrame:
    """Drop pairs of queries that would not have been asked any more.

    Queries run in order and stop after the first one that leaves the best score so
    far at ``good_enough``.  Only a key's few pairs meet in a window; where they are listed in
    one row as ``pairs``, none is needed.
    """
    if "pairs" in scored.columns:

        def asked(pair: Column) -> Column:
            return ~F.exists("pairs", lambda p: (p["query_no"] < pair["query_no"]) & (p["score"] >= good_enough))

        return scored.withColumn("pairs", F.filter("pairs", asked))
    earlier = (
        Window.partitionBy(on).orderBy("query_no").rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        scored.withColumn("_best", F.max("score").over(earlier))
        .filter(F.col("_best").isNull() | (F.col("_best") < good_enough))
        .drop("_best")
    )


def candidate_pairs(tracks: DataFrame, catalog: DataFrame, limit: int = fv.SEARCH_LIMIT, index=None) -> DataFrame:
    """Scored candidates of every track: (key, track, cand_id, query_no, rank, score)."""
    index = index or build_index(catalog, limit)
    if index.packed:
        pairs = found_pairs(tracks, catalog, limit, index, "key", *TRACK_SIDE)
        return scored(tracks, catalog, pairs, "track", few=True).select("track", "cand_id", "query_no", "rank", "score", "key")
    return _told(_candidate_pairs(tracks, catalog, limit, index), tracks)


def found_pairs(tracks: DataFrame, catalog: DataFrame, limit: int = fv.SEARCH_LIMIT, index=None, *beside: str) -> DataFrame:
    """(track, cand_id, query_no, rank, *beside): as ``first_query_pairs`` of all answers, with columns of the tracks."""
    index = index or build_index(catalog, limit)
    if index.packed:
        lists = answer_lists(tracks, index, limit, "once", *beside)
        return lists.select("track", *beside, F.inline("answers")).select("track", "cand_id", "query_no", "rank", *beside)
    pairs = first_query_pairs(search_by(["track"], tracks, catalog, limit, index), "track")
    return pairs.join(tracks.select("track", *beside), "track") if beside else pairs


def _told(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Add the key to pairs that tell a track by its number."""
    return pairs.join(tracks.select("track", "key"), "track")


def _candidate_pairs(tracks: DataFrame, catalog: DataFrame, limit: int, index) -> DataFrame:
    index = index or build_index(catalog, limit)
    pairs = found_pairs(tracks, catalog, limit, index, *(TRACK_SIDE if index.packed else []))
    return scored(tracks, catalog, pairs, "track", few=bool(index.packed))


def needed_pairs(tracks: DataFrame, catalog: DataFrame, limit: int = fv.SEARCH_LIMIT, index=None) -> DataFrame:
    """What ``early_stop`` leaves of ``candidate_pairs``; the pairs of a track stay where they were scored."""
    index = index or build_index(catalog, limit)
    if index.packed:
        answered = answer_lists(tracks, index, limit, "once", "key", *TRACK_SIDE)
        # every pair is scored here, whatever an earlier query brought
        every = packed.staged(answered, packed.packed_texts(catalog), float("inf"))
        return early_stop(every).select("track", F.inline("pairs"), "key")
    return _told(early_stop(_candidate_pairs(tracks, catalog, limit, index), on="track"), tracks)


def staged_pairs(
    tracks: DataFrame,
    catalog: DataFrame,
    limit: int = fv.SEARCH_LIMIT,
    index=None,
    good_enough: float = fv.GOOD_ENOUGH_SCORE,
) -> DataFrame:
    """What ``early_stop`` leaves of all candidates, without asking for the rest.

    The answers to the first query are scored for all keys, those that a further one adds only for
    keys without a score of ``good_enough`` so far.  All queries of a key are searched at once, and a
    pair is scored once.  By a packed index all that happens where the track lies; else equal searches
    of several keys are one, and every stage is written.
    """
    index = index or build_index(catalog, limit)
    if index.packed:
        lists = _staged_lists(tracks, catalog, limit, index, good_enough)
        return lists.select("track", F.inline("pairs"), "key")
    return _told(_staged_pairs(tracks, catalog, limit, index, good_enough), tracks)


def _staged_lists(tracks: DataFrame, catalog: DataFrame, limit: int, index, good_enough: float = fv.GOOD_ENOUGH_SCORE) -> DataFrame:
    """(track, key, pairs) of every track by a packed index, with the pairs of ``staged_pairs``."""
    searches = known_lists(tracks, index, False, "key", *TRACK_SIDE)
    return packed.staged(answer_ways(searches, index, limit, True), packed.packed_texts(catalog), good_enough)


def _staged_pairs(
    tracks: DataFrame, catalog: DataFrame, limit: int, index, good_enough: float = fv.GOOD_ENOUGH_SCORE
) -> DataFrame:
    """``staged_pairs`` without the key: (track, cand_id, query_no, rank, score)."""
    index = index or build_index(catalog, limit)
    words = known_ways(tracks, index)
    # all queries of a track are searched at once, as they share most of their words; what is asked in
    # stages is the comparison of texts
    distinct = words.groupBy("search_id").agg(F.any_value(F.struct("codes", "lacks")).alias("_s"))
    searches = told_apart(distinct.select("search_id", "_s.codes", "_s.lacks"))
    answers = materialise(answer_ways(searches, index, limit))
    asking = materialise(words.select("track", "search_id").join(searches.select("search_id", "search"), "search_id").select("track", "search"))
    stages: list[DataFrame] = []
    settled = None
    for (number,) in sorted(map(tuple, answers.select("query_no").distinct().collect())):
        now = asking if settled is None else asking.join(settled, "track", "left_anti")
        found = now.join(answers.filter(F.col("query_no") == number), "search").select("track", "cand_id", "query_no", "rank")
        stages.append(materialise(scored(tracks, catalog, found, "track")))
        settled = reduce(DataFrame.unionByName, [s.filter(F.col("score") >= good_enough).select("track") for s in stages]).distinct()
    if not stages:
        return _candidate_pairs(tracks, catalog, limit, index)
    return reduce(DataFrame.unionByName, stages)


def stage_counts(staged: DataFrame, good_enough: float = fv.GOOD_ENOUGH_SCORE) -> DataFrame:
    """Per query: keys with new candidates, pairs scored, keys settled by it."""
    per_key = staged.groupBy("query_no", "track").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    return per_key.groupBy("query_no").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_pairs"), F.count_if(F.col("best") >= good_enough).alias("n_settled")
    )


def link_fuzzy(
    tracks: DataFrame,
    catalog: DataFrame,
    threshold: float = fv.DEFAULT_THRESHOLD,
    limit: int = fv.SEARCH_LIMIT,
    index=None,
) -> DataFrame:
    """Best scored candidate per key; id null below the threshold, score 0 without any."""
    index = index or build_index(catalog, limit)
    names = catalog.select("cand_id", F.col("name").alias("title"), F.col("c_primary").alias("artist"), "album_id")
    if index.packed:
        # the pairs of a track lie in its row
        ranked = F.transform("pairs", lambda p: F.struct((-p["score"]).alias("s"), p["query_no"], p["rank"], p["cand_id"].alias("cand_id")))
        best = _staged_lists(tracks, catalog, limit, index).select("track", "key", F.array_min(ranked).alias("b"))
        names = F.broadcast(names)
    else:
        best = (
            _staged_pairs(tracks, catalog, limit, index)
            .groupBy("track")
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "query_no", "rank", "cand_id")).alias("b"))
        )
        best = tracks.select("key", "track").join(best, "track", "left")
    best = best.select("key", F.col("b.cand_id").alias("cand_id"), (-F.col("b.s")).alias("score"))
    accepted = F.col("score") >= threshold
    named = best.withColumn("cand_id", F.when(accepted, F.col("cand_id"))).join(names, "cand_id", "left")
    return named.select(
        "key",
        F.col("cand_id").alias("id"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("artist", F.lit("")).alias("artist"),
        "album_id",
        F.lit(float(threshold)).alias("threshold"),
    )


def link_tracks(
    tracks: DataFrame,
    catalog: DataFrame,
    threshold: float = fv.DEFAULT_THRESHOLD,
    limit: int = fv.SEARCH_LIMIT,
    index=None,
) -> DataFrame:
    """Decision per key: by code where the catalog has it, else by search.

    ``index`` is the catalog's index, where it is searched again and again.
    """
    codes = catalog.filter(F.col("c_isrc").isNotNull()).select("c_isrc").distinct()
    codes = broadcast_if_small(codes, packed.ENTRIES)  # else all tracks would move
    uncoded = tracks.join(codes, F.upper("isrc") == F.col("c_isrc"), "left_anti")
    return link_isrc(tracks, catalog, threshold).unionByName(
        link_fuzzy(uncoded, catalog, threshold, limit, index)
    )
