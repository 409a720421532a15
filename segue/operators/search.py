"""Candidate search: a ranked word search of the catalog as equi-joins.

A word found in ``df`` distinct entries weighs ``10^12 div df``.  Every entry that shares a
known word with a query may answer; the best twelve by weight answer, ties by popularity,
then by entry id.

Words are numbers that begin with ``df``, so a sorted set of them goes from rare to frequent
and tells its weights; entries are numbers too.  Equal sets of known words are searched once,
equal catalog entries are indexed once.  What keeps the join narrow without losing an answer:

1. Seeds: a query's rarest words are looked up in short lists, the most popular entries of a
   word.  A bounded number of rows for each query gives exact weights of some entries, and the
   twelfth best of these is a floor: no answer weighs less.
2. Words are then looked up in whole, from rare to frequent, only as long as this and all that
   follow together reach the floor; an entry that shares none of them cannot.  Neither can one
   whose own words from there on stay below it, which a posting tells without a comparison.  Each
   pair is judged once, at its rarest shared word, and pairs below the floor go no further.
3. A query's most frequent word, where it is reached, needs its short list only: whatever shares
   just that word weighs the same, and the most popular answer first.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..session import materialise
from . import packed
from .ranking import numbered

WEIGHT_SCALE = 1_000_000_000_000
#: A word's code is its number of entries, then so many bits of a number of its own.
NUMBER_BITS = 33
#: Queries of a track at most.
QUERIES = 4
#: Most popular entries kept apart for each word; at least the number of answers.
HEAD = 32


def _weight(code: Column) -> Column:
    """Weight of a word: its code carries how many entries hold it."""
    return F.call_function("div", F.lit(WEIGHT_SCALE), F.shiftright(code, NUMBER_BITS))


def _total(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: s + _weight(c))


def with_queries(tracks: DataFrame) -> DataFrame:
    """Add ``terms``, the distinct words of all queries of a track, and ``asked``: the
    distinct non-empty queries in order, each with the few of those words it lacks; and
    ``track``, a number that stands for the key, which may be as long as the name.

    Numbered by place: write the numbers before searching with it.  Tracks that have a number keep it.
    """
    prepared = (
        tracks.withColumn("_lead", text.clean_artist("artist"))
        .withColumn("_title", text.clean_title("name"))
        .withColumn("_album_lead", text.clean_artist("album_artist"))
        .withColumn("_n_album_lead", text.norm("_album_lead"))
    )
    fields = ["t_lead", "t_title", "t_artist", "t_name", "_n_album_lead"]

    def split_words(parts: list) -> Column:
        return F.split(F.concat_ws(" ", *parts), " ")

    def own(fields: list[str], before: list[str]) -> list:
        # a field equal to one before it brings no words of its own
        told = []
        for f in fields:
            new = reduce(Column.__and__, [~F.col(f).eqNullSafe(F.col(b)) for b in before], F.lit(True))
            told.append(F.when(new, F.col(f)))
            before = [*before, f]
        return told

    def query(parts: list[str], used: list[str]) -> Column:
        # the words of a concatenation are the words of its parts; mostly only short fields
        # are left to compare, or none
        spare = own([f for f in fields if f not in used], used)
        lacking = F.array_except(split_words(spare), split_words([F.col(f) for f in used]))
        text_of = text.strip(F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts]))
        missing = F.when(F.concat_ws("", *spare) == "", F.array().cast("array<string>")).otherwise(F.sort_array(F.array_remove(lacking, "")))
        return F.when(text_of != "", F.struct(text_of.alias("query"), missing.alias("missing")))

    asked = F.array(
        query(["_lead", "_title"], ["t_lead", "t_title"]),
        query(["artist", "name"], ["t_artist", "t_name"]),
        query(["_title", "_album_lead"], ["t_title", "_n_album_lead"]),
        query(["_title"], ["t_title"]),
    )
    asking = (
        # distinct ones that are not null; a filter by a function would keep all of it from being compiled
        prepared.withColumn("asked", F.array_except(asked, F.array(F.lit(None))))
        .withColumn("_words", F.sort_array(split_words(own(fields, []))))
        # sorted, so a repeated word follows itself: linear in the length of the text
        .withColumn(
            "terms",
            F.filter("_words", lambda w, i: (w != "") & ((i == 0) | (F.get("_words", i - 1) != w))),
        )
        .drop("_lead", "_title", "_album_lead", "_n_album_lead", "_words")
    )
    return asking if "track" in tracks.columns else asking.withColumn("track", F.monotonically_increasing_id())


def search_queries(tracks: DataFrame) -> DataFrame:
    """Up to four distinct queries per key, in the order they are to be tried."""
    return (
        # outer, as the filter that an inner one implies would compute the queries twice
        tracks.select("key", "terms", F.posexplode_outer("asked").alias("query_no", "_q"))
        .filter("query_no is not null")
        .select("key", "query_no", "_q.query", F.array_except("terms", "_q.missing").alias("terms"))
    )


class Index(NamedTuple):
    """A catalog ready to be searched; all tables written."""

    entries: DataFrame  #: entry, codes (sorted), cands (best first)
    terms: DataFrame  #: term, code
    heads: DataFrame  #: code, entry, entry_codes, rest: the most popular entries of each word
    packed: packed.Packed | None = None  #: all of it as arrays beside every worker, where it is small enough


def catalog_index(catalog: DataFrame, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    """Distinct word sets of the catalog with the entries that answer for them.

    Entries with the same words tie on weight, so the ``limit`` most popular of them, then
    of the lowest ids, are all a search can return: the window keeps them map-side before
    the shuffle.
    """
    entries = catalog.select(
        "cand_id",
        F.coalesce("popularity", F.lit(0)).cast("bigint").alias("popularity"),
        F.sort_array(text.words(F.concat_ws(" ", "c_name", "c_artist"))).alias("entry_terms"),
    )
    order = Window.partitionBy("entry_terms").orderBy(F.desc("popularity"), "cand_id")
    return (
        entries.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .groupBy("entry_terms")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("popularity")).alias("unpopular"), "cand_id"))).alias("cands"))
    )


def _postings(entries: DataFrame, *more: Column) -> DataFrame:
    """(code, entry, entry_codes, rest): each word of an entry; ``rest`` is what it weighs with
    all more frequent words of the entry."""
    listed = entries.select("entry", F.col("codes").alias("entry_codes"), *more, F.posexplode("codes").alias("_at", "code"))
    rest = _total(F.slice("entry_codes", F.col("_at") + 1, F.size("entry_codes")))
    return listed.withColumn("rest", rest).drop("_at")


def build_index(catalog: DataFrame, limit: int = fv.SEARCH_LIMIT) -> Index:
    """Index of a prepared catalog.  True sizes then let Spark choose how to join."""
    sets = numbered(catalog_index(catalog, limit), "entry")
    held = sets.select("entry", F.explode("entry_terms").alias("term"))
    terms = numbered(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "number")
    terms = materialise(terms.select("term", F.shiftleft("df", NUMBER_BITS).bitwiseOR(F.col("number")).alias("code")))
    coded = held.join(terms, "term").groupBy("entry").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    entries = materialise(coded.join(sets.select("entry", "cands"), "entry"))
    best = Window.partitionBy("code").orderBy("best", "entry")
    heads = (
        _postings(entries, F.col("cands")[0].alias("best"))
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= max(HEAD, limit))
        .drop("_n", "best")
    )
    size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("codes")), F.lit(0)), F.coalesce(F.sum(F.size("cands")), F.lit(0))).first()
    if max(size[0], size[2]) <= packed.ENTRIES and size[1] <= packed.POSTINGS:
        return Index(entries, terms, heads, packed.packed_index(entries, terms, NUMBER_BITS, WEIGHT_SCALE))
    return Index(entries, terms, materialise(heads))


def _missing(tracks: DataFrame) -> Column:
    return F.transform("asked", lambda q: q["missing"]) if "asked" in tracks.columns else F.col("missing")


def answer_lists(tracks: DataFrame, index: Index, limit: int, stay: str, *beside: str) -> DataFrame:
    """(track, *beside, answers) of every track by a packed index: (query_no, rank, weight, cand_id) in order.

    Tracks stay where they are.  ``stay`` is as of ``packed.answers``; a track without a key gets no answers.
    """
    return packed.answers(known_lists(tracks, index, stay == "all", *beside), index.packed, limit, max(HEAD, limit), QUERIES, stay)


def known_lists(tracks: DataFrame, index: Index, every: bool, *beside: str) -> DataFrame:
    """(track, *beside, codes, lacks) of every track by a packed index; see ``known_ways``."""
    terms = F.when(F.col("key").isNotNull(), F.col("terms")).otherwise(F.array().cast("array<string>"))
    told = tracks.select("track", *beside, terms.alias("terms"), _missing(tracks).alias("missing"))
    return packed.known(told, index.packed, list(beside), QUERIES, every)


def _known(tracks: DataFrame, index: Index) -> DataFrame:
    """(track, queries, all_known, lacked): the known words of a track, rare ones first, the
    number of its queries, and (code, lacking) of those words that some query lacks."""
    # the words of all queries of a track are looked up together, once; a word tells by a bit
    # the queries that lack it, which is told before texts are left behind
    tracks = tracks.filter(F.col("key").isNotNull()).select("track", "terms", _missing(tracks).alias("missing"))
    lacking = reduce(
        Column.bitwiseOR, [F.when(F.array_contains(F.get("missing", F.lit(n)), F.col("term")), 1 << n).otherwise(0) for n in range(QUERIES)]
    )
    return (
        tracks.select("track", "missing", F.explode("terms").alias("term"))
        .select("track", F.size("missing").alias("queries"), "term", lacking.alias("lacking"))
        .join(index.terms, "term")
        .groupBy("track", "queries")
        .agg(
            F.sort_array(F.collect_list("code")).alias("all_known"),
            F.collect_list(F.when(F.col("lacking") != 0, F.struct("code", "lacking"))).alias("lacked"),
        )
    )


def _lacked(number: Column) -> Column:
    """Known words of a track that its query of this number lacks."""
    bit = F.call_function("shiftleft", F.lit(1), number)
    return F.transform(F.filter("lacked", lambda w: w["lacking"].bitwiseAND(bit) != 0), lambda w: w["code"])


def known_words(tracks: DataFrame, index: Index) -> DataFrame:
    """(key, track, query_no, search_id, codes): the known words of each query, rare ones first.

    Written: it is read whole for the distinct searches and narrow for the way back.
    """
    lacked = _lacked(F.col("query_no"))
    codes = F.when(F.size(lacked) == 0, F.col("all_known")).otherwise(F.array_except("all_known", lacked))
    return materialise(
        tracks.filter(F.col("key").isNotNull())
        .select("key", "track")
        .join(_known(tracks, index), "track")
        .select("key", "track", "all_known", "lacked", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("query_no"))
        .withColumn("codes", codes)
        .filter(F.size("codes") > 0)
        .select("key", "track", "query_no", F.unhex(F.md5(F.array_join("codes", " "))).alias("search_id"), "codes")
    )


def known_ways(tracks: DataFrame, index: Index) -> DataFrame:
    """(track, search_id, codes, lacks): the known words of all queries of a track, rare ones first,
    and for each query those it lacks; null for a query that knows none, or the same as an earlier one.

    Written: it is read whole for the distinct searches and narrow for the way back.
    """
    told = F.concat_ws(
        "|", F.array_join("all_known", " "), F.array_join(F.transform("lacks", lambda l: F.coalesce(F.array_join(l, " "), F.lit("-"))), "|")
    )
    lacks = F.transform(
        "lacked_by",
        lambda lack, n: F.when(
            (F.size(lack) < F.size("all_known")) & (F.array_position("lacked_by", lack) == n + 1), lack
        ),
    )
    return materialise(
        _known(tracks, index)
        .withColumn("lacked_by", F.transform(F.sequence(F.lit(0), F.col("queries") - 1), lambda n: F.sort_array(_lacked(n))))
        .withColumn("lacks", lacks)
        .select("track", F.unhex(F.md5(told)).alias("search_id"), F.col("all_known").alias("codes"), "lacks")
    )


def _judged(met: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, entry, weight): each pair of a search and an entry that was met, with its exact weight.

    ``met`` (search, floor, entry, later) may tell a pair at several words.  What follows in both
    weighs most at the rarest shared word, and is then all they share.  The words of a search are
    joined where pairs were met, not carried with every word that is looked up.
    """
    # the short side is hashed.  Shared words become rows, whose sum is compiled, unlike one by a
    # function on the list; outer, as the filter that an inner one implies would compute them twice
    shared = F.explode_outer(F.array_intersect("codes", "later")).alias("code")
    return (
        met.join(searches.select("search", "codes").hint("shuffle_hash"), "search")
        .select("search", "entry", "floor", F.col("later")[0].alias("at"), shared)
        .groupBy("search", "entry", "floor", "at")
        .agg(F.sum(_weight(F.col("code"))).alias("weight"))
        .filter("weight >= floor")
        .groupBy("search", "entry")
        .agg(F.max("weight").alias("weight"))
    )


def _met(lookups: DataFrame, lists: DataFrame) -> DataFrame:
    """(search, floor, entry, later): the entries of ``lists`` under the words looked up that can
    reach the floor, and their words from there on."""
    later = F.filter("entry_codes", lambda c: c >= F.col("code"))
    # lists are few beside lookups
    lists = lists.select("code", "entry", "rest", later.alias("later")).hint("shuffle_hash")
    return lookups.select("search", "floor", "code").join(lists, "code").filter("rest >= floor").select("search", "floor", "entry", "later")


def _meetings(lookups: DataFrame, lists: DataFrame) -> DataFrame:
    """(search, at, entry, entry_codes): like ``_met``, with the word that was looked up and all words of the entry."""
    lists = lists.select(F.col("code").alias("at"), "entry", "rest", "entry_codes").hint("shuffle_hash")
    asked = lookups.select("search", "floor", F.col("code").alias("at"))
    return asked.join(lists, "at").filter("rest >= floor").select("search", "at", "entry", "entry_codes")


def _weights(meetings: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, entry, floors, weights): each pair that was met, with its exact weight for each query of
    the search; null where the query is not asked or shares no word with the entry.

    A pair met at several words tells all it shares each time, and once each time the word it was met at.
    """
    # outer, as the filter that an inner one implies would compute the shared words twice
    shared = F.explode_outer(F.array_intersect("codes", "entry_codes")).alias("code")

    def weight(n: int) -> Column:
        lacked = F.array_contains(F.get("lacks", F.lit(n)), F.col("code"))
        return F.call_function("div", F.sum(F.when(~lacked, _weight(F.col("code")))), F.count_if(F.col("code") == F.col("at"))).alias(f"w{n}")

    return (
        meetings.join(searches.select("search", "codes", "lacks", "floors").hint("shuffle_hash"), "search")
        .select("search", "entry", "floors", "at", "lacks", shared)
        .groupBy("search", "entry", "floors")
        .agg(F.struct(*[weight(n) for n in range(QUERIES)]).alias("weights"))
    )


def _seeds(codes: Column, limit: int) -> Column:
    """The rarest of the words, until their short lists hold twice as many entries as answers."""
    start = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(0).alias("n"))
    taken = F.aggregate(
        codes,
        start,
        lambda s, c: F.when(s["rows"] >= 2 * limit, s).otherwise(
            F.struct((s["rows"] + F.least(F.shiftright(c, NUMBER_BITS), F.lit(HEAD))).alias("rows"), (s["n"] + 1).alias("n"))
        ),
        lambda s: s["n"],
    )
    return F.slice(codes, F.lit(1), taken)


def floors(searches: DataFrame, index: Index, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    """(search, floor): a weight that ``limit`` entries at least reach; absent where unknown.

    Words are taken until their short lists hold twice as many entries as answers, so at most
    2 * limit + HEAD rows meet for a search.
    """
    seeds = searches.select("search", F.lit(0).alias("floor"), F.explode(_seeds(F.col("codes"), limit)).alias("code"))
    return (
        _judged(_met(seeds, index.heads), searches)
        .groupBy("search")
        .agg(F.sort_array(F.collect_list("weight"), asc=False).alias("weights"))
        .filter(F.size("weights") >= limit)
        .select("search", F.col("weights")[limit - 1].alias("floor"))
    )


def _needed() -> Column:
    """How many words of a search are looked up in whole: this and all that follow reach the floor."""
    start = F.struct(F.col("total").alias("left"), F.lit(0).alias("n"))
    return F.aggregate(
        "codes",
        start,
        lambda s, c: F.when(s["left"] < F.col("floor"), s).otherwise(
            F.struct((s["left"] - _weight(c)).alias("left"), (s["n"] + 1).alias("n"))
        ),
        lambda s: s["n"],
    )


def _floored(searches: DataFrame, index: Index, limit: int) -> DataFrame:
    """``searches`` with their ``floor`` and how many of their words are looked up in whole."""
    return (
        searches.join(floors(searches, index, limit), "search", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0)))
        .withColumn("total", _total(F.col("codes")))
        .withColumn("needed", _needed())
        .drop("total")
    )


def _floored_ways(searches: DataFrame, index: Index, limit: int) -> DataFrame:
    """``searches`` asked in several ways with the floor of each in ``floors``, the lowest of them as
    ``floor``, and how many words are looked up in whole."""
    # of each query that is asked, its own rarest words; a query mostly lacks none or few
    asked = F.filter("lacks", lambda lack: lack.isNotNull())
    rarest = F.flatten(F.transform(asked, lambda lack: _seeds(F.array_except("codes", lack), limit)))
    seeds = searches.select("search", F.lit(0).alias("floor"), F.explode(F.array_distinct(rarest)).alias("code"))
    unknown = F.struct(*[F.lit(0).cast("bigint").alias(f"f{n}") for n in range(QUERIES)])
    met = _weights(_meetings(seeds, index.heads), searches.withColumn("floors", unknown))
    # a list of weights is short: no query takes more than 2 * limit + HEAD seed rows
    best = [F.sort_array(F.collect_list(f"weights.w{n}"), asc=False).alias(f"b{n}") for n in range(QUERIES)]
    floor = [F.coalesce(F.get(f"b{n}", F.lit(limit - 1)), F.lit(0).cast("bigint")).alias(f"f{n}") for n in range(QUERIES)]
    found = met.groupBy("search").agg(*best).select("search", F.struct(*floor).alias("floors"))
    # a query that is not asked lowers no floor
    lowest = F.least(*[F.when(F.get("lacks", F.lit(n)).isNotNull(), F.col(f"floors.f{n}")) for n in range(QUERIES)])
    return (
        searches.join(found, "search", "left")
        .withColumn("floors", F.coalesce("floors", unknown))
        .withColumn("floor", F.coalesce(lowest, F.lit(0)))
        .withColumn("total", _total(F.col("codes")))
        .withColumn("needed", _needed())
        .drop("total")
    )


def _words(floored: DataFrame, *columns: str) -> DataFrame:
    return floored.select(*columns, F.posexplode(F.slice("codes", F.lit(1), F.col("needed"))).alias("at", "code"))


def lookups(searches: DataFrame, index: Index, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    """(search, codes, floor, code, at): the words of each search that are looked up in whole."""
    return _words(_floored(searches, index, limit), "search", "codes", "floor")


def answer(searches: DataFrame, index: Index, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    """Ranked answers of written ``searches`` (search_id, codes, search): (search_id, cand_id, weight, rank)."""
    if index.packed:
        listed = packed.answers(searches.select("search_id", "codes"), index.packed, limit, max(HEAD, limit), 1, "all")
        return listed.select("search_id", F.inline("answers")).select("search_id", "cand_id", "weight", "rank")
    # one row for each search; its words are told apart when it is read
    floored = materialise(_floored(searches, index, limit))
    met = _in_whole(_met, floored, index)
    ranking = Window.partitionBy("search").orderBy(F.desc("weight"), "unpopular", "cand_id")
    return (
        _judged(met, searches)
        .join(index.entries.select("entry", "cands"), "entry")
        .select("search", "weight", F.inline("cands"))
        .withColumn("rank", F.row_number().over(ranking))
        .filter(F.col("rank") <= limit)
        .join(searches.select("search", "search_id"), "search")
        .select("search_id", "cand_id", "weight", "rank")
    )


def _in_whole(meet, floored: DataFrame, index: Index) -> DataFrame:
    """Entries met at the words that can reach the floor, the most frequent word by its short list."""
    asked = _words(floored.withColumn("n", F.size("codes")), "search", "floor", "n")
    at_end = F.col("at") == F.col("n") - 1
    return meet(asked.filter(~at_end), _postings(index.entries)).unionByName(meet(asked.filter(at_end), index.heads))


def answer_ways(searches: DataFrame, index: Index, limit: int = fv.SEARCH_LIMIT, listed: bool = False) -> DataFrame:
    """Answers of written ``searches`` (codes, lacks, search) to all queries of each at once, every entry at
    the first query that returns it: (search, cand_id, query_no, rank).

    The queries of a track share nearly all their words, so entries are met once and weighed for each.
    By a packed index they may be left ``listed`` as ``answers`` beside the other columns of a search.
    """
    if index.packed:
        lists = packed.answers(searches, index.packed, limit, max(HEAD, limit), QUERIES, "first")
        return lists if listed else lists.select("search", F.inline("answers")).select("search", "cand_id", "query_no", "rank")
    floored = materialise(_floored_ways(searches, index, limit))
    ways = [
        F.when(F.col(f"weights.w{n}") >= F.col(f"floors.f{n}"), F.struct(F.lit(n).alias("query_no"), F.col(f"weights.w{n}").alias("weight")))
        for n in range(QUERIES)
    ]
    ranking = Window.partitionBy("search", "query_no").orderBy(F.desc("weight"), "unpopular", "cand_id")
    return (
        _weights(_in_whole(_meetings, floored, index), floored)
        .select("search", "entry", F.explode(F.array(*ways)).alias("way"))
        .filter("way is not null")
        .join(index.entries.select("entry", "cands"), "entry")
        .select("search", "way.query_no", "way.weight", F.inline("cands"))
        .withColumn("rank", F.row_number().over(ranking))
        .filter(F.col("rank") <= limit)
        # an id that the catalog holds several times answers as often
        .withColumn("_first", F.min("query_no").over(Window.partitionBy("search", "cand_id")))
        .filter(F.col("query_no") == F.col("_first"))
        .select("search", "cand_id", "query_no", "rank")
    )


def told_apart(searches: DataFrame) -> DataFrame:
    """Distinct ``searches`` (search_id, codes) written with ``search``, a shorter number of each."""
    return materialise(searches.withColumn("search", F.monotonically_increasing_id()))


def distinct_searches(words: DataFrame) -> DataFrame:
    return told_apart(words.groupBy("search_id").agg(F.any_value("codes").alias("codes")))


def search(tracks: DataFrame, catalog: DataFrame, limit: int = fv.SEARCH_LIMIT, index: Index | None = None) -> DataFrame:
    """Ranked answers to the queries of each track: (key, query_no, cand_id, weight, rank).

    ``index`` is what ``build_index`` gave for this catalog, where it is used often.
    """
    return search_by(["key"], tracks, catalog, limit, index)


def search_by(
    told: list[str], tracks: DataFrame, catalog: DataFrame, limit: int = fv.SEARCH_LIMIT, index: Index | None = None
) -> DataFrame:
    """``search`` with the columns ``told`` of a track, ``key`` or ``track``."""
    index = index or build_index(catalog, limit)
    if index.packed:
        lists = answer_lists(tracks, index, limit, "all", *[c for c in told if c != "track"])
        return lists.select(*told, F.inline("answers")).select(*told, "query_no", "cand_id", "weight", "rank")
    words = known_words(tracks, index)
    answers = answer(distinct_searches(words), index, limit)
    return (
        words.select(*told, "query_no", "search_id")
        .join(answers, "search_id")
        .select(*told, "query_no", "cand_id", "weight", "rank")
    )
