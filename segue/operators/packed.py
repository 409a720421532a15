"""The catalog as arrays beside every worker, so that nothing a search meets is moved.

An index and the texts of entries are written to a file that each executor gets once and maps
into memory, shared by its workers.  Tracks are then searched and scored where they lie: words
are looked up, entries met, weighed and compared batch by batch, and only answers leave.  The rules
are those of ``search`` (``answer``, ``answer_ways``), which goes by shuffles and serves catalogs
beyond ``ENTRIES`` or ``POSTINGS``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.similarity import CATALOG_SIDE, TRACK_SIDE, token_set_ratios
from ..session import ship_package

#: Entries and words of entries up to which a catalog is packed; the driver builds the file.
ENTRIES = 1_000_000
POSTINGS = 30_000_000
#: Rows that are met or compared at once.
ROWS = 100_000


# --------------------------------------------------------------------------- files
def _ship(df: DataFrame, columns: dict[str, pa.Array]) -> str:
    """Name of a file with these columns, each as one list, that every executor gets."""
    path = os.path.join(tempfile.mkdtemp(prefix="segue-packed-"), f"{uuid.uuid4().hex}.arrow")
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, names=list(columns))
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)
    spark = df.sparkSession
    spark.sparkContext.addFile(path)
    ship_package(spark)
    return os.path.basename(path)


@lru_cache(maxsize=4)
def _opened(name: str) -> dict[str, pa.Array]:
    batch = pa.ipc.open_file(pa.memory_map(SparkFiles.get(name))).get_batch(0)
    return {n: batch.column(i).values for i, n in enumerate(batch.schema.names)}


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _one(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks)


# --------------------------------------------------------------------------- index
class Packed(NamedTuple):
    """A shipped index: arrays of words by code, entries by their best candidate."""

    name: str
    ids: T.DataType  #: type of candidate ids


def packed_index(entries: DataFrame, terms: DataFrame, number_bits: int, scale: int) -> Packed:
    """``entries`` (codes, cands) and ``terms`` (term, code) of an index as a shipped file."""
    words = terms.select("term", "code").toArrow()
    codes = _one(words["code"]).to_numpy()
    by_code = np.argsort(codes, kind="stable")
    codes = codes[by_code]
    held = entries.select("codes", F.col("cands")["unpopular"].alias("unpopular"), F.col("cands")["cand_id"].alias("cand_id")).toArrow()
    of_entry, unpopular, ids = (_one(held[c]) for c in ("codes", "unpopular", "cand_id"))
    n = len(of_entry)
    cands = np.asarray(pc.list_value_length(ids).to_numpy(zero_copy_only=False), np.int64)
    # candidates by popularity, then id; entries by their best one
    table = pa.table({"unpopular": unpopular.flatten(), "cand_id": ids.flatten()})
    order = pc.sort_indices(table, sort_keys=[("unpopular", "ascending"), ("cand_id", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.minimum.reduceat(place, _starts(cands)[:-1]) if n else place
    by_best = np.argsort(first, kind="stable")
    lengths = np.asarray(pc.list_value_length(of_entry).to_numpy(zero_copy_only=False), np.int64)
    at = _spread(_starts(lengths)[:-1][by_best], lengths[by_best])
    entry_terms = np.searchsorted(codes, of_entry.flatten().to_numpy()[at]).astype(np.int32)
    lengths = lengths[by_best]
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    postings = owner[np.argsort(entry_terms, kind="stable")]
    at = _spread(_starts(cands)[:-1][by_best], cands[by_best])
    cand_of = place[at]
    cand_ids = table["cand_id"].take(pa.array(order)).combine_chunks()
    group = cand_ids.dictionary_encode(null_encoding="encode").indices if len(cand_ids) else pa.array([], pa.int32())
    df = codes >> number_bits
    name = _ship(
        entries,
        {
            "words": _one(words["term"]).take(pa.array(by_code)),
            "codes": pa.array(codes),
            "weights": pa.array((scale // np.maximum(df, 1)).astype(np.float64)),
            "entry_starts": pa.array(_starts(lengths)),
            "entry_terms": pa.array(entry_terms),
            "posting_starts": pa.array(_starts(np.bincount(entry_terms, minlength=len(codes)))),
            "postings": pa.array(postings),
            "cand_starts": pa.array(_starts(cands[by_best])),
            "cands": pa.array(cand_of),
            "cand_ids": _one(pa.chunked_array([cand_ids]) if isinstance(cand_ids, pa.Array) else cand_ids),
            "groups": pa.array(np.asarray(group, np.int64)),
        },
    )
    return Packed(name, entries.schema["cands"].dataType.elementType["cand_id"].dataType)


class _Arrays:
    """The arrays of a shipped index."""

    def __init__(self, name: str):
        held = _opened(name)
        self.words, self.cand_ids = held["words"], held["cand_ids"]
        for field in ("codes", "weights", "entry_starts", "entry_terms", "posting_starts", "postings", "cand_starts", "cands", "groups"):
            setattr(self, field, held[field].to_numpy())
        self.df = np.diff(self.posting_starts)

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Place of each word, rare ones first; -1 for unknown ones."""
        if not len(self.words) or not len(words):
            return np.full(len(words), -1, np.int64)
        told = words.dictionary_encode()
        places = pc.fill_null(pc.index_in(told.dictionary, value_set=self.words), -1).to_numpy()
        return places[told.indices.to_numpy()].astype(np.int64)


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists, a null counting as empty, and what they hold."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.asarray(lengths, np.int64), column.flatten()


class _Searches(NamedTuple):
    """Searches of a batch: their words, rare ones first, with a bit for each query that lacks it."""

    starts: np.ndarray
    terms: np.ndarray
    lack: np.ndarray
    asked: np.ndarray  #: search, query: is it asked?

    def some(self, first: int, end: int) -> "_Searches":
        a, b = self.starts[first], self.starts[end]
        return _Searches(self.starts[first : end + 1] - a, self.terms[a:b], self.lack[a:b], self.asked[first:end])


def _bits(keys: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    """For each of the sorted ``keys`` a bit for every query that is told of it."""
    lack = np.zeros(len(keys), np.uint8)
    if len(keys) and len(at):
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        hit = keys[place] == at
        np.bitwise_or.at(lack, place[hit], (1 << query[hit]).astype(np.uint8))
    return lack


# --------------------------------------------------------------------------- known words
def known(tracks: DataFrame, index: Packed, beside: list[str], queries: int, every: bool) -> DataFrame:
    """(track, *beside, codes, lacks) of tracks (track, terms, missing): as ``search.known_ways``.

    With ``every``, a query is told even if it knows the same words as an earlier one.
    """
    name = index.name
    told = tracks.select("track", *beside, "terms", "missing")
    schema = T.StructType(
        [*tracks.select("track", *beside).schema, T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("lacks", T.ArrayType(T.ArrayType(T.LongType())))]
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(name)
        many = max(len(arrays.codes), 1)
        for batch in rows:
            n = batch.num_rows
            lengths, words = _listed(batch.column("terms"))
            term = arrays.of_words(words)
            keys = np.sort((np.repeat(np.arange(n), lengths) * many + term)[term >= 0])
            asked, inner = _listed(batch.column("missing"))
            lengths, words = _listed(inner)
            term = arrays.of_words(words)
            number = np.arange(len(inner)) - np.repeat(_starts(asked)[:-1], asked)
            of_row, of_query = np.repeat(np.repeat(np.arange(n), asked), lengths), np.repeat(number, lengths)
            fits = term >= 0
            lack = _bits(keys, of_row[fits] * many + term[fits], of_query[fits])
            row, term = np.divmod(keys, many)
            sizes = np.bincount(row, minlength=n)
            bits = (lack[:, None] >> np.arange(queries)) & 1
            valid = np.zeros((n, queries), bool)
            lacking = np.zeros((n, queries), np.int64)
            for q in range(queries):
                lacking[:, q] = np.bincount(row[bits[:, q] == 1], minlength=n)
                valid[:, q] = (asked > q) & (lacking[:, q] < sizes)
                for before in range(0 if every else q):
                    valid[:, q] &= np.bincount(row[bits[:, q] != bits[:, before]], minlength=n) > 0
            codes = pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), pa.array(arrays.codes[term]))
            # rows of (track, query): one for each query of the track
            exists = np.arange(queries)[None, :] < asked[:, None]
            lengths = np.where(valid, lacking, 0)[exists]
            at, query = np.nonzero(bits & valid[row])
            order = np.lexsort((term[at], query, row[at]))
            inner = pa.ListArray.from_arrays(
                pa.array(_starts(lengths), pa.int32()), pa.array(arrays.codes[term[at[order]]]), mask=pa.array(~valid[exists])
            )
            lacks = pa.ListArray.from_arrays(pa.array(_starts(exists.sum(1)), pa.int32()), inner)
            out = [batch.column(c) for c in ("track", *beside)] + [codes, lacks]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return told.mapInArrow(batches, schema)


# --------------------------------------------------------------------------- answers
def _weigh(arrays: _Arrays, s: _Searches, search: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact weight of each pair for each query: all words that they share."""
    many = len(arrays.codes)
    queries = s.asked.shape[1]
    owner = np.repeat(np.arange(len(s.starts) - 1), np.diff(s.starts))
    keys = owner * many + s.terms
    out = np.empty((len(search), queries))
    for first in range(0, len(search), ROWS):
        of_search, of_entry = search[first : first + ROWS], entry[first : first + ROWS]
        lengths = arrays.entry_starts[of_entry + 1] - arrays.entry_starts[of_entry]
        pair = np.repeat(np.arange(len(of_entry)), lengths)
        at = of_search[pair] * many + arrays.entry_terms[_spread(arrays.entry_starts[of_entry], lengths)]
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == at)
        pair, place = pair[hit], place[hit]
        weight = arrays.weights[s.terms[place]]
        for q in range(queries):
            lacked = (s.lack[place] >> q) & 1
            out[first : first + ROWS, q] = np.bincount(pair, np.where(lacked, 0.0, weight), len(of_entry))
    return out


def _meet(arrays: _Arrays, owner: np.ndarray, terms: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (search, entry) under words that are looked up: the first ``most`` entries of each."""
    lengths = np.minimum(arrays.df[terms], most)
    entry = arrays.postings[_spread(arrays.posting_starts[terms], lengths)]
    many = max(len(arrays.entry_starts) - 1, 1)
    return np.divmod(np.unique(np.repeat(owner, lengths) * many + entry), many)


def _floors(arrays: _Arrays, s: _Searches, owner: np.ndarray, limit: int, head: int) -> np.ndarray:
    """A weight that ``limit`` entries reach for each query of each search; 0 where unknown."""
    n, queries = s.asked.shape
    rows = np.minimum(arrays.df[s.terms], head)
    seeds = np.zeros(len(s.terms), bool)
    for q in range(queries):
        own = np.where((s.lack >> q) & 1, 0, rows)
        before = np.cumsum(own) - own
        before -= np.repeat(before[np.minimum(s.starts[:-1], max(len(own) - 1, 0))], np.diff(s.starts))
        seeds |= (own > 0) & (before < 2 * limit) & s.asked[owner, q]
    search, entry = _meet(arrays, owner[seeds], s.terms[seeds], np.full(int(seeds.sum()), head))
    weights = _weigh(arrays, s, search, entry)
    floors = np.zeros((n, queries))
    starts = np.searchsorted(search, np.arange(n + 1))
    enough = np.flatnonzero(np.diff(starts) >= limit)
    for q in range(queries):
        order = np.lexsort((-weights[:, q], search))
        floors[enough, q] = weights[order[starts[enough] + limit - 1], q]
    return floors


def _answers(arrays: _Arrays, s: _Searches, limit: int, head: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of (search, query, rank, candidate, weight) of the ``limit`` best of each query, in this order."""
    n, queries = s.asked.shape
    owner = np.repeat(np.arange(n), np.diff(s.starts))
    floors = _floors(arrays, s, owner, limit, head)
    weight = arrays.weights[s.terms]
    whole, short = np.zeros(len(s.terms), bool), np.zeros(len(s.terms), bool)
    for q in range(queries):
        own = ((s.lack >> q) & 1 == 0) & s.asked[owner, q]
        mine = np.where(own, weight, 0.0)
        # what this word and all more frequent ones weigh; sums of whole numbers are exact
        upto = np.concatenate([[0.0], np.cumsum(mine)])
        left = upto[s.starts[owner + 1]] - upto[:-1]
        needed = own & (left >= floors[owner, q])
        last = needed & (left == mine)
        short |= last
        whole |= needed & ~last
    taken = whole | short
    most = np.where(whole, len(arrays.entry_starts), head)
    rows = np.where(taken, np.minimum(arrays.df[s.terms], most), 0)
    upto = np.concatenate([[0], np.cumsum(rows)])[s.starts]
    first = 0
    while first < n:
        # at least one search, else as many as meet a bounded number of entries
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + ROWS, "right")) - 1)
        own = slice(s.starts[first], s.starts[end])
        used = taken[own]
        search, *rest = _ranked(arrays, s.some(first, end), floors[first:end], (owner[own] - first)[used], s.terms[own][used], most[own][used], limit)
        yield search + first, *rest
        first = end


def _ranked(
    arrays: _Arrays, s: _Searches, floors: np.ndarray, owner: np.ndarray, terms: np.ndarray, most: np.ndarray, limit: int
) -> tuple[np.ndarray, ...]:
    queries = s.asked.shape[1]
    search, entry = _meet(arrays, owner, terms, most)
    weights = _weigh(arrays, s, search, entry)
    fits = (weights > 0) & (weights >= floors[search]) & s.asked[search]
    pair, query = np.nonzero(fits)
    lengths = arrays.cand_starts[entry[pair] + 1] - arrays.cand_starts[entry[pair]]
    cand = arrays.cands[_spread(arrays.cand_starts[entry[pair]], lengths)]
    group = np.repeat(search[pair] * queries + query, lengths)
    weight = np.repeat(weights[pair, query], lengths)
    order = np.lexsort((cand, -weight, group))
    group, cand, weight = group[order], cand[order], weight[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group) + 1
    best = rank <= limit
    return *np.divmod(group[best], queries), rank[best], cand[best], weight[best]


#: Searches whose floors are found at once; each meets about fifty entries for that.
FLOORS = 1000


def _searches(arrays: _Arrays, batch: pa.RecordBatch, queries: int) -> _Searches:
    n, many = batch.num_rows, max(len(arrays.codes), 1)
    sizes, codes = _listed(batch.column("codes"))
    starts, terms = _starts(sizes), np.searchsorted(arrays.codes, codes.to_numpy())
    if "lacks" not in batch.schema.names:
        return _Searches(starts, terms, np.zeros(len(terms), np.uint8), np.ones((n, 1), bool))
    told, inner = _listed(batch.column("lacks"))
    row = np.repeat(np.arange(n), told)
    number = np.arange(len(inner)) - np.repeat(_starts(told)[:-1], told)
    asked = np.zeros((n, queries), bool)
    valid = inner.is_valid().to_numpy(zero_copy_only=False)
    asked[row[valid], number[valid]] = True
    lengths, codes = _listed(inner)
    at = np.repeat(row, lengths) * many + np.searchsorted(arrays.codes, codes.to_numpy())
    return _Searches(starts, terms, _bits(np.repeat(np.arange(n), sizes) * many + terms, at, np.repeat(number, lengths)), asked)


def _first(search: np.ndarray, group: np.ndarray, query: np.ndarray, once: bool) -> np.ndarray:
    """Which answers stay: those of the first query that returns the id; of these, with ``once``, one."""
    _, start, same = np.unique(search * (int(group.max(initial=0)) + 1) + group, return_index=True, return_inverse=True)
    # answers are in order of query and rank, so the first place is the one that stays
    if once:
        keep = np.zeros(len(search), bool)
        keep[start] = True
        return keep
    return query == query[start][same]


def answers(searches: DataFrame, index: Packed, limit: int, head: int, queries: int, stay: str) -> DataFrame:
    """``searches`` (codes, lacks, ...) without these, with ``answers``: (query_no, rank, weight, cand_id) in order.

    ``stay`` tells which answers do: "all"; those of the "first" query that returns an id; one of each id "once".
    Without ``lacks``, a search is one query.
    """
    name = index.name
    beside = [c for c in searches.columns if c not in ("codes", "lacks")]
    answer = T.StructType(
        [T.StructField("query_no", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("weight", T.LongType()), T.StructField("cand_id", index.ids)]
    )
    schema = T.StructType([*searches.select(*beside).schema, T.StructField("answers", T.ArrayType(answer))])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(name)
        for batch in rows:
            s = _searches(arrays, batch, queries)
            found = []
            for first in range(0, batch.num_rows, FLOORS):
                some = s.some(first, min(first + FLOORS, batch.num_rows))
                if len(some.terms):
                    found += [(search + first, *rest) for search, *rest in _answers(arrays, some, limit, head)]
            search, query, rank, cand, weight = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
            if stay != "all":
                keep = _first(search, arrays.groups[cand], query, stay == "once")
                search, query, rank, cand, weight = (c[keep] for c in (search, query, rank, cand, weight))
            told = pa.StructArray.from_arrays(
                [pa.array(query.astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(weight.astype(np.int64)), arrays.cand_ids.take(pa.array(cand))],
                names=["query_no", "rank", "weight", "cand_id"],
            )
            lists = pa.ListArray.from_arrays(pa.array(_starts(np.bincount(search, minlength=batch.num_rows)), pa.int32()), told)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in beside], lists], names=[*beside, "answers"])

    return searches.mapInArrow(batches, schema)


# --------------------------------------------------------------------------- scores
_COMPARED = {"title": ("t_title", "c_title"), "artist": ("t_artist", "c_artist"), "lead": ("t_lead", "c_lead"), "album": ("t_album", "c_album")}


def packed_texts(catalog: DataFrame) -> str:
    """The compared columns of a prepared catalog as a shipped file."""
    held = catalog.filter(F.col("cand_id").isNotNull()).select("cand_id", *CATALOG_SIDE).sort("cand_id").toArrow()
    return _ship(catalog, {c: _one(held[c]) for c in held.column_names})


class _Texts:
    """Texts of entries, in order of their id."""

    def __init__(self, name: str):
        held = _opened(name)
        self.ids = held["cand_id"].dictionary_encode()
        self.starts = _starts(np.bincount(self.ids.indices.to_numpy(), minlength=len(self.ids.dictionary)))
        self.names = held["c_name"]
        self.duration = pc.fill_null(held["c_duration_s"].cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        self.fields = {f: pc.fill_null(held[f], "").dictionary_encode() for _, f in _COMPARED.values()}


def _ratios(left: pa.DictionaryArray, right: pa.DictionaryArray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Similarity of each pair of texts; a repeated pair is compared once."""
    many = max(len(right.dictionary), 1)
    both, same = np.unique(left.indices.to_numpy()[row].astype(np.int64) * many + right.indices.to_numpy()[entry], return_inverse=True)
    a, b = np.divmod(both, many)
    return token_set_ratios(left.dictionary.take(pa.array(a)).to_pylist(), right.dictionary.take(pa.array(b)).to_pylist())[same]


def _scores(batch: pa.RecordBatch, texts: _Texts, sides: dict, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """``similarity.combined_score`` of rows of the batch beside entries."""
    title, artist, lead, album = (_ratios(sides[a], texts.fields[b], row, entry) for a, b in _COMPARED.values())
    long, apart = sides["t_duration_ms"][row], texts.duration[entry]
    off = np.abs(long / 1000.0 - apart)
    penalty = np.where(off > fv.FAR_SECONDS, fv.FAR_PENALTY, np.where(off > fv.NEAR_SECONDS, fv.NEAR_PENALTY, 0.0))
    penalty = np.where((long > 0) & (apart > 0), penalty, 0.0)
    named = pc.fill_null(pc.equal(batch.column("t_name").take(pa.array(row)), texts.names.take(pa.array(entry))), False).to_numpy(zero_copy_only=False)
    return (
        fv.TITLE_WEIGHT * title + fv.ARTIST_WEIGHT * np.maximum(artist, lead) + fv.ALBUM_WEIGHT * album - penalty + np.where(named, fv.EXACT_TITLE_BONUS, 0.0)
    )


def staged(answered: DataFrame, texts: str, good_enough: float) -> DataFrame:
    """Tracks with their ``answers`` and texts; without these, with ``pairs``: (cand_id, query_no, rank, score).

    The answers to a further query are scored only for tracks without a score of ``good_enough`` so far.
    """
    beside = [c for c in answered.columns if c not in ("answers", *TRACK_SIDE)]
    ids = answered.schema["answers"].dataType.elementType["cand_id"].dataType
    pair = T.StructType(
        [T.StructField("cand_id", ids), T.StructField("query_no", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    schema = T.StructType([*answered.select(*beside).schema, T.StructField("pairs", T.ArrayType(pair))])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Texts(texts)
        for batch in rows:
            lengths, told = _listed(batch.column("answers"))
            found = pc.fill_null(pc.index_in(told.field("cand_id"), value_set=held.ids.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            # an id that the catalog lists several times has as many texts
            times = np.where(found >= 0, held.starts[found + 1] - held.starts[found], 0)
            at = np.repeat(np.arange(len(row)), times)
            entry = _spread(held.starts[np.maximum(found, 0)], times)
            row, query = row[at], told.field("query_no").to_numpy()[at]
            sides = {a: pc.fill_null(batch.column(a), "").dictionary_encode() for a, _ in _COMPARED.values()}
            sides["t_duration_ms"] = pc.fill_null(batch.column("t_duration_ms").cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            settled = np.zeros(batch.num_rows, bool)
            stages = []
            scores = np.empty(len(row))
            for number in np.unique(query):
                asked = np.flatnonzero((query == number) & ~settled[row])
                for first in range(0, len(asked), ROWS):
                    part = asked[first : first + ROWS]
                    scores[part] = _scores(batch, held, sides, row[part], entry[part])
                settled[row[asked[scores[asked] >= good_enough]]] = True
                stages.append(asked)
            done = np.concatenate(stages) if stages else np.zeros(0, np.int64)
            done = done[np.argsort(row[done], kind="stable")]
            of_answer = pa.array(at[done])
            told = pa.StructArray.from_arrays([*[told.field(c).take(of_answer) for c in ("cand_id", "query_no", "rank")], pa.array(scores[done])], names=pair.names)
            lists = pa.ListArray.from_arrays(pa.array(_starts(np.bincount(row[done], minlength=batch.num_rows)), pa.int32()), told)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in beside], lists], names=schema.names)

    return answered.mapInArrow(batches, schema)
