"""Token-set similarity and the score of a track against a catalog entry.

The similarity runs as one Arrow UDF over candidate pairs.  Inside a batch the
distinct pairs are compared once, and their longest common subsequences are found
together with bit-parallel updates (Crochemore et al. 2001, Hyyrö 2004): one
machine word per pair, one numpy step per character position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv
from .text import as_column

_WORD = 63  # bits used of a 64-bit word
_VECTOR_MIN = 16  # pairs of similar length worth a numpy pass
_TABLE_CELLS = 4_000_000  # bound of the per-pass mask table


def _lcs_scalar(a: str, b: str) -> int:
    """Common subsequence length for strings of any length (big integers)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rest = full
    for ch in b:
        hit = rest & masks.get(ch, 0)
        if hit:
            rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, lengths


def _lcs_vector(short: list[str], long: list[str]) -> np.ndarray:
    """Common subsequence lengths; every ``short`` fits one word."""
    n = len(short)
    flat_a, len_a = _codes(short)
    flat_b, len_b = _codes(long)
    place_of = np.zeros(int(max(flat_a.max(initial=0), flat_b.max(initial=0))) + 1, dtype=np.int32)
    place_of[flat_a] = 1
    alphabet = np.flatnonzero(place_of)
    place_of[:] = len(alphabet)
    place_of[alphabet] = np.arange(len(alphabet))
    coded_a, coded_b = place_of[flat_a], place_of[flat_b]

    width = len(alphabet) + 1  # last column: characters no short string has
    masks = np.zeros((n, width), dtype=np.uint64)
    owner = np.repeat(np.arange(n), len_a)
    place = np.arange(len(flat_a)) - np.repeat(np.cumsum(len_a) - len_a, len_a)
    np.bitwise_or.at(masks, (owner, coded_a), np.uint64(1) << place.astype(np.uint64))

    # longest first, so the pairs still running are always a leading slice
    order = np.argsort(-len_b, kind="stable")
    start = (np.cumsum(len_b) - len_b)[order]
    masks = masks[order]
    full = (np.uint64(1) << len_a[order].astype(np.uint64)) - np.uint64(1)
    rest = full.copy()
    running = np.searchsorted(-len_b[order], -np.arange(1, int(len_b.max(initial=0)) + 1), "right")
    rows = np.arange(n)
    for step, live in enumerate(running):
        r = rest[:live]
        hit = r & masks[rows[:live], coded_b[start[:live] + step]]
        rest[:live] = ((r + hit) | (r - hit)) & full[:live]
    out = np.empty(n, dtype=np.int64)
    out[order] = len_a[order] - np.bitwise_count(rest).astype(np.int64)
    return out


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Longest common subsequence length of each pair of strings."""
    out = np.zeros(len(left), dtype=np.int64)
    by_size: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(left, right)):
        if a and b:
            lo, hi = min(len(a), len(b)), max(len(a), len(b))
            by_size.setdefault(hi.bit_length() if lo <= _WORD else -1, []).append(i)
    for size, members in by_size.items():
        pairs = [
            (left[i], right[i]) if len(left[i]) <= len(right[i]) else (right[i], left[i])
            for i in members
        ]
        if size < 0 or len(members) < _VECTOR_MIN:
            out[members] = [_lcs_scalar(a, b) for a, b in pairs]
            continue
        alphabet = len(set().union(*(a for a, _ in pairs))) + 1
        chunk = max(_VECTOR_MIN, _TABLE_CELLS // alphabet)
        for lo in range(0, len(pairs), chunk):
            part = pairs[lo : lo + chunk]
            out[members[lo : lo + chunk]] = _lcs_vector([a for a, _ in part], [b for _, b in part])
    return out


def token_set_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity 0..100 of the word sets of each pair.

    0 when a side has no word; 100 when one word set contains the other; else the
    best of comparing the differences and comparing each side with the common part.
    """
    n = len(left)
    score = np.zeros(n)
    seen: dict[str, tuple[frozenset, list[str], int]] = {}

    def words(s: str) -> tuple[frozenset, list[str], int]:
        if s not in seen:
            held = frozenset(s.split())
            seen[s] = held, sorted(held), sum(map(len, held))
        return seen[s]

    todo, shared, sizes = [], [], []
    for i, (a, b) in enumerate(zip(left, right)):
        (wa, _, size_a), (wb, _, size_b) = words(a), words(b)
        if not wa or not wb:
            continue
        both = wa & wb
        k = len(both)
        if k and (k == len(wa) or k == len(wb)):
            score[i] = 100.0
            continue
        size = sum(map(len, both))
        todo.append(i)
        shared.append(both)
        # lengths of the common words and of each side's others, joined by blanks
        sizes.append((size + max(k - 1, 0), size_a - size + len(wa) - k - 1, size_b - size + len(wb) - k - 1))
    if todo:
        s, la, lb = np.array(sizes, dtype=np.float64).T
        gap = (s > 0).astype(np.float64)
        full_a, full_b = s + gap + la, s + gap + lb
        with_a = 100.0 * (1.0 - (gap + la) / (s + full_a))
        with_b = 100.0 * (1.0 - (gap + lb) / (s + full_b))
        best = np.where(s > 0, np.maximum(with_a, with_b), -1.0)

        def apart(common: np.ndarray, at) -> np.ndarray:
            return 100.0 * (1.0 - (la[at] + lb[at] - 2.0 * common) / (full_a[at] + full_b[at]))

        # the others are compared only where their lengths let them decide
        open_ = np.flatnonzero(apart(np.minimum(la, lb), slice(None)) > best)

        def others(texts: list[str]) -> list[str]:
            return [" ".join([w for w in words(texts[todo[j]])[1] if w not in shared[j]]) for j in open_]

        best[open_] = np.maximum(best[open_], apart(lcs_lengths(others(left), others(right)), open_))
        score[todo] = best
    return score


@F.pandas_udf(T.DoubleType())
def _token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    # a batch often repeats a pair (few artists, few albums): compare it once
    at_a, of_a = pd.factorize(a.fillna("").to_numpy(dtype=object))
    at_b, of_b = pd.factorize(b.fillna("").to_numpy(dtype=object))
    pairs, group = np.unique(at_a * max(len(of_b), 1) + at_b, return_inverse=True)
    first_a, first_b = np.divmod(pairs, max(len(of_b), 1))
    ratios = token_set_ratios(of_a[first_a].tolist(), of_b[first_b].tolist())
    return pd.Series(ratios[group])


def token_set_ratio(a, b) -> Column:
    return _token_set_ratio(as_column(a), as_column(b))


# --------------------------------------------------------------------------- score
# Prepared columns a track and a catalog entry bring to the score.
TRACK_SIDE = ["t_title", "t_name", "t_artist", "t_lead", "t_album", "t_duration_ms"]
CATALOG_SIDE = ["c_title", "c_name", "c_artist", "c_lead", "c_album", "c_duration_s"]


def combined_score(title, artist, lead, album, same_name) -> Column:
    """Score of a pair from the similarities of its fields; durations are read from the row."""
    known = (F.coalesce("t_duration_ms", F.lit(0)) > 0) & (F.coalesce("c_duration_s", F.lit(0.0)) > 0)
    apart = F.abs(F.col("t_duration_ms") / 1000.0 - F.col("c_duration_s"))
    penalty = (
        F.when(known & (apart > fv.FAR_SECONDS), F.lit(fv.FAR_PENALTY))
        .when(known & (apart > fv.NEAR_SECONDS), F.lit(fv.NEAR_PENALTY))
        .otherwise(F.lit(0.0))
    )
    bonus = F.when(same_name, F.lit(fv.EXACT_TITLE_BONUS)).otherwise(0.0)
    return (
        fv.TITLE_WEIGHT * as_column(title)
        + fv.ARTIST_WEIGHT * F.greatest(as_column(artist), as_column(lead))
        + fv.ALBUM_WEIGHT * as_column(album)
        - penalty
        + bonus
    )


def with_score(pairs, name: str = "score"):
    """Add the score of each pair; ``pairs`` holds both sides' prepared columns."""
    rated = pairs.select(
        "*",
        token_set_ratio("t_title", "c_title").alias("_title"),
        token_set_ratio("t_artist", "c_artist").alias("_artist"),
        token_set_ratio("t_lead", "c_lead").alias("_lead"),
        token_set_ratio("t_album", "c_album").alias("_album"),
    )
    score = combined_score("_title", "_artist", "_lead", "_album", F.col("t_name") == F.col("c_name"))
    return rated.withColumn(name, score).drop("_title", "_artist", "_lead", "_album")
