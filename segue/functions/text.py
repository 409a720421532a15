"""Name normalisation as Column expressions.

Everything stays in the JVM.  Spark has no Unicode decomposition, so ``norm``
folds characters with ``translate`` and a table derived from ``unicodedata``;
only strings holding a character that table cannot express (one that decomposes
into several, or lies outside the covered blocks) are normalised by an Arrow UDF,
and all other rows hand that UDF a null.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- folding
# Blocks folded natively: Latin with its extensions, combining marks, Greek,
# Cyrillic, Latin additional, general punctuation.
_NATIVE_BLOCKS = [(0x0001, 0x0530), (0x1E00, 0x1F00), (0x2010, 0x2030)]
# Lower-casing of sigma depends on its neighbours; leave it to the exact path.
_NOT_NATIVE = {"Σ", "σ", "ς"}


def _native_table() -> tuple[str, str, list[tuple[int, int]]]:
    """(characters to map, their images, code point ranges the table can express)."""
    mapped, images, dropped, ranges = [], [], [], []
    for lo, hi in _NATIVE_BLOCKS:
        for ch in map(chr, range(lo, hi)):
            base = [d for d in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(d)]
            if len(base) > 1 or ch in _NOT_NATIVE:
                continue
            if ranges and ranges[-1][1] == ord(ch) - 1:
                ranges[-1] = (ranges[-1][0], ord(ch))
            else:
                ranges.append((ord(ch), ord(ch)))
            if not base:
                dropped.append(ch)
            elif base[0] != ch or ch == "’":
                mapped.append(ch)
                images.append("'" if ch == "’" else base[0])
    # translate() deletes source characters that have no image
    return "".join(mapped + dropped), "".join(images), ranges


_FROM, _TO, _NATIVE_RANGES = _native_table()
# tested as "not ASCII, and outside the ranges": most characters leave at the first test
_NEEDS_EXACT = (
    r"[\x{80}-\x{10ffff}&&[^"
    + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in _NATIVE_RANGES)
    + "]]"
)
_NOT_ASCII = r"[^\x00-\x7f]"
_MARKS = {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


@F.pandas_udf(T.StringType())
def _norm_exact(s: pd.Series) -> pd.Series:
    out = s.copy()
    held = s.notna()
    if held.any():
        folded = s[held].str.normalize("NFKD").str.translate(_MARKS).str.lower()
        spelt = folded.str.replace("&", "and").str.replace("’", "'")
        out[held] = spelt.str.replace(r"[^\w']+", " ", regex=True).str.strip()
    return out


def needs_exact(c) -> Column:
    """Does a name hold a character that the native form cannot express?"""
    c = as_column(c)
    return c.rlike(_NOT_ASCII) & c.rlike(_NEEDS_EXACT)


def norm_exact(c) -> Column:
    """``norm`` of any name, by Python; for the few that need it."""
    return _norm_exact(as_column(c))


def norm(c) -> Column:
    """Comparable form of a name: compatibility decomposition without combining marks,
    lower case, words and apostrophes only, single blanks."""
    c = as_column(c)
    return F.coalesce(norm_native(c), _norm_exact(F.when(needs_exact(c), c)))


def norm_native(c) -> Column:
    """``norm`` without Python; null for names that need more."""
    c = as_column(c)
    ascii_only = ~c.rlike(_NOT_ASCII)
    folded = F.when(ascii_only, c).when(~needs_exact(c), F.translate(c, _FROM, _TO))
    s = F.replace(F.lower(folded), F.lit("&"), F.lit("and"))
    # one pass: whatever is no word character or apostrophe becomes a single blank
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}_']+", " "))


def strip(c) -> Column:
    """Trim every kind of white space, not only the blank."""
    c = as_column(c)
    # most names have none at their ends, which two characters tell
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")).otherwise(c)


# --------------------------------------------------------------------------- titles
def _escape(chars: str) -> str:
    return "".join("\\" + ch if ch in "()[]-&/" else ch for ch in chars)


# A trailing run of junk segments in one pass.  A segment reaches up to the next
# closing bracket, so the run can be read without backtracking: closed segments,
# then possibly one that stays open until the end.
_SEGMENT = (
    rf"\s*[{_escape(fv.TITLE_OPENERS)}]\s*(?:{'|'.join(fv.TITLE_JUNK_WORDS)})"
    rf"[^{_escape(fv.TITLE_CLOSERS)}]*+"
)
_TITLE_TAIL = (
    rf"(?iU)(?:{_SEGMENT}[{_escape(fv.TITLE_CLOSERS)}])*(?:{_SEGMENT})?\s*\z"
)


def clean_title(c) -> Column:
    """Title without trailing edition, version or guest segments."""
    c = as_column(c)
    # the pattern is tried at every character, and most titles hold no opener
    opened = reduce(or_, [c.contains(ch) for ch in fv.TITLE_OPENERS])
    return F.when(opened, strip(F.regexp_replace(c, _TITLE_TAIL, ""))).otherwise(strip(c))


# --------------------------------------------------------------------------- artists
_GUESTS = rf"(?idU)\s+(?:{'|'.join(fv.GUEST_WORDS)})\s+.*$"
_SEPARATOR = (
    rf"(?U)\s*[{_escape(fv.ARTIST_SEPARATORS)}]\s*|\s+{fv.ARTIST_SEPARATOR_WORD}\s+"
)


def clean_artist(c) -> Column:
    """First artist of a credit, guests removed."""
    lead = F.regexp_replace(as_column(c), _GUESTS, "")
    first = strip(F.split(lead, _SEPARATOR, 2)[0])
    return F.coalesce(F.nullif(first, F.lit("")), lead)


def primary_artist(artists) -> Column:
    return F.coalesce(F.get(as_column(artists), F.lit(0)), F.lit(""))


def joined_artists(artists) -> Column:
    return F.array_join(as_column(artists), " ")


# --------------------------------------------------------------------------- keys
def identity_key(isrc, n_clean_artist, n_clean_title) -> Column:
    """Code key where a code exists, else the normalised artist and title."""
    isrc = F.nullif(as_column(isrc), F.lit(""))
    return F.when(
        isrc.isNotNull(), F.concat(F.lit(fv.CODE_KEY_PREFIX), F.upper(isrc))
    ).otherwise(
        F.concat(
            F.lit(fv.NAME_KEY_PREFIX), as_column(n_clean_artist), F.lit("|"), as_column(n_clean_title)
        )
    )


def year_prefix(c) -> Column:
    """Leading four characters as a year, null when they are no digits."""
    # fewer than four digits count when they are all there is
    head = F.left(as_column(c).cast("string"), F.lit(4))
    return F.when(head.rlike(r"^\p{Nd}+\z"), head.try_cast("int"))


def words(c) -> Column:
    """Distinct words of an already normalised string."""
    return F.array_distinct(F.filter(F.split(as_column(c), " "), lambda w: w != ""))
