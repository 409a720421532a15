import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from segue.functions import fixed_values as fv
from segue.functions import text


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", fn("s").alias("o")).collect()
    return [o for _, o in sorted((r.i, r.o) for r in rows)]


def test_norm_cases(spark):
    cases = {
        "Beyoncé": "beyonce",
        "Tom & Jerry": "tom and jerry",
        "R&B": "randb",
        "Don’t  Stop!": "don't stop",
        "snake_case": "snake_case",
        "ﬁn ½": "fin 1 2",  # decompose into several characters
        "한": "".join(unicodedata.normalize("NFKD", "한")),
        "日本 語": "日本 語",
        "  -- ": "",
        "Straße": "straße",
        "กำ": "กา",
    }
    # a mark of combining class 0 stays a character of its own and becomes a blank
    expected = dict(cases)
    expected["กำ"] = re.sub(r"\s+", " ", re.sub(r"[^\w\s']", " ", unicodedata.normalize("NFKD", "กำ"))).strip()
    assert apply(spark, text.norm, list(cases)) == list(expected.values())


def test_norm_against_unicode_rule(spark):
    rng = random.Random(5)
    pool = "aZé’&'_-. ß̈ñŁøİΣσǅﬀ①ｱ가々 —٣½Ⅳ" + "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300))
    pool = "".join(c for c in pool if unicodedata.category(c) != "Cn")
    values = ["".join(rng.choice(pool) for _ in range(12)) for _ in range(300)]

    def rule(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.combining(c) == 0)
        s = s.lower().replace("&", "and").replace("’", "'")
        return " ".join(re.sub(r"[^\w']", " ", s).split())

    got = apply(spark, text.norm, values)
    assert [(v, g) for v, g in zip(values, got) if g != rule(v)] == []
    assert apply(spark, text.norm, got) == got


TITLES = {
    "Song (feat. X)": "Song",
    "Song - 2011 Remaster": "Song",
    "Song (Live) [Remix]": "Song",
    "Song (Live) - Radio Edit": "Song",
    "Alive": "Alive",
    "Song (Part 2)": "Song (Part 2)",
    "Semi-live set": "Semi",
    "(Live)": "",
    "Song (live) end": "Song (live) end",
    "Song – remastered 1999  ": "Song",
    "Song (deluxe": "Song",
}


def test_clean_title_cases(spark):
    assert apply(spark, text.clean_title, list(TITLES)) == list(TITLES.values())


def test_clean_title_is_the_fixpoint_of_single_cuts(spark):
    cut = re.compile(
        r"\s*[\(\[\-–—]\s*(" + "|".join(fv.TITLE_JUNK_WORDS) + r")[^\)\]]*[\)\]]?\s*$", re.IGNORECASE
    )

    def fixpoint(s):
        while (shorter := cut.sub("", s)) != s:
            s = shorter
        return s.strip()

    rng = random.Random(3)
    parts = ["Song", " ", "(", ")", "[", "]", "-", "–", "live", "Remix", "feat.", "2011 remaster", "x", "edit", "mono "]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    values.append("a" + " - live" * 40 + ") b")  # would be exponential with a naive repetition
    got = apply(spark, text.clean_title, values)
    assert [(v, g) for v, g in zip(values, got) if g != fixpoint(v)] == []


@pytest.mark.parametrize(
    "artist,lead",
    [
        ("A feat. B", "A"), ("AC/DC", "AC"), ("Tyler, The Creator", "Tyler"), ("A x B", "A"), ("A X B", "A X B"),
        ("A (feat. B)", "A (feat. B)"), (", B", ", B"), ("A & B", "A"), ("Malcolm x", "Malcolm x"), ("", ""),
    ],
)
def test_clean_artist(spark, artist, lead):
    assert apply(spark, text.clean_artist, [artist]) == [lead]


def test_year_and_key(spark):
    assert apply(spark, text.year_prefix, ["1999", "1999-05", "", None, "c. 19", "99"]) == [1999, 1999, None, None, None, 99]
    df = spark.createDataFrame([("usx1", "a", "b"), ("", "a", "b"), (None, "a", "b")], "isrc string, l string, t string")
    keys = [r[0] for r in df.select(text.identity_key("isrc", "l", "t")).collect()]
    assert keys == ["isrc:USX1", "q:a|b", "q:a|b"]
    empty = spark.createDataFrame([([],), (["x", "y"],)], "a array<string>")
    assert [tuple(r) for r in empty.select(text.primary_artist("a"), text.joined_artists("a")).collect()] == [("", ""), ("x", "x y")]
    assert empty.select(F.lit(1)).count() == 2


def test_apostrophes_are_folded_with_the_accents(spark):
    assert text._TO[text._FROM.index("’")] == "'"
    assert apply(spark, text.norm, ["L’été", "don’t & ʼn’", "’’", "日’本"]) == ["l'été".replace("é", "e"), "don't and ʼn'", "''", "日'本"]


def test_titles_without_an_opener_meet_no_pattern(spark):
    df = spark.createDataFrame([("  plain  ",), ("Song live",), (None,), ("",), (" Song (live) ",), (" ",)], "s string")
    cleaned = df.select(text.clean_title("s").alias("o"))
    assert "Contains(s" in cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert [r.o for r in cleaned.collect()] == ["plain", "Song live", None, "", "Song", ""]
