r"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base measures of every text come first.  The remaining rules form a conjunction, so
their order changes the cost and never the verdict: each rule's time and rejection share
are measured on a sample, and the rule that rejects most per second is asked first.  A
``CASE`` evaluates a later rule only for texts that passed those before it.

Words are runs of ``[^\x20\x09-\x0D]``.  Defined results: a null or empty text has no
words and fails the base; a null doc_id is kept as it is; repeated rows are judged one by
one; an empty table gives no rows.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Texts the order is estimated on.
SAMPLE_ROWS = 2000


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def repeat_words(found: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in their text.

    Windows are compared by 64-bit hashes within one text.  Only texts with an equal pair
    sort their windows.
    """

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - WINDOW
        return F.when(
            last > 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def is_repeated(pairs: Column) -> Column:
            return F.filter(
                pairs,
                lambda p, k: (p["h"] == F.get(pairs, k + 1)["h"]) | ((k > 0) & (p["h"] == F.get(pairs, k - 1)["h"])),
            )

        def spread(starts: Column) -> Column:
            return F.aggregate(
                F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("bigint"),
                lambda total, n: total + n,
            )

        return let(placed, lambda pairs: let(F.sort_array(F.transform(is_repeated(pairs), lambda p: p["i"])), spread))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0).cast("bigint"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: let(windows(h), of))


def base_measures(docs: DataFrame) -> DataFrame:
    """The documents with their base measures and ``base_failed``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return (
        docs.withColumn("_words", words(text))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn("n_repeat_words", repeat_words(F.col("_words")))
        .drop("_words")
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def _count(pattern: str) -> Column:
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def default_rules() -> dict[str, Column]:
    """Rejecting conditions on ``text`` by name."""
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return {
        # marks of markup, prices and tables: more than one for every four words
        "symbols": 4 * _count(r"[#*$%&|<>]") > n_words,
        # shouting: most ASCII letters are capitals
        "capitals": 2 * _count(r"[A-Z]") > _count(r"[A-Za-z]"),
        # calls: exclamation marks after one word in five
        "exclamations": 5 * F.regexp_count("text", F.lit("!+")) > n_words,
        # hardly any letters
        "letters": 2 * _count(r"\p{L}") < _count(r"[^\x20\x09-\x0D]"),
        # stuttering: one word in four is the one before it again
        "stutter": let(words(F.col("text")), lambda w: 4 * F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))) > F.size(w)),
        # most lines said before
        "lines": let(lines, lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x)),
    }


def cascade_order(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, most rejections per second first, as measured on a sample of the rows.

    The sample is drawn over the whole table; its bound is ``sample_rows`` on average.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)
    share = min(1.0, sample_rows / total)
    sample = materialise(docs.select("text").sample(share, seed=1))
    sample.agg(F.sum(F.length("text"))).collect()  # first read and start-up outside the clock
    rate = {}
    for name, rejects in rules.items():
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(rejects)).collect()[0][0]
        rate[name] = rejected / (time.perf_counter() - start)
    return sorted(rules, key=lambda name: -rate[name])


def quality_cascade(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with base measures, ``base_failed`` and ``kept``."""
    rules = default_rules() if rules is None else rules
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name in cascade_order(docs, rules, sample_rows):
        verdict = verdict.when(rules[name], F.lit(False))
    return base_measures(docs).withColumn("kept", verdict.otherwise(F.lit(True)))
