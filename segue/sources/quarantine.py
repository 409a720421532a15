"""Rows a reader cannot use: kept apart with the reason, and counted.

``split`` gives what is sound, what was rejected, and an observation that the first action on
the sound rows fills with both counts, so counting costs no pass of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


class Split(NamedTuple):
    rows: DataFrame
    rejected: DataFrame  #: reader, source, reason, body
    counts: Observation  #: n_read, n_rejected


def split(read: DataFrame, reader: str, source: str, reason: Column, body: str | None = None) -> Split:
    """Split ``read`` by ``reason``: null where a row is sound.  ``source`` names where it came from."""
    marked = read.withColumn("_reason", reason)
    counts = Observation()
    observed = marked.observe(counts, F.count(F.lit(1)).alias("n_read"), F.count("_reason").alias("n_rejected"))
    rejected = marked.filter(F.col("_reason").isNotNull()).select(
        F.lit(reader).alias("reader"),
        F.col(source).cast("string").alias("source"),
        F.col("_reason").alias("reason"),
        (F.col(body).cast("string") if body else F.lit(None).cast("string")).alias("body"),
    )
    return Split(observed.filter(F.col("_reason").isNull()).drop("_reason"), rejected, counts)


def parsed_json(texts: DataFrame, schema: str, body: str = "body", name: str = "_parsed") -> DataFrame:
    """Add the parsed body as ``name``, with the text itself in its field ``_corrupt`` where it is malformed."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return texts.withColumn(name, F.from_json(body, f"{schema}, {CORRUPT} string", options))


def malformed(body: str = "body", name: str = "_parsed") -> Column:
    """Why a body parsed by ``parsed_json`` cannot be used."""
    return F.when(F.nullif(F.trim(body), F.lit("")).isNull(), "empty").when(
        F.col(name).isNull() | F.col(f"{name}.{CORRUPT}").isNotNull(), "malformed"
    )


def unsound_decision() -> Column:
    """Why a stored decision cannot be used."""
    return (
        F.when(F.nullif("key", F.lit("")).isNull(), "no key")
        .when(F.col("score").isNull() | F.isnan("score"), "no score")
        .when(F.col("threshold").isNull() | F.isnan("threshold"), "no threshold")
    )


def nameless_playlist() -> Column:
    """Why a playlist of a property list cannot be used."""
    return F.when(F.col("Name").isNull(), "no name")
