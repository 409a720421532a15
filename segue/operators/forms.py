"""A kept dictionary of names and their normal forms.

Each distinct name is normalised once, ever: names the dictionary lacks are found by an anti
join, and only those among them that the native form cannot express go through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialise
from ..sinks.versions import BUCKETS, VersionedTable

FORMS = "name string, normal string"


def forms_table(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> VersionedTable:
    return VersionedTable(spark, folder, "forms", FORMS, "name", buckets)


def normalised(names: DataFrame) -> DataFrame:
    """(name, normal) of written distinct names; no Python in the plan where none needs it."""
    native = names.select("name", text.norm_native("name").alias("normal"))
    rest = names.filter(text.needs_exact("name"))
    if rest.isEmpty():
        return native
    return native.filter("normal is not null").unionByName(rest.select("name", text.norm_exact("name").alias("normal")))


def learn(names: DataFrame, table: VersionedTable) -> DataFrame:
    """Bring the distinct names of ``names`` into the dictionary; returns the whole of it."""
    new = names.select("name").filter("name is not null").distinct().join(table.load().select("name"), "name", "left_anti")
    new = materialise(new)
    if not new.isEmpty():
        table.merge(normalised(new), written=True)
    return table.load()


def with_normal(rows: DataFrame, column: str, out: str, table: VersionedTable) -> DataFrame:
    """Add the normal form of ``column``, from the dictionary, which learns what it lacks.

    They meet by SHA-256, so neither side moves the names.
    """

    def digest(name):
        return F.unhex(F.sha2(name, 256))

    known = learn(rows.select(F.col(column).alias("name")), table).select(digest("name").alias("_name"), F.col("normal").alias(out))
    return rows.withColumn("_name", digest(column)).join(known, "_name", "left").drop("_name")
