"""Keyed tables kept in numbered versions.

A version is a small file that tells, for each bucket of keys, the folder that holds it.
Folders are never written over; a version that changes a few keys writes their buckets and
refers to the others where they are.  A version comes into force when its file is created
under the next number, which only one writer can do: another one finds the number taken,
merges its rows into what is there now, and takes the number after.  A job that fails leaves
at most folders that nothing refers to.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DECISIONS, UPC_DECISIONS
from ..session import materialise

BUCKETS = 64


class Version(NamedTuple):
    number: int
    buckets: int
    parts: dict[str, str]  #: bucket to the folder that holds it
    batches: dict[str, int]  #: stream to its last batch that is in this version


class VersionedTable:
    """A table of one row per key, in a folder that all writers and readers see."""

    def __init__(self, spark: SparkSession, folder: str, service: str, schema: str, key: str = "key", buckets: int = BUCKETS):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.root = f"{folder.rstrip('/')}/service={service}"

    # ----------------------------------------------------------------------- versions
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> Version | None:
        files, path = self._path(f"versions/{name}")
        stream = files.open(path)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # created a moment ago, not written yet
            return None
        finally:
            stream.close()
        return Version(int(name.split(".")[0]), told["buckets"], told["parts"], told["batches"])

    def current(self) -> Version | None:
        """The version in force; None where nothing was saved yet."""
        files, path = self._path("versions")
        if not files.exists(path):
            return None
        names = sorted((s.getPath().getName() for s in files.listStatus(path)), reverse=True)
        return next((v for v in (self._read(n) for n in names if n.endswith(".json")) if v), None)

    def claim(self, version: Version) -> bool:
        """Bring ``version`` into force unless its number is taken."""
        files, path = self._path(f"versions/{version.number:012d}.json")
        try:
            stream = files.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False
        stream.write(json.dumps(version._asdict()).encode())
        stream.close()
        return True

    # ----------------------------------------------------------------------- rows
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def load(self, version: Version | None = None, only: set[str] | None = None) -> DataFrame:
        """Rows of a version, by default of the one in force; of some buckets only, if told."""
        version = version or self.current()
        held = version.parts.items() if version else []
        paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in sorted(held) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, buckets: int) -> str:
        folder = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).columns
        placed = rows.select(*columns).withColumn("bucket", self._bucket(buckets))
        placed.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return folder

    def merge(self, new: DataFrame, stream: str | None = None, batch: int | None = None, written: bool = False) -> Version:
        """Rows of ``new`` replace those of the same key; only their buckets are written.

        A batch of a stream that is in force already, as when it is run again after a
        failure, changes nothing.  ``written`` tells that ``new`` is read from written rows, so
        that its keys are at hand and its other columns are computed only where they are saved.
        """
        new = new if written else materialise(new, dense=True)
        while True:
            now = self.current() or Version(0, self.buckets, {}, {})
            if stream is not None and now.batches.get(stream, -1) >= batch:
                return now
            touched = {str(r[0]) for r in new.select(self._bucket(now.buckets)).distinct().collect()}  # as many as buckets
            parts = dict(now.parts)
            if touched:
                rows = new
                if touched & set(now.parts):  # else nothing is kept, and the keys need not move
                    kept = self.load(now, touched).join(new.select(self.key), self.key, "left_anti")
                    rows = new.unionByName(kept.select(*new.columns))
                folder = self._write(rows, now.buckets)
                parts |= dict.fromkeys(touched, folder)
            batches = now.batches | ({stream: batch} if stream is not None else {})
            version = Version(now.number + 1, now.buckets, parts, batches)
            if self.claim(version):
                return version

    def update(self, table: DataFrame) -> Version:
        """Merge those rows of ``table`` that are not in force as they are."""
        columns = self.spark.createDataFrame([], self.schema).columns
        return self.merge(table.select(*columns).subtract(self.load().select(*columns)))


def decisions_table(spark: SparkSession, folder: str, service: str, buckets: int = BUCKETS) -> VersionedTable:
    """Decisions of a service by identity key."""
    return VersionedTable(spark, folder, service, DECISIONS, "key", buckets)


def codes_table(spark: SparkSession, folder: str, service: str, buckets: int = BUCKETS) -> VersionedTable:
    """The memo of album codes of a service."""
    return VersionedTable(spark, folder, f"{service}-upc", UPC_DECISIONS, "upc", buckets)
