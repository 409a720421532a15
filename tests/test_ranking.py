"""Ranks inside groups, whatever the positions look like."""

import shutil

from pyspark.sql import Window
from pyspark.sql import functions as F

from segue.operators.ranking import rank_by_position
from segue.registry import QUERIES


def test_ranks_equal_the_plain_window(spark):
    rows = [("hot", i) for i in range(3000)] + [("hot", 10**15)] + [(f"g{i % 50}", i * 7) for i in range(400)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, pos bigint")
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("pos")))
    key = ["g", "pos", "rank"]
    assert sorted(map(str, rank_by_position(df, ["g"], "pos").select(key).collect())) == sorted(map(str, plain.select(key).collect()))


def test_a_table_of_many_files_streams_like_one(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("labels", "pages"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    one, many = (QUERIES["stream_link"](spark, str(d)) for d in (sf, tmp_path))
    assert one.count() == many.count() > 0
    assert one.exceptAll(many).isEmpty()
