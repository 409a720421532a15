"""The stages one after the other, and the registered queries on the smallest tables."""

import pytest

import corpus_pipeline
from check_oracle import compare, connect
from segue.llm.oracle import ORACLE
from segue.llm.queries import QUERIES
from segue.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF))
        assert out.schema == docs.schema, name
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text), (2, text + " more"), (2, text + " more"), (9, "other words here"), (9, "other words here"), (None, text), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(str, kept.select("doc_id").toPandas().doc_id.astype(object).where(lambda s: s.notna(), None))) == sorted(map(str, [1.0, 9.0, None, 4.0, 5.0]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    verdict, n, _, _, note = compare(spark, connect(SF), SF, name)
    assert verdict == ("equal" if name in ORACLE else "rows only") and n > 0, note
