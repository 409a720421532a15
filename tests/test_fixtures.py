"""Order lines meet their orders by number: no second shuffle behind the numbering, no digits compared."""

import pytest

from segue import fixtures as fx


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    made = {
        "customer": ([(1, 7), (2, None)], "c_custkey bigint, c_nationkey int"),
        "orders": ([(10, 1, "O"), (11, 2, "O"), (12, 9, "O"), (None, 1, "O")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string"),
        "lineitem": ([(10, 1, 5), (10, 2, 5), (10, 1, 4), (12, 1, 5), (None, 1, 5), (10, 3, None)], "l_orderkey bigint, l_linenumber int, l_partkey bigint"),
        "part": ([(4, "a", "b", "t", 1), (5, "c", "b", "t", 50)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def test_items_are_joined_by_number(spark, tables):
    rows = sorted(fx.items(spark, tables).collect(), key=lambda r: r.pos)
    assert [(r.library_id, r.playlist_id, r.pos, r.track_id) for r in rows] == [("n7", "10", i, t) for i, t in ((1, "4"), (2, "5"), (3, "5"), (4, None))]
    for made in (fx.items, fx.lib_tracks, fx.keyed_lib_tracks):
        plan = made(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert joins and not any("playlist_id" in line or "track_id" in line for line in joins)


def test_libraries_list_a_part_once(spark, tables):
    assert sorted((r.library_id, r.track_id, r.pos) for r in fx.lib_tracks(spark, tables).collect()) == [("n7", "4", 4), ("n7", "5", 5)]
    assert "p_partkey" not in fx.keyed_lib_tracks(spark, tables).columns
