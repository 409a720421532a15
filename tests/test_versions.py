"""Numbered versions of keyed tables, and streams that write them."""

import os

from segue.schemas import DECISIONS
from segue.sinks import versions
from segue.streaming import incremental

TRACK = "library_id string, track_id string, pos bigint, name string, artist string, album string, album_artist string, duration_ms bigint, isrc string"
ENTRY = "cand_id string, name string, artists array<string>, album string, album_id string, duration_s double, popularity int, isrc string"


def decided(spark, ids):
    return spark.createDataFrame([(k, i, 90.0, "t", "a", None, 78.0) for k, i in ids.items()], DECISIONS)


def held(table, version=None):
    return {r.key: r.id for r in table.load(version).collect()}


def folders(table):
    top = os.path.join(table.root, "data")
    return {f: {b for b in os.listdir(os.path.join(top, f)) if b.startswith("bucket=")} for f in os.listdir(top)}


def test_only_changed_buckets_are_written(spark, tmp_path):
    table = versions.decisions_table(spark, str(tmp_path), "s", buckets=16)
    assert table.current() is None and held(table) == {}
    first = table.merge(decided(spark, {f"q:{i}": str(i) for i in range(200)}))
    before = folders(table)
    second = table.merge(decided(spark, {"q:7": "new"}))
    (added,) = set(folders(table)) - set(before)
    assert len(folders(table)[added]) == 1 and second.number == first.number + 1
    assert held(table) == {f"q:{i}": "new" if i == 7 else str(i) for i in range(200)}
    assert held(table, first)["q:7"] == "7"  # readers of an earlier version are not disturbed
    assert table.update(table.load()).parts == second.parts  # nothing differs: nothing written
    other = versions.decisions_table(spark, str(tmp_path), "s", buckets=3)  # the number of buckets is the table's own
    other.merge(decided(spark, {"q:8": "new"}))
    assert held(table)["q:8"] == "new" and len(held(table)) == 200


def test_two_writers_one_number(spark, tmp_path):
    table = versions.decisions_table(spark, str(tmp_path), "s", buckets=4)
    table.merge(decided(spark, {"q:a": "1", "q:b": "1"}))
    other = versions.decisions_table(spark, str(tmp_path), "s", buckets=4)
    claim, lost = other.claim, []

    def late(version):
        """Another writer takes the number just before."""
        if not lost:
            lost.append(version.number)
            table.merge(decided(spark, {"q:b": "2", "q:c": "2"}))
        return claim(version)

    other.claim = late
    done = other.merge(decided(spark, {"q:a": "3"}))
    assert lost == [2] and done.number == 3
    assert held(table) == {"q:a": "3", "q:b": "2", "q:c": "2"}
    assert not table.claim(done) and table.current() == done


def test_a_version_not_yet_written_is_passed_over(spark, tmp_path):
    table = versions.decisions_table(spark, str(tmp_path), "s", buckets=4)
    done = table.merge(decided(spark, {"q:a": "1"}))
    open(os.path.join(table.root, "versions", "000000000002.json"), "w").close()
    assert table.current() == done and held(table) == {"q:a": "1"}


def test_a_batch_counts_once(spark, tmp_path):
    table = versions.decisions_table(spark, str(tmp_path), "s", buckets=4)
    one = table.merge(decided(spark, {"q:a": "1"}), "stream", 0)
    assert table.merge(decided(spark, {"q:a": "again"}), "stream", 0) == one
    table.merge(decided(spark, {"q:b": "1"}))
    table.merge(decided(spark, {"q:c": "1"}), "other", 0)
    assert table.merge(decided(spark, {"q:a": "late"}), "stream", 0).number == 3
    assert table.merge(decided(spark, {"q:a": "2"}), "stream", 1).batches == {"stream": 1, "other": 0}
    assert held(table) == {"q:a": "2", "q:b": "1", "q:c": "1"}


def test_stream_in_batches_and_again(spark, tmp_path):
    """Two batches that share a key decide it once; a lost checkpoint runs them again without effect."""
    rows = [[("l", f"t{b}{i}", b * 10 + i, f"Song number {i}", "Band", "Al", "Band", 1000, None) for i in range(b, b + 3)] for b in range(2)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    catalog = spark.createDataFrame([(f"c{i}", f"Song number {i}", ["Band"], "Al", "al1", 1.0, 1, None) for i in range(6)], ENTRY)
    for batch in rows:
        spark.createDataFrame(batch, TRACK).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(TRACK).parquet(source)
        incremental.link_stream(arriving, catalog, folder, "catalog").awaitTermination()
    table = versions.decisions_table(spark, folder, "catalog")
    assert held(table) == {f"q:band|song number {i}": f"c{i}" for i in range(4)}
    done = table.current()
    assert list(done.batches.values()) == [1] and done.number == 2
    os.rename(f"{folder}/progress", f"{folder}/progress-lost")
    none = spark.createDataFrame([], ENTRY)  # would decide otherwise if it were asked
    incremental.link_stream(spark.readStream.schema(TRACK).parquet(source), none, folder, "catalog").awaitTermination()
    assert table.current().parts == done.parts and held(table)["q:band|song number 0"] == "c0"


def test_names_meet_their_normal_forms_by_digest(spark, tmp_path):
    """Neither side of the join moves names; nulls and repeats keep their rows."""
    from segue.operators import forms

    rows = spark.createDataFrame([(1, "Ab  C"), (2, None), (3, "Ab  C"), (4, ""), (5, "É!")], "i int, line string")
    got = forms.with_normal(rows, "line", "normal", forms.forms_table(spark, str(tmp_path)))
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert joins and all("_name#" in x and "line#" not in x for x in joins)
    assert sorted(map(tuple, got.collect())) == [(1, "Ab  C", "ab c"), (2, None, None), (3, "Ab  C", "ab c"), (4, "", ""), (5, "É!", "e")]
