"""Tasks that have a field empty do not meet in one task of Spark."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cueloom.operators import transitions as tr


@pytest.fixture
def plain_joins(spark):
    """Joins by a shuffle into eight parts that nothing merges, splits or broadcasts."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_tasks_without_a_value_are_spread(spark, plain_joins):
    keys = ["", None, "/a", "/b"]
    tasks = spark.createDataFrame(
        [(i, keys[i % 2] if i < 1900 else keys[i % 4]) for i in range(2000)], "task_id long, custom_subtitle string"
    )
    table = spark.createDataFrame([("",), ("/a",), (None,)], "custom_subtitle string").withColumn("_sub", F.lit(True))
    found = tr.look_up(tasks, table, "custom_subtitle")
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.task_id for r in rows) == list(range(2000)) and found.columns == ["custom_subtitle", "task_id", "_sub"]
    assert all((r._sub is True) == (r.custom_subtitle in ("", "/a")) for r in rows)
    parts = [r.part for r in rows]
    assert max(parts.count(p) for p in set(parts)) < 500


def test_tasks_are_looked_up_as_before_when_few_have_a_value(spark):
    inventory = spark.createDataFrame(
        [("/s/t1.lrc", "/s", "t1.lrc", "t1", "lrc"), ("/d/x.wav", "/d", "x.wav", "x", "wav"), ("/ws/f1/1.wav", "/ws/f1", "1.wav", "1", "wav")],
        "path string, dir string, name string, stem string, ext string",
    )
    prints = spark.createDataFrame([("/s/t1.lrc", "f1"), ("/out/t2", "f1")], "path string, fingerprint string")
    tasks = spark.createDataFrame(
        [(1, "/s/t1.lrc", "", ""), (2, "", "/d", "/out/t2"), (3, "", "", ""), (4, None, None, None), (5, "/gone", "/gone", "")],
        "task_id long, custom_subtitle string, custom_mix_folder string, s1_output string",
    ).withColumns({"source_name": F.lit("n"), "source_path": F.lit("/m/n.mp4"), "from_folder": F.lit(False)})
    got = tr.find_inputs(tasks, tr.Site(inventory, prints, "/ws")).collect()
    assert {r.task_id: (r.subtitle_found, r.dub_found, r.speech_dir) for r in got} == {
        1: (True, False, "/ws/f1"), 2: (False, True, "/ws/f1"), 3: (False, False, None), 4: (False, False, None), 5: (False, False, None),
    }
