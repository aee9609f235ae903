from types import SimpleNamespace

import pytest

from barlake.dimensions import MAX_BROADCAST_ROWS, broadcast_listed, dimension, in_list_order
from barlake.session import (
    RUNTIME_CONF, configure, file_names, run_folder, settings, shared_folder, write_file,
)


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default),
                           sparkContext=SimpleNamespace(master=master))


def test_runs_write_below_the_folder_the_cluster_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    first, second = run_folder(spark, "job"), run_folder(spark, "job")
    assert first.startswith(f"{folder}/barlake/job-") and first != second
    assert shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"


def test_only_a_local_session_falls_back_to_a_temporary_folder():
    assert shared_folder(session("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))


def test_configure_resets_what_jobs_rely_on(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    configure(spark)
    assert {key: spark.conf.get(key) for key in RUNTIME_CONF} == RUNTIME_CONF


def test_only_short_lists_are_broadcast(spark):
    frame = dimension(spark, [("a", "x"), ("b", "y")], ["key", "ticker"])
    assert [tuple(row) for row in frame.collect()] == [(0, "a", "x"), (1, "b", "y")]
    hinted = broadcast_listed(frame, range(MAX_BROADCAST_ROWS))
    plain = broadcast_listed(frame, range(MAX_BROADCAST_ROWS + 1))
    assert "ResolvedHint" in hinted._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plain._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("length, exchanges", [(2, 0), (MAX_BROADCAST_ROWS + 1, 1)])
def test_list_order(spark, length, exchanges):
    rows = dimension(spark, [(f"k{n}",) for n in range(length)], ["key"])
    ordered = in_list_order(rows, range(length))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == exchanges
    assert [row.position for row in ordered.collect()] == list(range(length))



def test_settings_hold_inside_only(spark):
    names = {"spark.sql.shuffle.partitions": "3", "barlake.some.name": "x"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ValueError):
        with settings(spark, names):
            assert all(spark.conf.get(name) == value for name, value in names.items())
            raise ValueError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("barlake.some.name", None) is None


def test_small_files(spark, tmp_path):
    assert file_names(spark, f"{tmp_path}/none") == []
    for content in (b"one", b"two"):
        write_file(spark, f"{tmp_path}/folder/a.txt", content)
    assert "a.txt" in file_names(spark, f"{tmp_path}/folder")
    assert (tmp_path / "folder" / "a.txt").read_bytes() == b"two"
