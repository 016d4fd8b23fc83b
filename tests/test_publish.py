"""Versioned publish and refresh-all with a failing mart."""

import json
import os

import pytest

from matchmart import storage
from matchmart.plans import publish


def test_publish_switches_version_and_refresh_all_survives_failure(spark, tmp_dir):
    root = os.path.join(tmp_dir, "marts")
    publish.publish(spark, root, "m", spark.range(3))
    assert publish.current(spark, root, "m").count() == 3
    assert spark.table("m").count() == 3

    def bad():
        raise RuntimeError("boom")

    status = publish.refresh_all(spark, root, {"m": lambda: spark.range(5), "x": bad})
    st = {r["mart"]: r for r in status.collect()}
    assert st["m"]["status"] == "refreshed" and st["m"]["rows"] == 5
    assert st["x"]["status"] == "failed" and "boom" in st["x"]["error"]
    assert publish.current(spark, root, "m").count() == 5


def test_a_batch_added_again_changes_nothing(spark, tmp_dir):
    from matchmart.plans import incremental
    root = os.path.join(tmp_dir, "states")
    m = spark.createDataFrame([(1, 1500, 5, True, 3), (2, 1600, 6, False, 3)],
                              "match_id long, duration long, first_blood_time long, radiant_win boolean, region long")
    for _ in range(2):
        incremental.add_batch(spark, root, m, batch="day-1")
    assert incremental.mart_from_state(spark, root, "regions_stat").first().match_count == 2
    incremental.add_batch(spark, root, m, batch="day-2")
    assert incremental.mart_from_state(spark, root, "regions_stat").first().match_count == 4


def _match(i):
    return (i, 1500 + i, 5, True, 3)


SHAPE = "match_id long, duration long, first_blood_time long, radiant_win boolean, region long"


def test_two_interleaved_writers_lose_no_batch(spark, tmp_dir, monkeypatch):
    """A second writer commits between the first one's read and its commit."""
    from matchmart.plans import incremental
    root = os.path.join(tmp_dir, "states")
    incremental.add_batch(spark, root, spark.createDataFrame([_match(1)], SHAPE), batch="a")
    other = iter(["c", "d"])
    real = publish.publish

    def slow(session, *args, **kw):
        name = next(other, None)
        if name is not None:
            monkeypatch.setattr(publish, "publish", real)
            batch = spark.createDataFrame([_match(ord(name))], SHAPE)
            incremental.add_batch(spark, root, batch, batch=name)
            monkeypatch.setattr(publish, "publish", slow)
        return real(session, *args, **kw)

    monkeypatch.setattr(publish, "publish", slow)
    incremental.add_batch(spark, root, spark.createDataFrame([_match(2)], SHAPE), batch="b")
    assert next(other, None) is None
    assert json.loads(publish.current_note(spark, root, "regions_stat_state")) == ["a", "c", "d", "b"]
    assert incremental.mart_from_state(spark, root, "regions_stat").first().match_count == 4


def test_a_version_is_committed_once(spark, tmp_dir):
    root = os.path.join(tmp_dir, "marts")
    assert publish.publish(spark, root, "n", spark.range(1), view=False) == 1
    assert publish.publish(spark, root, "n", spark.range(2), after=1, view=False) == 2
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, "n", spark.range(9), after=1, view=False)
    assert publish.current(spark, root, "n").count() == 2
    assert publish.publish(spark, root, "n", spark.range(3), view=False) == 3
    assert [n for n, _ in storage.names(spark, f"{root}/n") if n.startswith("v=")].__len__() == 3
    assert not storage.create(spark, f"{root}/n/_published/{3:012d}", "x")


def test_vacuum_keeps_readers_and_writers_at_work(spark, tmp_dir):
    root = os.path.join(tmp_dir, "marts")
    for k in range(4):
        publish.publish(spark, root, "w", spark.range(k), view=False)
    spark.range(7).write.parquet(f"{root}/w/v=being-written")
    before = publish.version(spark, root, "w", 3)
    assert len(publish.vacuum(spark, root, "w")) == 2
    assert publish.current(spark, root, "w").count() == 3 and before.count() == 2
    assert publish.vacuum(spark, root, "w") == []
    assert publish.vacuum(spark, root, "w", orphan_seconds=-1) == ["v=being-written"]
    assert publish.current(spark, root, "w").count() == 3


def test_marts_are_found_in_the_catalogue(spark, tmp_dir):
    root = os.path.join(tmp_dir, "marts")
    spark.sql("CREATE OR REPLACE VIEW foreign_view AS SELECT 1 AS x")
    try:
        publish.publish(spark, root, "seen", spark.range(3))
        publish.publish(spark, os.path.join(tmp_dir, "elsewhere"), "other_root", spark.range(3))
        assert publish.mart_views(spark, root) == ["seen"]
        status = {r["mart"]: r for r in publish.refresh_all(spark, root, {"made": lambda: spark.range(2)}).collect()}
        assert status["made"]["status"] == "refreshed"
        assert status["seen"]["status"] == "failed" and "no definition" in status["seen"]["error"]
        assert "other_root" not in status and "foreign_view" not in status
        publish.refresh_all(spark, root, {"made": lambda: spark.range(5), "seen": lambda: spark.range(4)}).collect()
        session = spark.newSession()  # persistent views, not this session's own
        assert session.table("made").count() == 5 and session.table("seen").count() == 4
        assert spark.table("foreign_view").first().x == 1
        with pytest.raises(ValueError, match="not the view of a mart"):
            publish.publish(spark, root, "foreign_view", spark.range(1))
    finally:
        for v in ("foreign_view", "seen", "made", "other_root"):
            spark.sql(f"DROP VIEW IF EXISTS {v}")
