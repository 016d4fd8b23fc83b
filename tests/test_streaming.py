"""Resumable streaming ingest: new files only, nothing twice."""

import json
import os

from matchmart.operators.load import read_table
from matchmart.streaming.ingest import run_ingest


def _doc(mid, slots):
    return json.dumps({"match_id": mid, "duration": 100 * mid, "radiant_win": True,
                       "players": [{"player_slot": s, "hero_id": 1, "win": 1} for s in slots]})


def test_stream_picks_up_only_new_files(spark, tmp_dir):
    landing, root, ckpt = (os.path.join(tmp_dir, x) for x in ("land", "wh", "ckpt"))
    os.makedirs(landing)
    with open(os.path.join(landing, "a.jsonl"), "w") as f:
        f.write(_doc(1, [0, 1]) + "\n" + _doc(2, [0]) + "\n")
    run_ingest(spark, landing, root, ckpt)
    assert read_table(spark, f"{root}/matches").count() == 2
    with open(os.path.join(landing, "b.jsonl"), "w") as f:
        f.write(_doc(2, [0]) + "\n" + _doc(3, [5]) + "\n")   # 2 is a repeat
    run_ingest(spark, landing, root, ckpt)
    assert sorted(r.match_id for r in read_table(spark, f"{root}/matches").collect()) == [1, 2, 3]
    run_ingest(spark, landing, root, ckpt)                  # nothing new
    assert read_table(spark, f"{root}/players").count() == 4


def test_stream_starts_before_anything_landed(spark, tmp_dir):
    landing, root, ckpt = (os.path.join(tmp_dir, x) for x in ("land", "wh", "ckpt"))
    run_ingest(spark, landing, root, ckpt)             # nothing there yet
    with open(os.path.join(landing, "a.jsonl"), "w") as f:
        f.write(_doc(9, [0]) + "\n")
    run_ingest(spark, landing, root, ckpt)
    assert [r.match_id for r in read_table(spark, f"{root}/matches").collect()] == [9]


def test_daily_runs_read_new_files_only_from_dated_folders(spark, tmp_dir):
    """The second run's scan reads the second day's rows and no others."""
    from pyspark.sql import functions as F

    from matchmart import storage
    from matchmart.operators.load import insert_ignore
    from matchmart.plans import etl
    from matchmart.sources import jsonl
    landing, root, marts = (os.path.join(tmp_dir, x) for x in ("land", "wh", "marts"))
    insert_ignore(spark, spark.createDataFrame([(1, "axe")], "hero_id long, localized_name string"),
                  f"{root}/heroes", ["hero_id"])
    none = etl.run_daily(spark, landing, root, marts)               # before anything landed
    assert {r["rows"] for r in none.where("status = 'loaded'").collect()} == {0}

    def day(date, *docs):
        jsonl.land(spark.createDataFrame([(d,) for d in docs], "value string"), landing, F.lit(date))

    day("2025-01-01", _doc(1, [0, 1]), _doc(2, [0]))
    day("2025-01-02", _doc(3, [0]))
    q = run_ingest(spark, landing, root, f"{root}/_landed")
    assert sum(p["numInputRows"] for p in q.recentProgress) == 3
    day("2025-01-03", _doc(3, [0]), _doc(4, [2, 3]))
    seen = []
    q = run_ingest(spark, landing, root, f"{root}/_landed", on_batch=lambda s: seen.append(
        {r["table"]: r["inserted"] for r in s.collect()}))
    assert sum(p["numInputRows"] for p in q.recentProgress) == 2     # day 3 alone
    assert [s["matches"] for s in seen] == [1]
    day("2025-01-04", _doc(5, [0]))
    got = {r["step"]: r["rows"] for r in etl.run_daily(spark, landing, root, marts).collect()}
    assert (got["matches"], got["players"], got["players_items"]) == (1, 1, 6)
    again = etl.run_daily(spark, landing, root, marts).where("status = 'loaded'").collect()
    assert {r["rows"] for r in again} == {0}

    lines = jsonl.read_lines(spark, landing)
    assert sorted({r.run_date for r in lines.collect()}) == [f"2025-01-0{k}" for k in range(1, 5)]
    plan = lines.where("run_date = '2025-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan
    scratch = spark.sparkContext.getCheckpointDir() + "/matchmart"
    assert not [n for n, _ in storage.names(spark, scratch) if n.startswith("staging")]
