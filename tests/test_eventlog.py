"""Event log: fences, order, compaction and vacuum."""

import pytest

from loomtrace.operators import eventlog


def test_log_keeps_order_through_compaction_and_fences_old_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(eventlog, "FAN_OUT", 3)
    log, path = eventlog.EventLog(spark, str(tmp_path / "log")), tmp_path / "log"
    with pytest.raises(FileNotFoundError):
        log.read()
    log.acquire()
    for k in range(4):
        log.append(spark.range(k * 50, k * 50 + 50).selectExpr("id as seq", "concat('e', id) as event_id").repartition(3), ["seq"])
    rows = [(i, i) for i in range(200)]
    found = lambda df: sorted((r["append_pos"], r["seq"]) for r in df.collect())
    assert found(log.read()) == rows and found(log.read(40, 60)) == rows[40:60] and found(log.read(500)) == []
    version = log.stats()["fact_version"]
    assert log.compact() == 3 and log.stats() == {"rows": 200, "segments": 2, "fact_version": version, "levels": [0, 1]}
    assert found(log.read()) == rows and found(log.read(149, 151)) == rows[149:151]
    assert log.vacuum() == 0 and log.vacuum(0) == 3 and found(log.read()) == rows
    assert log.append(spark.range(0).selectExpr("id as seq", "cast(id as string) as event_id"), ["seq"]).rows == 200
    other = eventlog.EventLog(spark, str(path))
    other.acquire()
    with pytest.raises(eventlog.Conflict):
        log.append(spark.range(1).selectExpr("id as seq", "'x' as event_id"), ["seq"])
    other.append(spark.range(200, 201).selectExpr("id as seq", "'x' as event_id"), ["seq"])
    assert found(other.read())[-1] == (200, 200)
