"""Admission never waits, is bounded, and reports publishing; comparison statuses; projections."""

import threading

import pytest

from loomtrace.operators import results
from loomtrace.streaming import admission


def test_admission_bounds_and_order():
    go, got = threading.Event(), []

    def publish(events):
        assert go.wait(20)
        got.append(list(events))

    a = admission.Admission(publish, capacity=5, batch=2)
    assert a.try_append([1, 2]) == admission.ACCEPTED and a.try_append([3, 4, 5]) == admission.ACCEPTED
    assert a.try_append([6]) == admission.FULL and a.append_durable([6]) == admission.FULL
    go.set()
    a.close()
    assert [e for b in got for e in b] == [1, 2, 3, 4, 5] and max(map(len, got)) <= 2
    assert a.try_append([7]) == admission.UNAVAILABLE


def test_durable_and_failures():
    got = []

    def publish(events):
        if "bad" in events:
            raise OSError("no")
        got.extend(events)

    a = admission.Admission(publish, batch=1)
    assert a.append_durable(["x"], timeout=20) == admission.ACCEPTED and got == ["x"]
    with pytest.raises(OSError):
        a.append_durable(["bad"], timeout=20)
    assert a.append_durable(["y"], timeout=20) == admission.ACCEPTED and got == ["x", "y"]
    a.close()


def test_log_behind_admission(spark, tmp_path):
    from loomtrace.operators import eventlog

    log = eventlog.EventLog(spark, str(tmp_path / "log"))
    log.acquire()
    a = admission.Admission(lambda rows: log.append(spark.createDataFrame(rows, "seq long, kind string"), ["seq"]), wait=0.2)
    assert a.append_durable([(1, "a"), (2, "b")], timeout=60) == admission.ACCEPTED
    assert sorted((r["append_pos"], r["kind"]) for r in log.read().collect()) == [(0, "a"), (1, "b")]
    a.close()


def test_comparison(spark):
    rows = spark.createDataFrame([("a b", "a  b"), ("x", "x"), (None, " "), ("", "y"), ("z", None), ("abcd", "abxd")], "a string, b string")
    found = [tuple(r[0]) for r in rows.select(results.content_comparison(rows["a"], rows["b"])).collect()]
    assert found == [
        (True, True, "comparable", False, 1.0), (True, True, "comparable", True, 1.0), (False, False, "not_applicable_both_empty", None, None),
        (False, True, "original_empty", False, 0.0), (True, False, "replayed_empty", False, 0.0), (True, True, "comparable", False, 0.75),
    ]


def test_bound_projections_disappear(spark):
    sources = spark.createDataFrame([("e", "events"), ("p1", "storyline"), ("p2", "storyline"), ("other", "storyline"), ("f", "events")], "_file_ string, kind string")
    made = spark.createDataFrame([("e", "p1", False, "2", "9"), ("e", "p2", True, "1", "1"), ("gone", "other", True, "1", "1")], "event_file string, projection_file string, fresh boolean, last_modified string, generation string")
    found = {r["_file_"]: (r["projection_status"], r["projection_candidates"], r["served_by"]) for r in results.bind_projections(sources, made).collect()}
    assert found == {"e": ("fresh", 2, "p2"), "other": (None, 0, None), "f": ("missing", 0, None)}
