"""Steps read by projection equal those of the whole decoder."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace import catalog
from loomtrace.sources import projected


def test_projection_equals_decoder(spark, tmp_path):
    def doc(i, **more):
        steps = [
            {"step_id": k, "source": "agent" if k % 2 else "user", "message": "m", "model_name": f"x{k}" if k % 2 else None, "metrics": {"elapsed_ms": 10 * k, "ttft_ms": k} if k % 3 else None} for k in range(1, 6)
        ]
        return {"schema_version": "ATIF-v1.4", "session_id": f"s{i}", "agent": {"name": "a", "version": "1"}, "steps": steps} | more

    (tmp_path / "one.json").write_text(json.dumps(doc(1, trajectory_id="t1")))
    (tmp_path / "many.json").write_text(json.dumps([doc(2), doc(3)]))
    (tmp_path / "inner.json").write_text(json.dumps(doc(4, subagent_trajectories=[doc(5)])))
    (tmp_path / "bad.json").write_text("{no")
    c = catalog.Catalog(spark, str(tmp_path))
    columns = ["_file_", "document_id", "session_id", "step_id", "source", "model_name", "latency_ms", "ttft_ms"]
    where = (F.col("step_id").between(2, 4)) & F.col("source").isin("agent") & F.col("session_id").isin("s1", "s3", "s4")
    rows, odd = projected.atif_steps(spark, {f.name: f.path for f in c.files}, columns, where)
    want = c.relations(names=["one.json", "many.json"]).steps.where(where).select(*columns)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, want.collect())) and rows.count() == 2
    assert {r[0] for r in odd.collect()} == {"inner.json", "bad.json"}
    with pytest.raises(ValueError):
        projected.atif_steps(spark, {}, ["step_id", "observation_json"])
