"""Events and trajectories in the catalog, several Datasets, and what the gate lets through."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace import catalog
from loomtrace.operators import documents
from loomtrace.operators.eventlog import EventLog
from loomtrace.plans import gate
from loomtrace.relations import over_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("dataset")
    steps = [{"step_id": i, "source": s, "message": f"m{i}"} for i, s in ((1, "user"), (2, "agent"))]
    for name in "ab":
        (where / f"{name}.json").write_text(json.dumps({"schema_version": "ATIF-v1.4", "session_id": f"f{name}", "agent": {"name": "x", "version": "1"}, "steps": steps}))
    log = EventLog(spark, f"{where}/logs/one")
    log.acquire()
    log.append(over_tables(spark, SF).events.where("session_id in ('s1', 's2')").drop("_file_"), ["append_pos"])
    return str(where)


def test_events_and_trajectories(spark, root):
    c = catalog.Catalog(spark, root)
    assert [f.name for f in c.files] == ["a.json", "b.json"] and list(c.logs) == ["logs/one"]
    found = c.sql("SELECT session_id, count(*) AS n FROM events GROUP BY session_id ORDER BY session_id")
    want = over_tables(spark, SF).events.where("session_id in ('s1', 's2')")
    assert found == [r.asDict() for r in want.groupBy("session_id").agg(F.count("*").alias("n")).orderBy("session_id").collect()]
    rows = c.sql("SELECT _file_, document_id, step_count, size(step_ids) AS k, step_sources[0] AS s FROM trajectories ORDER BY _file_, document_id")
    assert [r["_file_"] for r in rows] == ["a.json", "b.json", "logs/one", "logs/one"] and all(r["step_count"] == r["k"] for r in rows) and rows[0]["s"] == "user"
    folded = documents.fold_events(c.events()).steps.count()
    assert c.sql("SELECT count(*) AS n FROM steps WHERE _file_ = 'logs/one'") == [{"n": folded}] and sum(r["step_count"] for r in rows) == folded + 4
    assert c.sql("SELECT kind, status FROM sources WHERE _file_ = 'logs/one'") == [{"kind": "event_log", "status": "ready"}]
    assert c.sql("SELECT count(*) AS n FROM information_schema.columns WHERE table_name = 'events'") == [{"n": 14}]
    assert c.dataframe("SELECT step_id FROM steps").where("step_id = 2").count() >= 3
    with pytest.raises(gate.Exhausted):
        catalog.Catalog(spark, root, max_fold_rows=5).sql("SELECT * FROM runs")
    assert catalog.Catalog(spark, root, max_fold_rows=5).sql("SELECT count(*) > 5 AS many FROM events") == [{"many": True}]


def test_several_datasets(spark, root, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": "ATIF-v1.4", "session_id": "fa", "agent": {"name": "y", "version": "1"}, "steps": []}))
    both = catalog.Datasets(spark, {"one": root, "two": str(tmp_path)})
    rows = both.sql("SELECT one.runs.session_id FROM one.runs JOIN two.runs t ON runs.session_id = t.session_id".replace("one.runs.session_id", "runs.session_id"))
    assert rows == [{"session_id": "fa"}]
    assert both.sql("SELECT 'from one.runs' AS x, count(*) AS n FROM two.runs") == [{"x": "from one.runs", "n": 1}]
    with pytest.raises(gate.Rejected):
        both.sql("SELECT 1 FROM one.runs r JOIN one.steps s ON r.document_id = s.document_id")


ALLOWED = (
    "SELECT count(*) AS n FROM runs r JOIN steps s ON r._file_ = s._file_ AND r.document_id = s.document_id",
    "WITH x AS (SELECT _file_ AS f, document_id FROM runs) SELECT count(*) AS n FROM x JOIN steps s ON s._file_ = x.f",
    "SELECT (SELECT count(*) FROM steps) AS n", "EXPLAIN SELECT 1", "DESCRIBE runs", "SELECT * FROM VALUES (1), (2) AS t(a)", "SELECT count(*) AS n FROM runs WHERE session_id = 'a OR b'",
    "SELECT count(*) AS n FROM runs r JOIN steps s ON r._file_ = s._file_ AND (s.source = 'user OR x' OR s.step_id > 0)",
)
BARRED = (
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT count(*) FROM text.`/etc/hostname`",
    "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x", "SELECT * FROM runs WHERE session_id IN (SELECT value FROM text.`/etc/hostname`)", "SELECT * FROM runs WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)",
    "SELECT * FROM runs WHERE session_id = (SELECT java_method('java.lang.System', 'getProperty', 'user.home'))", "WITH x AS (SELECT * FROM json.`/x`) SELECT * FROM x", "EXPLAIN SELECT * FROM text.`/etc/hostname`",
    "DROP VIEW runs", "SET x = 1", "CREATE TABLE t (a int)", "INSERT INTO runs SELECT * FROM runs", "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT input_file_name() FROM runs", "ADD JAR '/x'", "CACHE TABLE runs",
    "SELECT 1 FROM runs r JOIN steps s ON r.document_id = s.document_id", "SELECT 1 FROM runs r, steps s", "SELECT 1 FROM runs r JOIN steps s ON r._file_ = s._file_ OR r.document_id = s.document_id",
    "SELECT 1 FROM runs r JOIN steps s ON r._file_ = r._file_ AND r.document_id = s.document_id",
)


@pytest.mark.parametrize("text", ALLOWED)
def test_gate_lets_queries_through(spark, root, text):
    catalog.Catalog(spark, root).sql(text)


@pytest.mark.parametrize("text", BARRED)
def test_gate_rejects(spark, root, text):
    with pytest.raises(gate.Rejected):
        catalog.Catalog(spark, root).sql(text)


def test_evidence_is_clamped(spark):
    assert gate.clamp_bytes(None) == gate.MOST_BYTES and gate.clamp_bytes(1) == gate.LEAST_BYTES and gate.clamp_bytes(5000) == 5000
    df, rows = gate.wrap(spark, "SELECT explode(sequence(1, 500)) AS x;", 1000)
    assert rows == 200 and df.count() == 201 and gate.wrap(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a", 0)[1] == 1
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "  "):
        with pytest.raises(gate.Rejected):
            gate.wrap(spark, bad)
