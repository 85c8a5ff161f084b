"""Explorer, turns and encoders on small inputs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.catalog import Catalog
from loomtrace.operators import explorer
from loomtrace.sources import encode
from loomtrace.streaming import turns
from tests.test_engine import REPAIR, TALK, TICKET


@pytest.mark.parametrize(("form", "value"), [("atif", TICKET), ("actf", REPAIR), ("openai", TALK)])
def test_decoding_what_was_encoded_gives_the_same_rows(spark, tmp_path, form, value):
    kept = []
    for turn in ("a", "b"):
        folder = tmp_path / turn
        folder.mkdir()
        (folder / "x.json").write_text(value if isinstance(value, str) else json.dumps(value))
        r = Catalog(spark, str(folder)).relations()
        assert r.sources.first()["status"] == "ready"
        kept.append([sorted(map(repr, (row.asDict() for row in part.collect()))) for part in (r.runs, r.steps, r.tool_calls)])
        value = encode.export(r, form).first()["text"]
    assert kept[0] == kept[1]


def test_attempts_come_together_and_gaps_are_errors(spark, tmp_path):
    attempt = REPAIR["attempts"]["1"]
    (tmp_path / "x.json").write_text(json.dumps(REPAIR | {"attempts": {"1": attempt, "2": attempt}}))
    r = Catalog(spark, str(tmp_path)).relations()
    assert r.runs.count() == 2
    assert set(json.loads(encode.tasks(encode.export(r, "actf")).first()["text"])["attempts"]) == {"1", "2"}
    with pytest.raises(ValueError):
        encode.export(r, "actf", most=1)
    with pytest.raises(ValueError):
        encode.checked({"__run": True, "document_id": "d", "steps": '[{"turn_ordinal": 1, "step_id": 1}]'})
    with pytest.raises(ValueError):
        encode.checked({"__run": None, "document_id": "d", "steps": "[]"})


def test_search_sort_and_pages(spark):
    runs = spark.createDataFrame([("A-1", "s1", None, "active", "d/x", 5, None), ("a-2", "s2", "s1", "failed", "d/x/s2", 5, "m"), ("b", "s3", None, "ok", "d/xy", 1, None)], "agent_id string, session_id string, root_session_id string, status string, path string, row_count long, model_name string")
    names = lambda df: [x["session_id"] for x in df.collect()]
    assert sorted(names(explorer.search_runs(runs, " a-"))) == ["s1", "s2"] and names(explorer.search_runs(runs, status="FAILED", agent_id="all")) == ["s2"]
    assert sorted(names(explorer.search_runs(runs, path="d/x"))) == ["s1", "s2"]
    assert names(explorer.sorted_runs(runs, "events")) == ["s3", "s1", "s2"] and names(explorer.sorted_runs(runs, "events", True)) == ["s2", "s1", "s3"]
    page = explorer.paginate(explorer.sorted_runs(runs), 1, 1)
    assert names(page.rows) == ["s2"] and page.next_offset == 2 and not explorer.paginate(runs, 9, 1).has_more
    assert explorer.resolve(runs, "m", "s2")["agent_id"] == "a-2"
    with pytest.raises(LookupError):
        explorer.resolve(runs, "m", "s1")
    with pytest.raises(explorer.Ambiguous):
        explorer.resolve(runs.unionAll(runs), "b", "s3")
    assert [x["agent_id"] for x in explorer.aligned(runs, ["s3", "no", "s1"], "session_id").collect()] == ["b", None, "A-1"]
    with pytest.raises(ValueError):
        explorer.aligned(runs, ["a", "a"], "session_id")
    lit = F.lit
    paths = runs.limit(1).select(explorer.run_path(lit("d"), lit("."), lit("doc"), lit("s"), lit(None), lit("p")).alias("a"), explorer.run_path(lit("d"), lit("f"), lit("doc"), lit("s"), lit("r"), lit(None)).alias("b"), explorer.run_path(lit("d"), lit("f"), lit("doc"), lit("s"), lit("s"), lit(None)).alias("c")).first()
    assert tuple(paths) == ("d/p/subagents/doc", "d/f/r/s", "d/f/s")


def test_subagents_and_status(spark):
    long = "please look at every file of the folder and report " * 2
    hints = spark.createDataFrame([("s", 0, "doc", None), ("s", 1, None, long + "x"), ("s", 2, None, long), ("s", 3, None, "short")], "session_id string, hint long, doc_target string, prompt string")
    agents = spark.createDataFrame([("s", "a", None, long.replace(" ", "\n")), ("s", "b", "doc", long), ("s", "c", None, "short")], "session_id string, agent_id string, doc_target string, first_prompt string")
    assert {r["hint"]: r["agent_id"] for r in explorer.link_subagents(hints, agents).collect()} == {0: "b", 1: "a", 2: None, 3: None}
    assert explorer.metadata_status(['{"a": {"state": "OK"}}', None, "{"]) == "completed"
    assert explorer.metadata_status([None, '{"/x/status": "canceled"}', '{"is_terminal": true}']) == "failed"
    assert explorer.metadata_status(['{"is_terminal": true}']) == "completed" and explorer.metadata_status([]) == "active"
    row = spark.createDataFrame([(None, '{"status": "done?"}', None)], "a string, b string, c string")
    assert row.select(explorer.run_status("a", "b", "c")).first()[0] == "active"


def test_turns_of_stream_and_batch_are_equal(spark, tmp_path):
    kinds = ["note", "llm.response", "llm.request", "llm.response", "llm.call.cancelled", "llm.request", "llm.request", "llm.response.stream"]
    rows = [(f"s{i % 2}", i, kinds[i * 7 % 8], f"c{i % 5}" if i % 11 else None, i % 4 == 1, "hi" if i % 3 == 0 else None) for i in range(80)]
    events = turns.prepared(spark.createDataFrame(rows, "session_id string, append_pos long, kind string, call_id string, internal boolean, said string"), F.col("internal"), F.col("said"))
    batch = sorted(map(tuple, turns.assign(events).collect()))
    machines: dict = {}
    one_by_one = [(r["session_id"], r["append_pos"], r["kind"], r["call_id"], machines.setdefault(r["session_id"], turns.Machine()).observe(r["kind"], r["call_id"], r["internal"], r["spoken"])) for r in events.orderBy("append_pos").collect()]
    assert batch == sorted(one_by_one)
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in (events.where("append_pos < 31"), events.where("append_pos >= 31")):
        part.write.mode("append").parquet(path)
        stream = turns.follow(spark.readStream.schema(events.schema).parquet(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == batch
