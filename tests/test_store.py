"""Whole documents from events, kept in three tables; tables on manifests."""

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import documents, manifests, store, tables
from loomtrace.relations import over_tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(repr(r.asDict()) for r in df.drop("storage_ordinal").collect())


def _same(a, b):
    return all(_rows(getattr(a, n)) == _rows(getattr(b, n)) for n in store.TABLES)


def test_incremental_equals_replay(spark, tmp_path):
    events = over_tables(spark, SF).events
    kept = store.DocumentStore(spark, str(tmp_path / "docs"))
    assert kept.sync("log", events.where("append_pos < 300"), 1, 300) == "rebuild"
    assert kept.sync("log", events.where("append_pos < 300"), 1, 300) == "noop"
    places = {r["document_id"]: r["storage_ordinal"] for r in kept.read().runs.collect()}
    assert kept.sync("log", events, 2, 1000) == "incremental" and kept.fresh("log", 2, 1000)
    assert _same(kept.read(), documents.fold_events(events))
    after = {r["document_id"]: r["storage_ordinal"] for r in kept.read().runs.collect()}
    assert places.items() <= after.items() and sorted(after.values()) == list(range(len(after)))
    assert kept.sync("other", events, 2, 1000) == "rebuild" and kept.sync("other", events.where("append_pos < 9"), 3, 9) == "rebuild"


def test_upsert_insert_and_point(spark, tmp_path):
    whole = documents.fold_events(over_tables(spark, SF).events)
    part = lambda r, s: store.Relations(*(getattr(r, n).where(F.col("session_id") == s) for n in store.TABLES), r.events)
    kept = store.DocumentStore(spark, str(tmp_path / "docs"))
    kept.insert(part(whole, "s1"))
    with pytest.raises(manifests.Conflict):
        kept.insert(part(whole, "s1"))
    kept.insert(part(whole, "s1"), squash=True)
    assert sorted(r[0] for r in kept.read().runs.select("document_id").collect()) == ["s1", "s1#1"]
    before = kept.read().steps.where("document_id = 's1'").count()
    changed = part(whole, "s1")
    kept.upsert(store.Relations(changed.runs, changed.steps.where("step_id < 3"), changed.tool_calls.limit(0), changed.events))
    found = kept.point("part-1", "s1", "s1")
    assert [r["step_id"] for r in found.steps.collect()] == [1, 2] and before > 2 and found.tool_calls.isEmpty()
    with pytest.raises(LookupError):
        kept.point("part-1", "nobody")
    assert kept.maintain(many=1) and kept.read().runs.count() == 2


def test_two_writers_and_a_crash(spark, tmp_path):
    table = tables.Table(spark, str(tmp_path / "t"), ("value", "k"))
    rows = lambda *ids: spark.createDataFrame([(i, f"k{i % 2}/ü") for i in ids], "id long, k string")
    table.create(rows(1, 2))
    with pytest.raises(FileExistsError):
        table.create(rows(1))
    number = int(table.current())
    table.add(rows(3))
    with pytest.raises(manifests.Conflict):
        table.replace(rows(9), after=number)  # the second of two writers
    table._write(rows(7))  # a crash before the manifest
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3] and table.partitions() == ["k0/ü", "k1/ü"]
    assert table.optimize() == 2 and table.vacuum() == 4 and table.count_rows("k = 'k1/ü'") == 2
    table.update(F.col("id") == 3, k=F.lit("k0/ü"))
    table.delete(F.col("id") == 1)
    assert table.filter("k = 'k0/ü'", ["id"], "id", limit=1).collect()[0]["id"] == 2 and len(table.to_pandas()) == 2
    assert tables.list_tables(spark, str(tmp_path)) == ["t"]
    table.drop()
    assert not table.exists()
