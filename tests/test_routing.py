"""Files pruned by predicates and by the routing index; external tables, pages and status."""

import json

import pytest

from loomtrace import catalog
from loomtrace.plans import routing


@pytest.fixture
def folder(tmp_path):
    for k in range(4):
        doc = {"schema_version": "ATIF-v1.7", "session_id": f"s-{k}", "agent": {"name": f"a{k % 2}"}, "steps": [{"step_id": 1, "source": "user", "message": "hi"}]}
        (tmp_path / f"f{k}.json").write_text(json.dumps(doc))
    return tmp_path


@pytest.mark.parametrize("where, wanted", [
    ("_file_ = 'f1.json'", "1"), ("'f1.json' <> _file_", "023"), ("_file_ LIKE 'f_.json' AND _file_ NOT IN ('f0.json', 'f3.json')", "12"), ("_file_ = 'f0.json' OR source = 'user'", "0123"),
    ("NOT (_file_ = 'f0.json' AND source = 'user')", "0123"), ("_file_ = 'f0.json' AND source = 'user'", "0"), ("_file_ LIKE 'f!_%' ESCAPE '!'", ""), ("_file_ ILIKE 'F1%'", "0123"),
    ("_file_ IN (SELECT _file_ FROM runs)", "0123"),
])
def test_file_predicates(spark, folder, where, wanted):
    c = catalog.Catalog(spark, str(folder))
    assert c.needed(f"SELECT * FROM steps WHERE {where}") == [f"f{k}.json" for k in wanted]


def test_a_filter_over_a_limit_prunes_nothing(spark, folder):
    c = catalog.Catalog(spark, str(folder))
    assert len(c.needed("SELECT * FROM (SELECT * FROM steps ORDER BY _file_ LIMIT 2) WHERE _file_ = 'f3.json'")) == 4
    assert len(c.needed("SELECT * FROM steps s JOIN runs r ON s._file_ = r._file_ WHERE s._file_ = 'f3.json'")) == 4


def test_index(spark, folder, tmp_path_factory):
    c, path = catalog.Catalog(spark, str(folder)), str(tmp_path_factory.mktemp("index") / "i")
    c.build_index(path)
    need = lambda where: c.needed(f"SELECT count(*) AS n FROM runs WHERE {where}", path)
    assert need("session_id = 's-2'") == ["f2.json"] and need("agent_id = 'a1'") == ["f1.json", "f3.json"]
    assert need("agent_id = 'a1' AND session_id IN ('s-2', 's-3')") == ["f3.json"] and need("session_id = 'none'") == []
    assert len(need("session_id = 's-2' OR notes IS NULL")) == 4 and len(need("session_id <> 's-2'")) == 4
    assert c.sql("SELECT session_id FROM runs WHERE session_id = 's-2' OR session_id = 's-0' ORDER BY 1", index=path) == [{"session_id": "s-0"}, {"session_id": "s-2"}]
    assert c.sql("SELECT count(*) AS n FROM runs WHERE session_id = 'none'", index=path) == [{"n": 0}]


def test_like():
    assert routing.like("a%")("a\nb") and not routing.like("a_")("a") and routing.like("a\\") is None


def test_pages_status_external(spark, folder):
    c = catalog.Catalog(spark, str(folder))
    first, token = c.page(size=3)
    rest, end = c.page(token, 3)
    assert [f.name for f in first + rest] == [f"f{k}.json" for k in range(4)] and end is None and c.describe("f1.json").size > 0
    with pytest.raises(ValueError):
        c.page("other:0")
    assert c.status() == {"status": "ready", "ready_sources": 4, "error_sources": 0, "counts_complete": True, "runs": 4, "steps": 4, "tool_calls": 0, "events": 0}
    (folder / "bad.json").write_text("{")
    assert catalog.Catalog(spark, str(folder)).status()["status"] == "degraded"
    (folder / "t.csv").write_text('k,v\n1,"a ""b"""\n')
    assert [tuple(r) for r in catalog.external(spark, "labels_csv", str(folder / "t.csv"), "csv").collect()] == [(1, 'a "b"')]
    for name in ("labels_csv", "1x", "a b"):
        with pytest.raises(ValueError):
            catalog.external(spark, name, str(folder / "t.csv"), "csv")
    spark.catalog.dropTempView("labels_csv")
