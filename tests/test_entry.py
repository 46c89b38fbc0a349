"""The registries: SQL is text, of a query that exists, and an import that fails for another reason than absence isn't hidden."""

import importlib.util

import pytest

import __spark_entry__ as entry


def test_registries():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(isinstance(v, str) and v.strip() for v in sql.values())
    assert all(callable(f) for f in queries.values())


def test_other_failures_to_import_are_errors(monkeypatch):
    if importlib.util.find_spec("mentia.llm") is None:
        pytest.skip("the subpackage isn't there")
    monkeypatch.setattr(entry.importlib, "import_module", lambda name: (_ for _ in ()).throw(ImportError("xxhash")))
    with pytest.raises(ImportError):
        entry.queries()
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert "p1_found" in entry.queries() and "p2_found" not in entry.queries()
