import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_subpackage(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("grovetag.llm") or m in ("corpus_pipeline", "__spark_entry__")]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "grovetag.llm", None)
    again = importlib.import_module("__spark_entry__")
    assert "search_new" in again.queries() and not [q for q in again.queries() if q.startswith("op")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
