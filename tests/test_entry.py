"""The registry: every oracle has a query, and the flagship query runs."""

from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and all(map(callable, queries.values()))
    own = [q for q in queries if q != "pipeline" and not q.startswith("op")]
    assert set(own) <= set(sqls)  # all queries of the library's own operators have an oracle


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["chat_key", "message_id", "sender", "text", "time", "type"] and df.count() > 0


def test_queries_without_the_optional_subpackage(monkeypatch):
    """A subpackage that is missing, or cannot be imported, takes only its own queries away."""
    for name in ("corpus_pipeline", "chatweave.llm.queries"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, name, None)
            if "chatweave.llm" in sys.modules:  # imported before
                m.delattr(sys.modules["chatweave.llm"], "queries", raising=False)
            queries = entry.queries()
            assert "load_messages" in queries and "pipeline" not in queries and set(entry.oracle_sql()) <= set(queries)
