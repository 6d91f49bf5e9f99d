"""The driver's contract, with and without the optional corpus operators."""

import sys

import __spark_entry__ as entry_point


def test_core_queries_stand_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("veil.llm") or n in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)  # importing it now fails
    names = set(entry_point.queries())
    assert len(names) >= 47 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    assert set(entry_point.oracle_sql()) <= names


def test_every_oracle_has_its_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
