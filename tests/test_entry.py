"""The entry points without the training-data operators, or where those cannot be imported."""

import importlib
import sys
from types import ModuleType

import __spark_entry__ as entry


def without(monkeypatch, **modules):
    for name, module in modules.items():
        monkeypatch.setitem(sys.modules, name.replace("__", "."), module)
    return entry._training_data()


def test_missing_and_empty_subpackages_leave_the_rest(monkeypatch):
    assert without(monkeypatch, tidemark__llm=None) == ({}, {})
    assert without(monkeypatch, tidemark__llm=ModuleType("tidemark.llm")) == ({}, {})


def test_missing_pipeline_leaves_the_operators(monkeypatch):
    fake = ModuleType("tidemark.llm")
    fake.QUERIES, fake.CHECK_SQL = {"op": len}, {"op": "SELECT 1"}
    assert without(monkeypatch, tidemark__llm=fake, corpus_pipeline=None) == ({"op": len}, {"op": "SELECT 1"})


def test_import_is_repeatable():
    again = importlib.reload(entry)
    assert set(again.oracle_sql()) <= set(again.queries())
