import importlib

import pytest

import __spark_entry__ as entry
from photoflow.llm import registry


def test_the_pipeline_is_left_out_alone(monkeypatch):
    module = importlib.import_module

    def absent(name):
        if name == "corpus_pipeline":
            raise ImportError(name)
        return module(name)

    with monkeypatch.context() as m, pytest.warns(UserWarning, match="corpus_pipeline"):
        m.setattr(importlib, "import_module", absent)
        names = set(entry.queries())
    assert set(registry.QUERIES) <= names and "pipeline" not in names
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())
