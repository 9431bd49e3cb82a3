import sys

import pytest

import __spark_entry__ as entry
from strideway.plans.catalogue import QUERIES


def test_names(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["recording", "time", "steps"] and out.count() > 0


def test_only_absence_is_forgiven(tmp_path, monkeypatch):
    assert entry._optional("strideway.llm.no_such_module") is None and entry._optional("no_such_pipeline") is None
    (tmp_path / "broken_pipeline.py").write_text("import no_such_dependency\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_pipeline")
    sys.modules.pop("broken_pipeline", None)
