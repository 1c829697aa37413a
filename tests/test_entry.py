"""The driver's contract."""

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["kind", "group"]
    assert str(ROOT) in spark.sparkContext.environment["PYTHONPATH"].split(":")


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "veristrata").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "veristrata.llm" not in path.read_text(), path
