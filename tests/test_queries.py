"""Every registered query that SQL can express, against DuckDB; the others at least run."""

import pytest

from tests.conftest import SMALL, alike, duck
from tidemark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE_SQL:
        want = duck(ORACLE_SQL[name], SMALL)
        alike(got, want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3


def test_text_operators_are_optional(monkeypatch):
    import importlib

    import __spark_entry__ as e

    def gone(name):
        raise ImportError(name)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(e.queries()) == set(QUERIES)
