import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


def duck(sql: str, sf_dir: str, **tables):
    """A pandas frame from DuckDB over the test tables (``tables`` replace some)."""
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if t in tables:
            c.register(t, tables[t])
        else:
            c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c.execute(sql).df()


def alike(a, b) -> None:
    """Both frames hold the same rows; floats to 1e-9."""
    import numpy as np
    import pandas as pd

    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b), (len(a), len(b))

    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return int(v)
        if isinstance(v, (float, np.floating)):
            return float(f"{v:.9g}")
        return v

    rows = lambda f: sorted((tuple(plain(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False)), key=str)
    for x, y in zip(rows(a), rows(b)):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 1e-8 * max(1, abs(p), abs(q))), (x, y)
