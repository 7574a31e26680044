"""The registered queries against their SQL on the smallest test data, and without the training-data subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

from quern.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if v is None or pd.isna(v) else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr), list(frame.columns)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    held = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        held.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    assert rows_of(catalog.queries()[name](spark, DATA).toPandas()) == rows_of(held.execute(catalog.oracle_sql()[name]).df())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_import_without_training_data(tmp_path):
    """The entry points work where the subpackage and its pipeline are gone."""
    for name in ("quern", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quern" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
