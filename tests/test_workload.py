"""Every registered query of the engine's own against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from graphloom.plans import workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, data, sql, name):
    found = workload.QUERIES[name](spark, data)
    if name not in workload.SQL:
        assert found.count() > 0, "held against brute force in test_features and test_communities"
        return
    wanted = sql.sql(workload.SQL[name]).df()
    got = found.toPandas()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("with_pipeline_file", [False, True])
def test_entry_survives_without_the_optional_parts(tmp_path, with_pipeline_file):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if with_pipeline_file and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(x.startswith('op1') for x in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
