import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import DATA

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from incunable import queries as q

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    if name not in q.ORACLE_SQL:
        assert df.count() > 0
        return
    out = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(out.fetchall(), key=key)


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "incunable", tmp_path / "incunable", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split() == [str(len(q.QUERIES)), str(len(q.ORACLE_SQL))]
