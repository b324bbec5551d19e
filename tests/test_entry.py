import math
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pinion import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    v = v.item() if hasattr(v, "item") else v
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    out = duck.sql(entry.oracle_sql()[name])
    at = [out.columns.index(c) for c in sorted(out.columns)]
    assert sorted(df.columns) == sorted(out.columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in out.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def explained(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_reach_the_scan(spark):
    plan = explained(spark, catalog.QUERIES["filter_pushdown"](spark, DATA))
    assert "StringStartsWith(source,src1)" in plan and "EqualTo(lang,en)" in plan
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_top_k_is_bounded(spark):
    plan = catalog.QUERIES["knn_cosine"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry_without_the_corpus_operators(tmp_path):
    """The library and its queries stand without the llm folders and the pipeline."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    import shutil

    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'knn_cosine' in e.queries() and not [q for q in e.queries() if q[:2] == 'op' and q[2].isdigit()]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
