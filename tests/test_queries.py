"""Every registered query that has SQL against DuckDB, and the others for a stable shape."""

import os
import shutil
import subprocess
import sys

import pytest

from latticework.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def rows_up_to(tmp_path, n: int) -> str:
    """The tables with n embeddings, so that the volume of ten slices is high, and ragged unless n is divided by ten."""
    import duckdb

    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name) if name != "embeddings.parquet" else None
    duckdb.execute(f"COPY (SELECT vec_id + 500 * k AS vec_id, embedding, label FROM '{SF}/embeddings.parquet', range(3) t(k) WHERE vec_id + 500 * k < {n}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("n", [1006])
@pytest.mark.parametrize("name", ["cone_projection", "dilate_3d", "mean_6_neighbours"])
def test_sql_of_ragged_volumes(spark, tmp_path, name, n):
    sf = rows_up_to(tmp_path, n)
    compare(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["y", "x", "v"] and df.count() == 1024


@pytest.mark.parametrize("gone", [["latticework/llm", "tests/llm"], ["latticework/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_points_without_the_optional_parts(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(k.startswith('op1_') for k in q), set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-B", "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr
    n, m, pipeline, llm, inside = out.stdout.split()
    left = "latticework/llm" not in gone and os.path.isdir(os.path.join(root, "latticework/llm"))
    assert int(n) >= len(QUERIES) and int(m) >= len(ORACLE_SQL) and inside == "True"
    assert (pipeline, llm) == ("False", str(left))
