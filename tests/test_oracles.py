"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cinelake.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(x + 0.0, 6) if isinstance(x, float) else x

    return sorted(str([value(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.execute(f"create view {name.partition('.')[0]} as select * from '{SF}/{name}'")
    return made


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).collect()


def test_the_rest_stands_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/cinelake", tmp_path / "cinelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
