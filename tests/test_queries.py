"""Every registered query of the engine against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from ferroflux.operators import model
from ferroflux.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "customer events documents embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = canonical(found.fetchall(), columns)
    assert expected
    assert canonical([tuple(r) for r in df.collect()], df.columns) == expected


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql()) - {"learning_curve"}))
def test_query_without_sql_has_rows(spark, name):
    """All columns of all rows; the learning curve, 10,000 trees, runs with smaller ones below."""
    rows = queries.queries()[name](spark, SF).collect()
    assert rows and not any(v is None for r in rows for v in r)


def test_forests_use_all_components_and_the_defaults(spark, monkeypatch):
    seen = []
    whole = model.grow
    monkeypatch.setattr(model, "grow", lambda stored, labels, columns, edges, **options: seen.append((len(columns), options)) or whole(stored, labels, columns, edges, **options | {"trees": 2, "depth": 3}))
    assert queries.forest_importance(spark, SF).count() == 20
    assert queries.forest(spark, SF).count() > 0
    assert queries.forest_shap(spark, SF).count() % 126 == 0
    assert queries.segment_importance(spark, SF).groupBy("segment").count().filter("count = 64").count() == 5
    assert queries.learning_curve(spark, SF).count() == 10
    whole_forest = {"trees": 200, "depth": 12, "leaf": 2, "split": 5, "seed": 42}
    assert seen == [(64, whole_forest)] * 2 + [(126, whole_forest), (64, {"fits": 5, "trees": 100, "depth": 30, "leaf": 1, "split": 2}), (64, {"fits": 50, "trees": 200, "depth": 12})]


def test_entry_imports_without_optional_parts(tmp_path):
    """In a copy without the corpus operators and the pipeline the entry has this part's queries and SQL alone."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{home}/ferroflux", tmp_path / "ferroflux", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) , sorted(e.oracle_sql()), sep='\\n')"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert told.stdout.splitlines()[-2:] == [str(sorted(queries.queries())), str(sorted(oracles.oracle_sql()))]
