"""The registered queries do the whole job, and their SQL is SQL."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"


def test_oracles_are_sql_of_registered_queries():
    found = __spark_entry__.oracle_sql()
    assert found and all(isinstance(sql, str) for sql in found.values())
    assert found.keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", ["hit_chances", "hit_chances_whole", "recombine_chances", "recombine_chances_whole", "active_models", "plan_gates"])
def test_results_are_those_of_the_sql(spark, name):
    db = duckdb.connect()
    for t in ("part", "lineitem", "customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF)
    sql = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(got.columns)
    norm = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert norm(got.select(columns).collect()) == norm(sql.fetchall())


def test_whole_chances_cut_no_row(spark):
    every = {n: __spark_entry__.queries()[n](spark, SF) for n in ("hit_chances_whole", "recombine_chances_whole")}
    types = spark.read.parquet(f"{SF}/part.parquet").selectExpr("lower(p_type)", "p_partkey % 2").distinct().count()
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert every["hit_chances_whole"].count() == types and every["recombine_chances_whole"].count() == orders


def test_active_models_collect_no_array(spark):
    plan = __spark_entry__.queries()["active_models"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_the_library_is_shipped_whole(tmp_path):
    import subprocess
    import sys

    path = __spark_entry__.packed(str(tmp_path))
    told = subprocess.run([sys.executable, "-c", "import listing_lake.queries as q; print(q.__file__, len(q.QUERIES))"], cwd="/", env={"PYTHONPATH": path}, capture_output=True, text=True)
    assert told.stdout.startswith(path) and int(told.stdout.split()[-1]) > 90, told.stderr
