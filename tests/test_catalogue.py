"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sigflow.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in t) for t in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["linear_svm_ovr", "scaled_linear_svm", "mlp", "decision_tree", "rbf_svm"])
def test_classifiers_take_every_class(spark, duck, name):
    got = sorted({(r.vec_id, int(r.label)) for r in QUERIES[name](spark, DATA).collect()})
    assert got == sorted(duck.execute("select vec_id, label from embeddings where vec_id % 5 = 0").fetchall())


def test_csp_takes_every_pair_of_classes(spark, duck):
    got = QUERIES["csp_filters"](spark, DATA).select("c1", "c2").distinct().collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(SQL["class_pairs"]).fetchall())
