"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from assaylake.plans import registry
from assaylake.sources.views import TABLES


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.7g}")
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Queries without SQL: the columns that each gives.
WITHOUT_SQL = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, sf, name):
    got = registry.queries()[name](spark, sf)
    found = got.toPandas()
    assert len(found) and list(found.columns) == got.columns and len(set(got.columns)) == len(got.columns)
    sizes = {table: spark.read.parquet(f"{sf}/{table}.parquet").count() for table in ("lineitem", "embeddings", "documents", "labels")}
    whole = {"boxcox": "lineitem", "yeojohnson": "customer", "quantile_normal": "lineitem", "pca2": "lineitem", "reduce_data": "lineitem", "kmeans": "lineitem", "hierarchical": "lineitem", "characteristic_points": "lineitem", "predict_table": "lineitem", "cluster_points": "embeddings", "fuzzy_signature": "documents", "burgess_topk": "labels", "nataraj_bigram": "labels", "sun_profile": "labels", "perdisci_mlp": "lineitem"}
    if name in whole and whole[name] in sizes:
        assert len(found) == sizes[whole[name]]
    for column in ("prediction", "cluster", "core"):
        if column in found:
            assert found[column].notna().all()
    for column in ("probability", "accuracy", "precision", "recall", "f"):
        if column in found:
            assert found[column].between(0, 1).all()
    for column in ("accuracy", "importance"):
        if column in found:
            assert found[column].max() > 0


def test_scaled_columns_without_sql(spark, sf):
    for name, column in (("boxcox", "price"), ("yeojohnson", "c_acctbal")):
        value = registry.queries()[name](spark, sf).toPandas()[column]
        assert abs(value.mean()) < 1e-3 and abs(value.std() - 1) < 1e-2
    normal = registry.queries()["quantile_normal"](spark, sf).toPandas().price
    assert abs(normal.median()) < 0.05 and 0.7 < normal.clip(-3, 3).std() < 1.3
    parts = registry.queries()["pca2"](spark, sf).toPandas()
    assert abs(parts.pc1.corr(parts.pc2)) < 1e-3 and parts.pc1.var() >= parts.pc2.var()
