import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def cell(v):
        return round(v, 9) if isinstance(v, float) else v
    return sorted(names), sorted(str(tuple(cell(v[i]) for i in order)) for v in values)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 120


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["house_id", "category", "n_in_radius", "nearest_mm"] and df.count() > 0


# A few per family; all of them run against the SQL in the check of the driver.
@pytest.mark.parametrize("name", [
    "distance_features", "k_nearest_articles", "near_duplicates", "weighted_tf_idf", "weighted_vector_sum", "quadrants",
    "clean_houses", "step_counts", "describe", "article_records", "category_points", "vocabulary", "xml_articles",
    "positional_records", "checksum_manifest", "district_summary", "results_table",
])
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    cur = db.execute(contract.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())
