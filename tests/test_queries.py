"""Every registered query with SQL gives the SQL's rows."""

import harness
import pytest

from tidewright import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert harness.differences(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_addresses_of_customers_with_keys_as_long_as_a_zip(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("explode(array(9950, 99950)) AS least", "c_custkey", "c_nationkey")
    rows.selectExpr("least + c_custkey AS c_custkey", "nullif(c_nationkey, 7) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert harness.differences(spark, plans.QUERIES["f17_address"], plans.ORACLE_SQL["f17_address"], str(tmp_path)) == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
