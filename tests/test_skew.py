"""One key holds a third of all rows: results stay whole, and AQE may split the joins."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import compare, duck

REWRITES = {
    # every third line belongs to one order, product and seller; every third order to one
    # customer; every third event reviews one order; a third of the parts has no category
    "lineitem": "SELECT * EXCLUDE (i) REPLACE (if(i % 3 = 0, 9, l_orderkey) AS l_orderkey, "
                "if(i % 3 = 0, 7, l_partkey) AS l_partkey, "
                "if(i % 3 = 0, 2, l_suppkey) AS l_suppkey)",
    "orders": "SELECT * EXCLUDE (i) REPLACE (if(i % 3 = 0, 5, o_custkey) AS o_custkey, "
              "if(o_orderkey = 9, 'F', o_orderstatus) AS o_orderstatus)",
    "events": "SELECT * EXCLUDE (i) REPLACE (if(i % 3 = 0, 6, event_id) AS event_id)",
    "part": "SELECT * EXCLUDE (i) REPLACE (if(i % 3 = 0, 'Brand#1', p_brand) AS p_brand)",
}


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for table in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem",
                  "events"):
        source = f"(SELECT *, row_number() OVER () AS i FROM '{sf_dir}/{table}.parquet')"
        select = REWRITES.get(table, "SELECT * EXCLUDE (i)")
        con.execute(f"COPY ({select} FROM {source}) TO '{folder}/{table}.parquet' "
                    "(FORMAT parquet, ROW_GROUP_SIZE 2048)")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [*entry_points._reports(), "fact_orders", "fact_order_categories", "fact_seller_orders",
     "fact_payments", "audit_orphans", "audit_cardinality", "audit_numeric_profile"],
)
def test_hot_keys_do_not_change_results(spark, skewed, name):
    assert compare(spark, duck(skewed), skewed, name) is None


def test_skewed_join_is_split(spark, skewed):
    """With small thresholds the optimizer splits the hot order of an items join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        # several map tasks, or there is nothing to split by
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = entry_points.queries()["category_growth"](spark, skewed)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert compare(spark, duck(skewed), skewed, "category_growth") is None
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
