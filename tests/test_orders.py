"""The tiers of orders hold the whole table."""

import duckdb

from tidemark import catalog

SF = "/root/testdata/sf0.001"


def test_tiers_hold_every_order(spark):
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet'").fetchall()[0][0]
    rows = catalog.order_tiers(spark, SF).groupBy("period").sum("value").collect()
    assert [int(r[1]) for r in rows] == [n] * 3
    assert {r.entity_id for r in catalog.QUERIES["range_orders_many"](spark, SF).collect()} == {"even", "odd"}
