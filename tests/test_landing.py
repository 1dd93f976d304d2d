"""Orders written as nested JSON and flattened: amounts come back to the last digit (SRC-3)."""

from datetime import datetime


def test_amounts_just_below_a_whole_number_stay_below(spark, tmp_path):
    from patronage import catalog

    at = datetime(2000, 1, 1)
    prices = [(8609.15, 0.05), (46.0, 0.0), (0.07, 0.0), (12_345_678.9, 0.1), (8177.999_999_9, 0.0), (57_101.999_999_999, 0.0)]
    spark.createDataFrame([(1, 5, "O", 1.0, at, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, n, 1, 1, 1.0, p, d, "N", at) for n, (p, d) in enumerate(prices)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "p", "b", "t")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(r.whole_sales for r in catalog.queries()["SRC-3"](spark, str(tmp_path)).collect())
    assert got == sorted(int(p * (1 - d)) for p, d in prices)
