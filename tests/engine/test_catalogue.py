from meetspark.plans import catalogue


def test_unify_reaches_every_customer(spark, tmp_path):
    customer = [(i, i % 3, "S") for i in range(1, 31)]
    orders = [(i, float(i)) for i in range(1, 40, 2)] * 2
    spark.createDataFrame(customer, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in catalogue.unify_customers_orders(spark, str(tmp_path)).collect()}
    want = {(i, i % 3 if i < 31 else 2, "S" if i < 31 else None, float(i) if i % 2 else None, i < 31 and i % 2 == 1 and i % 3 != 2) for i in {*range(1, 31), *range(1, 40, 2)}}
    assert got == want
