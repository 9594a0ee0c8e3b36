from lakeseek.plans import queries as Q


def test_examples_of_all_customers(spark, data):
    customers = spark.read.parquet(f"{data}/customer.parquet").where("c_nationkey is not null and c_mktsegment is not null")
    want = customers.select("c_nationkey", "c_mktsegment").distinct().count()
    few = customers.where("c_nationkey < 5").select("c_nationkey", "c_mktsegment").distinct().count()
    got = {(r["table_id"], r["col_x"], r["col_y"]): r["examples"] for r in Q.queries()["column_pair_search"](spark, data).collect()}
    assert got[1, 0, 1] == want > few
