"""F23_F25_F26_F27_numbers doesn't depend on the order of rows."""

from functools import reduce
from itertools import permutations
from operator import add

import duckdb
from lucerna.plans.oracles import ORACLES
from lucerna.plans.queries import QUERIES


def test_prices_that_sum_to_a_whole_number_in_any_order(spark, tmp_path):
    orders = list(permutations([59739.47, 38198.61, 100630.59, 57250.33]))
    assert {reduce(add, o) < 255819 for o in orders} == {True, False}  # as doubles, some orders give less
    rows = [(k, 1.0, p) for k, o in enumerate(orders) for p in o]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["F23_F25_F26_F27_numbers"](spark, str(tmp_path)).collect()
    assert len(out) == len(orders) and {r.gigabytes for r in out} == {"23.83 GB"}


def test_means_of_fifty_lines_are_rounded_as_in_sql(spark, tmp_path):
    """A mean of 50 lines by 40 can lie half way between two numbers of three places."""
    rows = [(total, float(total // 50 + (k < total % 50)), 10.0) for total in (117, 203, 811, 937, 1001, 1003, 1009, 1011, 1017, 1019, 1747, 1997) for k in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    name = "F23_F25_F26_F27_numbers"
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(duck.execute(ORACLES[name]).fetchall())
