"""What the optimiser makes of the queries: pushed filters, pruned columns, joins without Python."""

from pyspark.sql import functions as F

from tessaline.operators import aggregates, joins
from tessaline.plans import registry
from tessaline.plans.catalog import duckdb_sql, load, tables_in


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(registry.queries()["S1_typed_scan"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:" in text and "l_comment" not in text
    text = plan(registry.queries()["P12_between"](spark, sf_dir))
    assert "GreaterThanOrEqual(p_size,10)" in text and "LessThanOrEqual(p_size,20)" in text


def test_relational_queries_stay_in_the_engine(spark, sf_dir):
    for name, query in registry.queries().items():
        if name[0] in "qPJAOU":
            text = plan(query(spark, sf_dir))
            assert "Python" not in text and "Arrow" not in text, name


def test_range_partitions_are_pruned(spark, sf_dir):
    text = plan(registry.queries()["S1_range_partitions"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(__part" in text


def test_not_in_forms(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    ask = lambda values, negate: sorted((r["a"] for r in joins.in_subquery(left, "a", spark.createDataFrame([(v,) for v in values], "b int"), negate).collect()), key=str)
    assert ask([1, 3], True) == [2] and ask([1, None], True) == [] and ask([], True) == [1, 2, None] and ask([1, None], False) == [1]


def test_salted_average_of_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    out = aggregates.salted(df, ["k"], {"s": F.sum("id"), "n": F.count(F.lit(1))}, {"s": F.sum("s"), "n": F.sum("n")})
    want = df.groupBy("k").agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_oracle_text_names_typed_tables():
    sql = "SELECT * FROM orders o, part WHERE o.o_custkey = p_size"
    assert tables_in(sql) == ["orders", "part"]
    assert "typed_orders AS (SELECT * REPLACE" in duckdb_sql(sql) and "FROM typed_orders o, typed_part" in duckdb_sql(sql)
    assert duckdb_sql("WITH x AS (SELECT 1 FROM nation) SELECT * FROM x").startswith("WITH typed_nation AS")


def test_casts_of_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/orders.parquet").limit(0).write.parquet(str(tmp_path / "orders.parquet"))
    assert load(spark, str(tmp_path), "orders").count() == 0
