"""Survey-like tables from the driver's tables, for the registered queries (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DT = 0.05


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """line, tracl, samples, delrt, dt from embeddings."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("label").alias("line"),
        F.col("vec_id").alias("tracl"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
        (F.col("vec_id") % 3 * F.lit(0.2)).alias("delrt"),
        F.lit(DT).alias("dt"),
    )


def series(spark: SparkSession, d: str) -> DataFrame:
    """line, k (from 1), a from events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("line"), F.row_number().over(w).alias("k"), F.col("value").alias("a"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """line, tracl, x, y, amp from lineitem."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("line"), F.row_number().over(w).alias("tracl"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_discount").alias("amp"), F.col("l_extendedprice").alias("price")
    )


def nav(spark: SparkSession, d: str) -> DataFrame:
    """line, tracl, x, y from orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("line"), F.row_number().over(w).alias("tracl"), (F.col("o_totalprice") / 100).alias("x"), (F.col("o_orderkey") % 997).cast("double").alias("y"), "o_orderkey")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """line, tracl, x, y from orders: each customer's points lie in a box of 50 x 20 that reaches over its neighbours' boxes."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x, y = F.col("o_custkey") * 10 + F.col("o_totalprice") % 50, (F.col("o_orderkey") * 7 % 20).cast("double")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("line"), F.row_number().over(w).alias("tracl"), x.alias("x"), y.alias("y"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    """il, xl, fold, samples from embeddings: all vectors of each label, numbered; fold is 0 where vec_id divides by 3."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").withColumn("xl", F.row_number().over(w))
    return e.select((F.col("label") + 1).cast("int").alias("il"), "xl", F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0).alias("fold"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


def extent(cube: DataFrame) -> tuple[int, int]:
    """Inlines and crosslines of the grid that holds all bins."""
    n_il, n_xl = cube.agg(F.max("il"), F.max("xl")).first()
    return n_il or 0, n_xl or 0


#: The same as DuckDB common table expressions.
SQL = {
    "traces": "traces AS (SELECT label AS line, vec_id AS tracl, list_transform(embedding, lambda x: x::DOUBLE) AS s, (vec_id % 3) * 0.2::DOUBLE AS delrt FROM embeddings)",
    "samples": "samples AS (SELECT line, tracl, delrt, unnest(range(len(s)))::INT AS i, unnest(s) AS amp FROM traces)",
    "series": "series AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS k, value AS a FROM events)",
    "points": "points AS (SELECT l_orderkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS tracl, l_quantity::DOUBLE AS x, l_tax * 100 AS y, l_discount AS amp, l_extendedprice AS price FROM lineitem)",
    "nav": "nav AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS tracl, o_totalprice / 100 AS x, (o_orderkey % 997)::DOUBLE AS y, o_orderkey FROM orders)",
    "tracks": "tracks AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS tracl, o_custkey * 10 + o_totalprice % 50 AS x, (o_orderkey * 7 % 20)::DOUBLE AS y FROM orders)",
    "cube": "cube AS (SELECT (label + 1)::INT AS il, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS xl, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS fold, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)",
    "grid": "n AS (SELECT max(il) AS ni, max(xl) AS nx FROM cube), grid AS (SELECT i::INT AS i, il::INT AS il, xl::INT AS xl, coalesce(s[i + 1], 0) AS amp FROM (SELECT il, unnest(range(1, nx + 1)) AS xl FROM (SELECT unnest(range(1, ni + 1)) AS il, nx FROM n)) LEFT JOIN cube USING (il, xl), range(64) r(i))",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([*[SQL[n] for n in names], *([more] if more else [])]) + " "
