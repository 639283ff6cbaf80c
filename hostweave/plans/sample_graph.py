"""A link graph over the star-schema tables, on which every graph query can be held against another engine.

A customer is a domain ``<nation>.c<key>.com``; its id is its key, which is also its place in the byte order
of reversed names. Orders and parts link to suppliers' keys: with repeated links, links to oneself and links
from ids that no vertex has. Customers in debt have no rank row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The same relations in SQL: vx(id, rev), raw(from_id, to_id), ed(from_id, to_id), rk(rev, …), nr(id, …).
SQL = """
with vx as (
  select c_custkey as id, 'com.c' || lpad(cast(c_custkey as varchar), 9, '0') || '.' || replace(lower(n_name), '_', '-') as rev
  from customer join nation on c_nationkey = n_nationkey),
raw as (
  select o_custkey as from_id, l_suppkey as to_id from lineitem join orders on l_orderkey = o_orderkey
  union all select l_partkey, l_suppkey from lineitem),
ed as (select distinct from_id, to_id from raw where from_id <> to_id),
oc as (select o_custkey, count(*) as n from orders group by o_custkey),
rk as (
  select rev, coalesce(n, 0) * 1e-9::double as pagerank, c_acctbal + 2000 as harmonic,
    2 * c_custkey + 1 as pagerank_position, c_custkey + 1 as harmonic_position
  from customer join vx on id = c_custkey left join oc on o_custkey = c_custkey where c_acctbal >= 0),
nr as (
  select id, coalesce(cast(pagerank as float), 0::float) as pagerank, coalesce(cast(harmonic as float), 0::float) as harmonic,
    coalesce(pagerank_position, 0) as pagerank_position, coalesce(harmonic_position, 0) as harmonic_position
  from vx left join rk using (rev))
"""


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; its schema is read from the files once, as every inference is a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rev = F.concat(F.lit("com.c"), key, F.lit("."), F.translate(F.lower("n_name"), "_", "-"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), rev.alias("rev"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bought = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    return bought.unionAll(line.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id")))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").join(vertices(spark, sf_dir), F.col("c_custkey") == F.col("id"))
    c = c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        "rev", (F.coalesce("n", F.lit(0)) * F.lit(1e-9)).alias("pagerank"), (F.col("c_acctbal") + 2000).alias("harmonic"),
        (2 * F.col("c_custkey") + 1).alias("pagerank_position"), (F.col("c_custkey") + 1).alias("harmonic_position"),
    )
