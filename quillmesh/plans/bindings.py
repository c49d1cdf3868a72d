"""How the driver tables become a relation graph and a feature table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.graph import PropertyGraph
from quillmesh.plans.registry import Tables


def account_space(t: Tables) -> int:
    """Number of account ids edges may name: 5 % more than there are customers."""
    n = t.customer.count()
    return n + n // 20


def known_accounts(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("role"),
        F.col("c_acctbal").alias("age"),
    )


def order_relations(t: Tables) -> DataFrame:
    """One edge per order, from its customer to the account its key falls on, with a composite fact."""
    dst = F.col("o_orderkey") % F.lit(account_space(t))
    fact = F.concat_ws(
        ":",
        F.col("o_custkey").cast("string"),
        dst.cast("string"),
        F.col("o_orderkey").cast("string"),
        F.col("o_orderstatus"),
        F.translate("o_orderpriority", " ", "^"),
    )
    return t.orders.select(
        F.col("o_custkey").alias("src"),
        dst.alias("dst"),
        F.col("o_orderpriority").alias("relation"),
        F.col("o_totalprice").alias("amount"),
        fact.alias("fact"),
    )


def default_account() -> dict:
    return {"name": F.lit("unknown"), "role": F.lit("missing"), "age": F.lit(0.0)}


def fact_graph(t: Tables) -> PropertyGraph:
    """One edge per order."""
    return PropertyGraph.build(known_accounts(t), order_relations(t), default_account())


def link_graph(t: Tables) -> PropertyGraph:
    """One edge per (customer, account) pair with the least order amount."""
    links = order_relations(t).groupBy("src", "dst").agg(F.min("amount").alias("amount"))
    return PropertyGraph.build(known_accounts(t), links, default_account())


GRAPH_SQL = """
space as (select count(*) + count(*) // 20 as m from customer),
facts as (
  select o_custkey as src, o_orderkey % m as dst, o_orderpriority as relation, o_totalprice as amount,
         concat_ws(':', o_custkey::varchar, (o_orderkey % m)::varchar, o_orderkey::varchar, o_orderstatus,
                   replace(o_orderpriority, ' ', '^')) as fact
  from orders, space),
edges as (select src, dst, min(amount) as amount from facts group by src, dst),
known as (select c_custkey as id, c_name as name, c_mktsegment as role, c_acctbal as age from customer),
vertices as (
  select * from known
  union all
  select id, 'unknown', 'missing', 0.0::double
  from (select src as id from edges union select dst from edges) ends
  where id not in (select id from known))
"""


def with_graph(body: str) -> str:
    return f"with {GRAPH_SQL}{body}"


FEATURES = ("n_lines", "quantity", "price", "discount", "tax", "total")


def order_features(t: Tables) -> DataFrame:
    """Per order: label 1 when finished, and aggregates of its lines."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
    )
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
        *FEATURES[:-1],
        F.col("o_totalprice").alias("total"),
    )


FEATURE_SQL = """
features as (
  select o_orderkey as id, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as label,
         n_lines, quantity, price, discount, tax, o_totalprice as total
  from orders join (
    select l_orderkey, count(*)::double as n_lines, sum(l_quantity) as quantity, sum(l_extendedprice) as price,
           avg(l_discount) as discount, avg(l_tax) as tax
    from lineitem group by l_orderkey) on o_orderkey = l_orderkey)
"""


def with_features(body: str) -> str:
    return f"with {FEATURE_SQL}{body}"
