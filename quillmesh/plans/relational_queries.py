"""Joins (J1-J6, J9), aggregations (A1-A7, A11, A12), set operations, order and windows (U, O, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import evaluation as Q
from quillmesh.operators import reach as R
from quillmesh.operators.cleansing import tokens
from quillmesh.operators.graph import PropertyGraph, top_k
from quillmesh.operators.lookup import lookup_join
from quillmesh.operators.ordering import consecutive_pairs, dense_index
from quillmesh.plans.bindings import link_graph, with_graph
from quillmesh.plans.registry import query
from quillmesh.session import materialise


@query(
    "j1_inner_join",
    "select c_name, o_orderkey, o_totalprice from orders join customer on c_custkey = o_custkey",
)
def j1(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(customers, "o_custkey").select("c_name", "o_orderkey", "o_totalprice")


RATINGS_SQL = """ratings as (select o_custkey as user, l_partkey as item, avg(l_quantity) as rate
    from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)"""


def ratings(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"), "l_quantity")
    return (
        t.orders.select("o_orderkey", F.col("o_custkey").alias("user"))
        .join(lines, "o_orderkey")
        .groupBy("user", "item")
        .agg(F.avg("l_quantity").alias("rate"))
    )


@query(
    "j2_composite_key_join",
    f"""with {RATINGS_SQL}, guesses as (select r."user", r.item, m.mean from ratings r join
            (select item, avg(rate) as mean from ratings group by item) m on m.item = r.item)
        select r."user", r.item, round(r.rate, 4) as rate, round(g.mean, 4) as guess from ratings r
        join guesses g on g."user" = r."user" and g.item = r.item""",
)
def j2(t):
    observed = materialise(ratings(t), "ratings")
    means = observed.groupBy("item").agg(F.avg("rate").alias("guess"))
    guesses = observed.select("user", "item").join(means, "item")
    joined = observed.join(guesses, ["user", "item"])
    return joined.select("user", "item", F.round("rate", 4).alias("rate"), F.round("guess", 4).alias("guess"))


@query(
    "j3_join_and_update",
    with_graph("""select v.id, case when m.n is null then v.role else v.role || ':' || m.n::varchar end as role
        from vertices v left join (select dst, count(*) as n from edges group by dst) m on m.dst = v.id"""),
)
def j3(t):
    g = link_graph(t)
    incoming = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.join_vertices(incoming, "role", F.concat_ws(":", "role", F.col("n").cast("string"))).vertices.select("id", "role")


@query(
    "j4_outer_join_default",
    """select c_custkey as id, coalesce(n, 0) as big_orders from customer left join
         (select o_custkey, count(*) as n from orders where o_totalprice > 400000 group by 1) on o_custkey = c_custkey""",
)
def j4(t):
    g = PropertyGraph(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("src")))
    big = t.orders.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("big_orders"))
    return g.outer_join_vertices(big, {"big_orders": F.lit(0)}).vertices


@query(
    "j5_dictionary_join",
    "select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey",
)
def j5(t):
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup_join(t.customer, names, "c_nationkey").select("c_custkey", "n_name")


@query(
    "j6_keyed_combine",
    """select o.id, o.n + l.n as combined from (select o_custkey as id, count(*) as n from orders group by 1) o
       join (select c_custkey as id, length(c_name) as n from customer where c_acctbal > 0) l on l.id = o.id""",
)
def j6(t):
    left = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    right = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.length("c_name").alias("m"))
    return left.join(right, "id").select("id", (F.col("n") + F.col("m")).alias("combined"))


@query(
    "j9_positional_pairing",
    """select a.doc_id, a.quality, b.toxic from (select *, row_number() over (order by doc_id) as k from labels) a
       join (select *, row_number() over (order by doc_id) as k from labels) b on a.k = b.k""",
)
def j9(t):
    """Two tables of equal order paired row by row."""
    left = dense_index(t.labels.select("doc_id", "quality"), ["doc_id"], "k")
    right = dense_index(t.labels.select("doc_id", "toxic"), ["doc_id"], "k").drop("doc_id")
    return left.join(right, "k").select("doc_id", "quality", "toxic")


@query("a1_keyed_count", "select event_type, count(*) as n from events group by event_type")
def a1(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a2_keyed_sum",
    """select l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) as price, sum(l_quantity) as quantity
       from lineitem group by 1, 2""",
)
def a2(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum("l_quantity").alias("quantity")
    )


@query("a3_distinct_keys", "select distinct p_brand, p_type from part")
def a3(t):
    return t.part.select("p_brand", "p_type").distinct()


@query(
    "a4_filtered_counts",
    """select count(*) as rows, count(*) filter (event_type = 'error') as errors,
         count(*) filter (value > 50) as large from events""",
)
def a4(t):
    return t.events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("value") > 50).alias("large"),
    )


@query(
    "a5_mean_and_max",
    "select round(sum(value) / count(*), 5) as mean, max(user_id) + 1 as dimension from events",
)
def a5(t):
    return t.events.agg(
        F.round(F.avg("value"), 5).alias("mean"), (F.max("user_id") + 1).alias("dimension")
    )


@query(
    "a6_tree_aggregate",
    """select round(sum(case when l_returnflag = 'R' then 1 else -1 end * 0.5::double * l_discount * l_quantity), 3) as total
       from lineitem""",
)
def a6(t):
    """A signed, weighted sum with fixed operands, combined per task before the shuffle."""
    sign = F.when(F.col("l_returnflag") == "R", 1).otherwise(-1)
    return t.lineitem.agg(F.round(F.sum(sign * 0.5 * F.col("l_discount") * F.col("l_quantity")), 3).alias("total"))


@query(
    "a7_aggregate_known_keys",
    """select o_custkey as id, round(sum(o_totalprice), 2) as total from orders
       where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by o_custkey""",
)
def a7(t):
    known = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    rows = t.orders.select(F.col("o_custkey").alias("id"), "o_totalprice")
    return rows.join(known, "id", "left_semi").groupBy("id").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "a11_pair_then_ratio",
    """select user_id, count(*) as n, round(sum(value) / count(*), 5) as mean from events
       where event_type <> 'error' group by user_id""",
)
def a11(t):
    pairs = t.events.filter("event_type <> 'error'").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return pairs.select("user_id", "n", F.round(F.col("total") / F.col("n"), 5).alias("mean"))


@query(
    "a12_mean_squared_error",
    f"""with {RATINGS_SQL}, m as (select item, avg(rate) as mean from ratings group by item)
        select round(avg(pow(rate - mean, 2)), 4) as mean_squared_error from ratings join m on m.item = ratings.item""",
)
def a12(t):
    observed = materialise(ratings(t), "ratings")
    means = observed.groupBy("item").agg(F.avg("rate").alias("guess"))
    error = Q.mean_squared_error(observed.join(means, "item"), "rate", "guess")
    return error.select(F.round("mean_squared_error", 4).alias("mean_squared_error"))


@query(
    "u1_bag_union",
    """select c_custkey as id, c_acctbal as amount from customer union all select s_suppkey, s_acctbal from supplier
       union all select o_custkey, o_totalprice from orders""",
)
def u1(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"))
    orders = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return customers.unionByName(suppliers).unionByName(orders)


@query(
    "u2_least_level_union",
    """select id, member, min(level) as level from (
         select o_custkey as id, o_orderkey as member, 1 as level from orders
         union all select user_id, event_id, 2 from events) group by id, member""",
)
def u2(t):
    first = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("member"), F.lit(1).alias("level"))
    second = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("member"), F.lit(2).alias("level"))
    return R.merge_levels(first, second)


@query(
    "o1_top_k",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5",
)
def o1(t):
    return top_k(t.orders, "o_totalprice", 5, tie="o_orderkey", columns=["o_orderkey", "o_totalprice"])


@query(
    "w1_consecutive_pairs",
    """select user_id, ts, event_id, previous, value as current from (select *, lag(value) over w as previous,
         row_number() over w as k from events window w as (partition by user_id order by ts, event_id)) where k > 1""",
)
def w1(t):
    return consecutive_pairs(t.events, "user_id", ["ts", "event_id"], "value")


WORDS_SQL = r"""select token, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) as token
    from documents) where token <> '' group by token"""


@query("a1_word_count", WORDS_SQL)
def a1_words(t):
    return tokens(t.documents, "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
