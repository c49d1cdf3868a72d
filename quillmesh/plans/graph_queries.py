"""Graph operators on the order relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.plans.bindings import fact_graph, known_accounts, link_graph, order_relations, with_graph
from quillmesh.plans.registry import query


@query(
    "g1_build_graph",
    with_graph("select id, name, role, age from vertices"),
)
def g1(t):
    return link_graph(t).vertices


@query(
    "g2_predicate_counts",
    with_graph(""" select (select count(*) from vertices where role = 'BUILDING') as building_vertices,
        (select count(*) from edges where src > dst) as downward_edges"""),
)
def g2(t):
    g = link_graph(t)
    vertices = g.vertices.agg(F.count_if(F.col("role") == "BUILDING").alias("n")).select(F.lit("building_vertices").alias("k"), "n")
    edges = g.edges.agg(F.count_if(F.col("src") > F.col("dst")).alias("n")).select(F.lit("downward_edges").alias("k"), "n")
    return vertices.union(edges).agg(
        F.sum(F.when(F.col("k") == "building_vertices", F.col("n"))).alias("building_vertices"),
        F.sum(F.when(F.col("k") == "downward_edges", F.col("n"))).alias("downward_edges"),
    )


@query("g3_reverse", with_graph("select dst as src, src as dst, amount from edges"))
def g3(t):
    return link_graph(t).reverse().edges


@query(
    "g4_subgraph",
    with_graph("""select e.src, e.dst, e.amount from edges e
        where e.src in (select id from vertices where role <> 'missing' and age >= 0)
          and e.dst in (select id from vertices where role <> 'missing' and age >= 0)"""),
)
def g4(t):
    return link_graph(t).subgraph((F.col("role") != "missing") & (F.col("age") >= 0)).edges


@query(
    "g5_map_attributes",
    with_graph("""select e.src, e.dst, round(e.amount / 1000, 6) as thousands, s.role || '>' || d.role as roles
        from edges e join vertices s on s.id = e.src join vertices d on d.id = e.dst"""),
)
def g5(t):
    g = link_graph(t).map_edges(thousands=F.round(F.col("amount") / 1000, 6))
    g = g.map_triplets(roles=F.concat_ws(">", "src_role", "dst_role"))
    return g.edges.select("src", "dst", "thousands", "roles")


@query(
    "g6_degree_weights",
    with_graph("""select e.src, e.dst, round(1.0::double / d.n, 6) as weight
        from edges e join (select src, count(*) as n from edges group by src) d on d.src = e.src"""),
)
def g6(t):
    g = link_graph(t)
    degrees = g.outer_join_vertices(g.out_degrees(), {"out_degree": F.lit(0)})
    return degrees.map_triplets(["src"], weight=F.round(1.0 / F.col("src_out_degree"), 6)).edges.select("src", "dst", "weight")


@query(
    "g6_out_degree",
    with_graph("""select v.id, coalesce(d.n, 0) as out_degree from vertices v
        left join (select src, count(*) as n from edges group by src) d on d.src = v.id"""),
)
def g6_degree(t):
    g = link_graph(t)
    return g.outer_join_vertices(g.out_degrees(), {"out_degree": F.lit(0)}).vertices.select("id", "out_degree")


@query(
    "g7_aggregate_messages",
    with_graph("""select id, count(*) as n, round(sum(m), 2) as total from (
          select e.dst as id, s.age as m from edges e join vertices s on s.id = e.src join vertices d on d.id = e.dst
          union all
          select e.src, s.age from edges e join vertices s on s.id = e.src join vertices d on d.id = e.dst)
        group by id"""),
)
def g7(t):
    return (
        link_graph(t)
        .aggregate_messages(
            {"n": F.count, "total": F.sum}, to_dst=F.col("src_age"), to_src=F.col("src_age"), ends=["src"]
        )
        .select("id", "n", F.round("total", 2).alias("total"))
    )


OLDER_SQL = """ from edges e join vertices s on s.id = e.src join vertices d on d.id = e.dst
        where s.age > d.age group by e.dst"""


@query(
    "g8_average_older_follower",
    with_graph("select e.dst as id, round(sum(s.age) / count(*), 6) as average_age" + OLDER_SQL),
)
def g8(t):
    older = link_graph(t).aggregate_messages(
        {"followers": F.count, "total": F.sum}, to_dst=F.col("src_age"), where=F.col("src_age") > F.col("dst_age")
    )
    return older.select("id", F.round(F.col("total") / F.col("followers"), 6).alias("average_age"))


def shortest_path_sql(rounds: int) -> str:
    steps = ["d0 as (select 0::bigint as id, 0.0::double as distance)"]
    for i in range(rounds):
        steps.append(
            f"d{i + 1} as materialized (select id, min(distance) as distance from (select * from d{i} union all "
            f"select e.dst, d.distance + e.amount from d{i} d join edges e on e.src = d.id) group by id)"
        )
    return with_graph(
        ", " + ", ".join(steps) + f""" select v.id, round(coalesce(d.distance, -1), 2) as distance
        from vertices v left join d{rounds} d on d.id = v.id"""
    )


@query("g10_shortest_paths", shortest_path_sql(25))
def g10(t):
    paths = G.shortest_paths(link_graph(t), source=0, weight="amount")
    unreached = F.col("distance") == float("inf")
    return paths.select("id", F.round(F.when(unreached, -1.0).otherwise(F.col("distance")), 2).alias("distance"))


@query(
    "g9_bulk_rounds",
    with_graph(""", r1 as (select v.id, coalesce(max(s.age), v.age) as m from vertices v
            left join edges e on e.dst = v.id left join vertices s on s.id = e.src group by v.id, v.age),
        p1 as (select r.id, greatest(r.m, v.age) as best from r1 r join vertices v on v.id = r.id),
        p2 as (select p.id, greatest(p.best, coalesce(max(s.best), p.best)) as best from p1 p
            left join edges e on e.dst = p.id left join p1 s on s.id = e.src group by p.id, p.best)
        select id, best from p2"""),
)
def g9(t):
    """Greatest balance within two hops upstream, by two synchronous rounds."""
    return G.pregel(
        link_graph(t),
        initial={"best": F.col("age")},
        message=F.col("best"),
        merge=F.max,
        update={"best": F.greatest("best", "message")},
        changed=F.lit(True),
        max_rounds=2,
    )


def pagerank_sql(rounds: int, tolerance: float, edges: str, vertices: str) -> str:
    steps = [
        f"w as (select src, dst, 1.0::double / count(*) over (partition by src) as weight from {edges})",
        f"p0 as (select id, 0.15::double as rank, 0.15::double as delta from {vertices})",
    ]
    for i in range(rounds):
        steps.append(
            f"p{i + 1} as materialized (select p.id, p.rank + 0.85::double * coalesce(m.s, 0) as rank, "
            f"0.85::double * coalesce(m.s, 0) as delta from p{i} p left join (select w.dst, sum(q.delta * w.weight) as s "
            f"from p{i} q join w on w.src = q.id where q.delta > {tolerance} group by w.dst) m on m.dst = p.id)"
        )
    return ", " + ", ".join(steps)


@query(
    "g11_pagerank_fixed_rounds",
    with_graph(pagerank_sql(6, 0.0, "edges", "vertices") + "select id, round(rank, 5) as rank from p6"),
)
def g11(t):
    return G.pagerank(link_graph(t), tolerance=0.0, max_rounds=6).select("id", F.round("rank", 5).alias("rank"))


@query(
    "g11_pagerank_tolerance",
    with_graph(pagerank_sql(48, 0.001, "edges", "vertices") + "select id, round(rank, 4) as rank from p48"),
)
def g11_tolerance(t):
    return G.pagerank(link_graph(t), tolerance=0.001).select("id", F.round("rank", 4).alias("rank"))


# Components of the orders of one status, so that there is more than one of them.
STATUS_SQL = """, part_edges as (select distinct src, dst from facts
            where split_part(fact, ':', 4) = 'F' and relation = '1-URGENT'),
        part_vertices as (select src as id from part_edges union select dst from part_edges)"""


def components_sql(edges: str, vertices: str, rounds: int) -> str:
    steps = [
        f"both_ways as (select src, dst from {edges} union select dst, src from {edges} union select id, id from {vertices})",
        f"c0 as (select id, id as component from {vertices})",
    ]
    for i in range(rounds):
        steps.append(
            f"c{i + 1} as materialized (select b.dst as id, min(c.component) as component "
            f"from both_ways b join c{i} c on c.id = b.src group by b.dst)"
        )
    return ", " + ", ".join(steps)


@query(
    "g12_connected_components",
    with_graph(components_sql("edges", "vertices", 12) + "select id, component from c12"),
)
def g12(t):
    return G.connected_components(link_graph(t))


def urgent_finished(t):
    """The relation of urgent finished orders: sparse, with many components."""
    edges = order_relations(t).filter(
        (F.split("fact", ":")[3] == "F") & (F.col("relation") == "1-URGENT")
    ).select("src", "dst").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.PropertyGraph(ends, edges)


@query(
    "g12_sparse_components",
    with_graph(STATUS_SQL + components_sql("part_edges", "part_vertices", 60) + "select id, component from c60"),
)
def g12_sparse(t):
    return G.connected_components(urgent_finished(t))


@query(
    "g13_components_on_mask",
    with_graph(components_sql("edges", "vertices", 12) + """select id, component from c12
        where id in (select id from vertices where role <> 'missing')"""),
)
def g13(t):
    g = link_graph(t)
    valid = g.subgraph(F.col("role") != "missing")
    labelled = G.PropertyGraph(G.connected_components(g), g.edges)
    return labelled.mask(valid).vertices


TRIANGLE_SQL = """, simple as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst),
        tri as (select x.a as a, x.b as b, y.b as c from simple x join simple y on x.b = y.a
                join simple z on z.a = x.a and z.b = y.b),
        corner as (select a as id from tri union all select b from tri union all select c from tri),
        counts as (select v.id, count(c.id) as triangles from vertices v left join corner c on c.id = v.id group by v.id)"""


@query("g14_triangle_count", with_graph(TRIANGLE_SQL + "select id, triangles from counts"))
def g14(t):
    return G.triangle_counts(link_graph(t))


@query(
    "g15_rank_by_name",
    with_graph(pagerank_sql(5, 0.0, "edges", "vertices")
               + "select name, round(rank, 5) as rank from p5 join known on known.id = p5.id"),
)
def g15_rank(t):
    ranks = G.pagerank(link_graph(t), tolerance=0.0, max_rounds=5)
    return known_accounts(t).join(ranks, "id").select("name", F.round("rank", 5).alias("rank"))


@query(
    "g15_component_by_name",
    with_graph(components_sql("edges", "vertices", 12)
               + "select name, component from c12 join known on known.id = c12.id"),
)
def g15_component(t):
    return known_accounts(t).join(G.connected_components(link_graph(t)), "id").select("name", "component")


@query(
    "g15_triangles_by_name",
    with_graph(TRIANGLE_SQL + "select name, triangles from counts join known on known.id = counts.id"),
)
def g15_triangles(t):
    return known_accounts(t).join(G.triangle_counts(link_graph(t)), "id").select("name", "triangles")


@query(
    "g16_top_users",
    with_graph(""", attributed as (select id, case when age >= 0 then 2 else 1 end as n from known),
        kept as (select id from attributed where n = 2),
        sub as (select src, dst from edges where src in (select id from kept) and dst in (select id from kept))"""
               + pagerank_sql(48, 0.001, "sub", "kept")
               + "select id, round(rank, 4) as rank from p48 order by rank desc, id limit 5"),
)
def g16(t):
    """Top users by rank among those with exactly two attributes (name, and role where the balance is not negative)."""
    users = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.array("c_name", "c_mktsegment")).otherwise(F.array("c_name")).alias("attrs"),
    )
    followers = link_graph(t).edges.select("src", "dst")
    g = G.PropertyGraph.build(users, followers, {"attrs": F.array().cast("array<string>")})
    sub = g.subgraph(F.size("attrs") == 2)
    ranked = sub.outer_join_vertices(G.pagerank(sub, tolerance=0.001), {"rank": F.lit(0.0)})
    return G.top_k(ranked.vertices.withColumn("rank", F.round("rank", 4)), "rank", 5, columns=["id", "rank"])


@query(
    "j7_graph_mask",
    with_graph("""select src, dst from edges where amount >= 200000
        and src in (select id from vertices where role <> 'missing')
        and dst in (select id from vertices where role <> 'missing')"""),
)
def j7(t):
    g = link_graph(t)
    valid = g.subgraph(F.col("role") != "missing", F.col("amount") >= 200000)
    return g.mask(valid).edges.select("src", "dst")


@query(
    "j8_triplets",
    with_graph("""select e.src, e.dst, e.amount, s.name as src_name, d.name as dst_name
        from edges e join vertices s on s.id = e.src join vertices d on d.id = e.dst"""),
)
def j8(t):
    return link_graph(t).triplets().select("src", "dst", "amount", "src_name", "dst_name")


@query(
    "p16_sentence_template",
    with_graph("""select distinct s.name || ' is the ' || e.relation || ' of ' || d.name as sentence
        from facts e join vertices s on s.id = e.src join vertices d on d.id = e.dst"""),
)
def p16(t):
    sentence = F.format_string("%s is the %s of %s", "src_name", "relation", "dst_name")
    return fact_graph(t).triplets().select(sentence.alias("sentence")).distinct()
