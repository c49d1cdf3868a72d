"""Graph operators on small graphs whose answers are worked out by hand or by brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import reach as R


@pytest.fixture(scope="module")
def four(spark):
    vertices = spark.createDataFrame(
        [(3, "ann", "student"), (7, "bob", "postdoc"), (5, "cyd", "prof"), (2, "dee", "prof")],
        "id bigint, name string, role string",
    )
    edges = spark.createDataFrame(
        [(3, 7, "collab"), (5, 3, "advisor"), (2, 5, "colleague"), (5, 7, "pi")],
        "src bigint, dst bigint, relation string",
    )
    return G.PropertyGraph(vertices, edges)


@pytest.fixture(scope="module")
def six(spark, four):
    vertices = four.vertices.union(spark.createDataFrame([(4, "eve", "student")], four.vertices.schema))
    edges = four.edges.union(spark.createDataFrame([(4, 0, "student"), (5, 0, "colleague")], four.edges.schema))
    return G.PropertyGraph.build(vertices, edges, {"name": F.lit("nobody"), "role": F.lit("missing")})


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def random_graph(spark, n, m, seed, hub_share=0.0):
    chance = random.Random(seed)
    pairs = set()
    while len(pairs) < m:
        src = 0 if chance.random() < hub_share else chance.randrange(n)
        pairs.add((src, chance.randrange(n)))
    vertices = spark.range(n)
    edges = spark.createDataFrame([(a, b, f"e{a}-{b}") for a, b in pairs], "src bigint, dst bigint, fact string")
    return G.PropertyGraph(vertices, edges), pairs


def levels_by_hand(n, pairs, rounds):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    found = {}
    for v in range(n):
        level, frontier = {v: 1}, {v}
        for hop in range(2, rounds + 2):
            frontier = {w for u in frontier for w in out[u]} - set(level)
            level.update({w: hop for w in frontier})
        found.update({(v, w): k for w, k in level.items()})
    return found


def test_counts_and_degrees(four):
    assert four.vertices.filter("role = 'postdoc'").count() == 1
    assert four.edges.filter("src > dst").count() == 1
    degrees = four.outer_join_vertices(four.out_degrees(), {"out_degree": F.lit(0)}).vertices
    assert rows(degrees, "id", "out_degree") == {(5, 2), (3, 1), (2, 1), (7, 0)}
    assert four.triplets().count() == 4


def test_triangles_and_component(four):
    assert rows(G.triangle_counts(four), "id", "triangles") == {(3, 1), (5, 1), (7, 1), (2, 0)}
    assert rows(G.connected_components(four), "id", "component") == {(3, 2), (5, 2), (7, 2), (2, 2)}


def test_default_vertex_subgraph_and_mask(six):
    assert rows(six.vertices.filter("id = 0"), "name", "role") == {("nobody", "missing")}
    valid = six.subgraph(F.col("role") != "missing")
    assert valid.vertices.count() == 5 and valid.edges.count() == 4
    labelled = G.PropertyGraph(G.connected_components(six), six.edges).mask(valid)
    assert rows(labelled.vertices, "id", "component") == {(v, 0) for v in (2, 3, 4, 5, 7)}


def test_reach_levels(four):
    expected = {(2, 2, 1), (2, 5, 2), (2, 3, 3), (2, 7, 3), (5, 5, 1), (5, 3, 2), (5, 7, 2), (3, 3, 1), (3, 7, 2), (7, 7, 1)}
    assert rows(R.reach(four, 4), "id", "member", "level") == expected


def test_paths_into_vertices(six):
    found = rows(R.simple_paths(six, 2), "id", "path")
    assert found == {
        (7, "3|7"), (7, "5|7"), (7, "5|3|7"), (7, "2|5|7"), (3, "5|3"), (3, "2|5|3"),
        (5, "2|5"), (0, "4|0"), (0, "5|0"), (0, "2|5|0"),
    }


@pytest.mark.parametrize("chunk_rows", [1_000_000, 3])
def test_reach_and_facts_match_brute_force_with_a_hub(spark, chunk_rows):
    graph, pairs = random_graph(spark, 40, 110, seed=1, hub_share=0.33)
    by_hand = levels_by_hand(40, pairs, 3)
    found = {(a, b): k for a, b, k in rows(R.reach(graph, 3, chunk_rows=chunk_rows), "id", "member", "level")}
    assert found == by_hand
    facts = {(v, f"e{a}-{b}", k + 1) for (v, u), k in levels_by_hand(40, pairs, 2).items() for a, b in pairs if a == u}
    assert rows(R.edge_facts(graph, 3, chunk_rows=chunk_rows), "id", "fact", "level") == facts
    inward = {(a, b): k for a, b, k in rows(R.reach(graph, 3, "in"), "id", "member", "level")}
    assert inward == levels_by_hand(40, {(b, a) for a, b in pairs}, 3)


def test_facts_shared_by_several_sources_keep_the_least_level(spark):
    vertices = spark.range(4)
    edges = spark.createDataFrame([(0, 1, "same"), (1, 2, "same"), (2, 3, "other")], "src bigint, dst bigint, fact string")
    found = rows(R.edge_facts(G.PropertyGraph(vertices, edges), 3), "id", "fact", "level")
    assert found == {(0, "same", 2), (0, "other", 4), (1, "same", 2), (1, "other", 3), (2, "other", 2)}


def test_reach_grows_with_rounds_and_cap_prefers_near_members(spark):
    graph, _ = random_graph(spark, 30, 80, seed=2)
    two, three = R.reach(graph, 2), R.reach(graph, 3)
    assert rows(two, "id", "member") <= rows(three, "id", "member")
    kept = R.capped(three, 4).collect()
    per_vertex = defaultdict(list)
    for r in kept:
        per_vertex[r["id"]].append((r["level"], r["member"]))
    everything = defaultdict(list)
    for r in three.collect():
        everything[r["id"]].append((r["level"], r["member"]))
    assert {v: sorted(x) for v, x in per_vertex.items()} == {v: sorted(x)[:4] for v, x in everything.items()}


def components_by_hand(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(v, find(v)) for v in range(n)}


def test_components_of_random_graph_and_long_chain(spark):
    graph, pairs = random_graph(spark, 120, 90, seed=3)
    assert rows(G.connected_components(graph), "id", "component") == components_by_hand(120, pairs)
    chain = spark.range(1, 300).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    labels = G.connected_components(G.PropertyGraph(spark.range(301), chain))
    assert rows(labels.filter("id < 300"), "component") == {(0,)}
    assert rows(labels.filter("id = 300"), "component") == {(300,)}


@pytest.mark.parametrize("chunk_rows", [1_000_000, 4])
def test_shortest_paths_match_brute_force(spark, chunk_rows):
    graph, pairs = random_graph(spark, 40, 100, seed=4, hub_share=0.3)
    weighted = graph.map_edges(weight=((F.col("src") * 7 + F.col("dst") * 3) % 11 + 1).cast("double"))
    best = {0: 0.0}
    for _ in range(40):
        for a, b in pairs:
            if a in best:
                best[b] = min(best.get(b, float("inf")), best[a] + (a * 7 + b * 3) % 11 + 1)
    found = dict(rows(G.shortest_paths(weighted, 0, "weight", chunk_rows=chunk_rows), "id", "distance"))
    assert found == {v: best.get(v, float("inf")) for v in range(40)}


def test_pagerank_reaches_the_fixed_point_with_hub_chunks(spark):
    graph, pairs = random_graph(spark, 30, 90, seed=5, hub_share=0.3)
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    rank = dict.fromkeys(range(30), 0.15)
    for _ in range(200):
        fresh = dict.fromkeys(range(30), 0.15)
        for a, targets in out.items():
            for b in targets:
                fresh[b] += 0.85 * rank[a] / len(targets)
        rank = fresh
    for chunk_rows in (1_000_000, 4):
        found = dict(rows(G.pagerank(graph, tolerance=1e-5, chunk_rows=chunk_rows), "id", "rank"))
        assert all(abs(found[v] - rank[v]) < 1e-3 for v in rank)


def test_triangles_match_brute_force(spark):
    graph, pairs = random_graph(spark, 30, 150, seed=6, hub_share=0.2)
    simple = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    counts = dict.fromkeys(range(30), 0)
    for a, b in simple:
        for c in range(b + 1, 30):
            if (a, c) in simple and (b, c) in simple:
                for v in (a, b, c):
                    counts[v] += 1
    found = dict(rows(G.triangle_counts(graph), "id", "triangles"))
    assert found == counts and sum(found.values()) % 3 == 0


def test_skewed_join_is_split_at_run_time(spark):
    """A third of all frontier rows meet one member; AQE must split it and lose nothing."""
    graph, pairs = random_graph(spark, 60, 300, seed=7, hub_share=0.34)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {(a, b): k for a, b, k in rows(R.reach(graph, 3), "id", "member", "level")}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == levels_by_hand(60, pairs, 3)


def test_edge_list_lines(spark):
    lines = spark.createDataFrame([("# comment",), ("2 1",), ("1 2",), ("3 3",), ("x 4",), ("",)], "value string")
    assert rows(G.load_edge_list(lines), "src", "dst") == {(2, 1), (1, 2), (3, 3)}
    assert rows(G.load_edge_list(lines, canonical=True), "src", "dst") == {(1, 2)}


def test_messages_to_both_ends_and_join_back(four):
    sums = four.map_vertices(age=F.col("id").cast("double")).aggregate_messages(
        {"n": F.count, "total": F.sum}, to_dst=F.col("src_age"), to_src=F.col("dst_age")
    )
    assert rows(sums, "id", "n", "total") == {(7, 2, 8.0), (3, 2, 12.0), (5, 3, 12.0), (2, 1, 5.0)}
    joined = four.join_vertices(sums.filter("n = 3"), "role", F.lit("hub"))
    assert rows(joined.vertices, "id", "role") == {(3, "student"), (7, "postdoc"), (5, "hub"), (2, "prof")}


def test_silent_edges_are_dropped_before_the_shuffle(spark, monkeypatch):
    """Only own states and edges that send are aggregated: a source in a star of silent vertices."""
    from quillmesh.operators import graph as module

    plans, plain = [], module.materialise
    keep = lambda df, label="table": (label == "state" and plans.append(df)) or plain(df, label)
    monkeypatch.setattr(module, "materialise", keep)
    edges = spark.createDataFrame([(0, v, 1.0) for v in range(1, 6)] + [(v, 0, 1.0) for v in range(1, 6)], "src bigint, dst bigint, weight double")
    vertices = spark.createDataFrame([(v,) for v in range(6)], "id bigint")
    found = module.shortest_paths(module.PropertyGraph(vertices, edges), 0, "weight", cut_every=1)
    assert sorted(map(tuple, found.collect())) == [(0, 0.0)] + [(v, 1.0) for v in range(1, 6)]
    first = plans[1]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"own#\d+ OR", first)
