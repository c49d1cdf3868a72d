"""Totals of the search on held graphs against the rows of the joins, and the deep queries without any pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import held_search as H
from quillmesh.operators import reach as R
from quillmesh.operators.graph import PropertyGraph
from quillmesh.operators.held_search import Totals
from quillmesh.plans.catalog import REGISTRY
from quillmesh.session import scratch_path


def own_totals():
    member = F.col("member")
    return Totals("n", {"added": member}, {"least": member}, {"greatest": member})


def rows(df):
    """Whole rows, in one order."""
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def random_graph(spark, seed, shared=False):
    """Loops, edges that come twice, null ends, vertices that come twice or not at all, ids far apart."""
    rng = random.Random(seed)
    ids = [-(1 << 40), -3, 0, *range(5, 30), 1 << 41]
    edges = []
    for k in range(70):
        ends = [None if rng.random() < 0.04 else rng.choice(ids) for _ in range(2)]
        edges.append((*ends, f"f{rng.randrange(30) if shared else k}"))
    edges += edges[:4]
    told = {e for a, b, _ in edges for e in (a, b)} - {7, 8}
    vertices = [(v,) for v in sorted(told - {None})] + [(None,), (9,), (9,), (1000,)]
    return PropertyGraph(
        spark.createDataFrame(vertices, "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint, fact string")
    )


def held_rows(spark, seed):
    """Values of members, several rows for some, none for others, with nulls."""
    rng = random.Random(seed)
    table = []
    for v in [None, -(1 << 40), *range(0, 30), 1 << 41]:
        for _ in range(rng.choice([0, 1, 1, 2])):
            group = None if v is None or v % 5 == 0 else "even" if v % 2 == 0 else "odd"
            table.append((v, group, None if rng.random() < 0.4 else rng.randrange(-50, 50), rng.choice(["é", "z", "B", "b", "", None])))
    return spark.createDataFrame(table, "id bigint, kind string, amount bigint, name string")


@pytest.fixture(params=["held", "joined"])
def both_forms(request, monkeypatch):
    """The search on a held graph, and the one for graphs that take too much."""
    if request.param == "joined":
        monkeypatch.setattr(H, "HELD_BYTES", 0)
    return request.param


@pytest.mark.parametrize("by", [None, "kind"])
def test_totals_are_those_of_the_rows(spark, by):
    graph, held = random_graph(spark, 1), held_rows(spark, 1)
    given = Totals("n", {"added": F.col("amount")}, {"least": F.col("name")}, {"greatest": F.col("amount")}, by, held)
    found = R.reach(graph, 3).cache()
    assert rows(R.reach(graph, 3, totals=given)) == rows(given.of(found))
    if by is None:
        assert rows(R.reach(graph, 3, totals=own_totals())) == rows(own_totals().of(found))
        assert rows(R.reach(graph, 2, "in", totals=own_totals())) == rows(own_totals().of(R.reach(graph, 2, "in")))
        assert rows(R.reach_both(graph, 3, totals=own_totals())) == rows(own_totals().of(R.reach_both(graph, 3)))


@pytest.mark.parametrize("shared", [False, True])
def test_totals_of_facts_and_of_members_with_facts(spark, both_forms, shared):
    graph = random_graph(spark, 3, shared)
    number = F.substring("fact", 2, 9).cast("long")
    facts = Totals("n", {"added": number}, {"least": F.col("fact")}, {"greatest": number})
    for rounds, direction in ((1, "out"), (3, "in")):
        plain = facts.of(R.edge_facts(graph, rounds, direction=direction))
        assert rows(R.edge_facts(graph, rounds, direction=direction, totals=facts)) == rows(plain)
    text = F.col("member")
    if both_forms == "joined":
        return
    mixed = Totals("n", {"letters": F.length(text)}, {"least": text}, {"greatest": text})
    again = [F.sum("n").alias("n"), F.sum("letters").alias("letters"), F.min("least").alias("least"), F.max("greatest").alias("greatest")]
    like_members = graph.edges.withColumn("fact", F.coalesce(F.col("src").cast("string"), "fact"))
    drawn = PropertyGraph(graph.vertices, like_members) if shared else graph
    plain = mixed.of(R.members_and_facts(drawn, 3))
    assert rows(R.members_and_facts(drawn, 3, totals=mixed).groupBy("id", "level").agg(*again)) == rows(plain)


def test_a_member_of_two_groups_counts_in_both(spark):
    graph = PropertyGraph(spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1, 2, "a")], "src bigint, dst bigint, fact string"))
    held = spark.createDataFrame([(2, "x"), (2, "y")], "id bigint, kind string")
    found = R.reach(graph, 1, totals=Totals("n", by="kind", held=held))
    assert {(r["id"], r["level"], r["kind"], r["n"]) for r in found.collect()} == {(1, 2, "x", 1), (1, 2, "y", 1), (2, 1, "x", 1), (2, 1, "y", 1)}


def test_sums_beyond_64_bits_are_not_wrapped(spark):
    big = (1 << 62) + 1
    graph = PropertyGraph(
        spark.createDataFrame([(0,), (big,), (big + 1,)], "id bigint"), spark.createDataFrame([(0, big), (0, big + 1)], "src bigint, dst bigint")
    )
    assert H.hold(graph.vertices, graph.edges, ("out",), own_totals()) is None


def test_hops_are_written_as_they_are_met(spark, both_forms):
    graph = random_graph(spark, 4)
    for rounds, direction in ((0, "out"), (3, "in")):
        path = scratch_path(spark, "hops")
        assert rows(R.reach(graph, rounds, direction, path=path)) == rows(R.reach(graph, rounds, direction))
    chain = PropertyGraph(spark.range(3).select("id"), spark.range(2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert rows(R.reach(chain, 9, path=scratch_path(spark, "hops"))) == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 1), (1, 2, 2), (2, 1, 2)]


def test_wide_frontiers_go_on_in_steps(spark, monkeypatch):
    """A hub's neighbours are looked at in several steps, and its members leave in several batches."""
    graph = random_graph(spark, 5)
    name = H.hold(graph.vertices, graph.edges, ("out",))
    monkeypatch.setattr(H, "_STEP", 3)
    walker = H._Walker(name.name, name.parts, name.ways)
    found = {(int(walker.ids[s]), int(walker.ids[m]), level) for s in range(len(walker.ids)) for level, members in walker.levels(s, 5) for m in members}
    assert found == {(r["id"], r["member"], r["level"]) for r in R.reach(graph, 4).filter("level > 1").collect()}
    monkeypatch.setattr(H, "_OUT_ROWS", 1)
    met = [members for _, members in walker.levels(0, 3)]
    parts = list(walker.pairs([0] * len(met), met))
    assert sum(p.num_rows for p in parts) == sum(map(len, met)) and max(p.num_rows for p in parts) <= 8


def test_marks_start_over(spark):
    graph = random_graph(spark, 6)
    held = H.hold(graph.vertices, graph.edges, ("out",))
    walker = H._Walker(held.name, held.parts, held.ways)
    first = [(k, sorted(m)) for k, m in walker.levels(3, 5)]
    walker.next = (1 << 30) + 5
    assert [(k, sorted(m)) for k, m in walker.levels(3, 5)] == first and walker.next < 1 << 30


DEEP = [
    "g17_reach_set_deep", "g18_reach_levels_deep", "g18_reach_profile", "g19_bidirectional_reach_deep", "g20_edge_facts_deep",
    "g20_edge_fact_profile", "g22_members_and_facts_deep", "g26_reach_with_attributes_deep", "g27_hop_snapshots_deep", "k2_snapshot_per_hop_deep",
]


@pytest.mark.parametrize("key", DEEP)
def test_deep_queries_shuffle_no_pairs(spark, tmp_path, monkeypatch, key):
    rng = random.Random(8)
    customers = [(k, f"name {k % 7}", rng.choice("ABC"), float(k)) for k in range(40)]
    orders = [(k, rng.randrange(40), "OF"[k % 2], rng.choice(["1-URGENT", "5-LOW"]), float(k)) for k in range(90)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double"
    spark.createDataFrame(orders, schema).write.parquet(f"{tmp_path}/orders.parquet")

    def hops(*_):
        raise AssertionError("pairs are packed to be shuffled")

    monkeypatch.setattr(R, "_packed_hops", hops)
    assert REGISTRY[key](spark, str(tmp_path)).count() > 0
