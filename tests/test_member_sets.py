"""Packed sets: what is packed comes back, and the least level of every pair is kept, in lists and bitmaps."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import member_sets as M
from quillmesh.operators import reach as R
from quillmesh.operators.graph import PropertyGraph


def sets(seed):
    """Sparse and dense sets, negative ids, several blocks, and one set far larger than the bytes held at a time."""
    rng = random.Random(seed)
    found = {(1, m) for m in range(0, 3000)} | {(2, m * 70_001) for m in range(500)} | {(3, -5), (3, 0), (-4, 7)}
    found |= {(5, rng.randrange(-(1 << 23), 1 << 23)) for _ in range(2000)} | {(6, (1 << 22) - 1), (6, 1 << 22)}
    return found | {(7, 2 * m + rng.randrange(2)) for m in range(4000)}


def test_packed_pairs_come_back(spark):
    pairs = sets(1)
    packed = M.pack(spark.createDataFrame([*sorted(pairs), (None, 1), (1, None)], "id bigint, member bigint"))
    assert sorted(map(tuple, M.unpack(packed).collect())) == sorted(pairs)
    assert packed.agg(F.sum(F.length("members"))).first()[0] < 3 * len(pairs) + 100


@pytest.mark.parametrize("held", [M._HELD_BYTES, 50])
def test_every_pair_keeps_its_least_level(spark, monkeypatch, held):
    monkeypatch.setattr(M, "_HELD_BYTES", held)
    tables, least = [], {}
    for level in (2, 1, 4):
        some = {p for p in sets(level) if random.Random(f"{p}{level}").random() < 0.6}
        tables.append(M.pack(spark.createDataFrame(sorted(some), "id bigint, member bigint")).withColumn("level", F.lit(level)))
        for pair in some:
            least[pair] = min(level, least.get(pair, 9))
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[0])
    found = M.unpack(M.least_levels(rows), "level").collect()
    assert len(found) == len(least) and {(r[0], r[1]): r[2] for r in found} == least
    fresh = M.unpack(M.least_levels(rows, 2)).collect()
    assert sorted(map(tuple, fresh)) == sorted(p for p, level in least.items() if level == 2)


def test_merging_holds_bounded_bytes_of_a_large_set():
    import pyarrow as pa

    offsets = M.np.arange(0, 1 << 20, 3)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 8), pa.array([0] * 8), pa.array([3] * 8, pa.int32()), pa.concat_arrays([M._encoded(M.np.zeros(1, int), offsets)] * 8)],
        names=["id", "block", "level", "members"],
    )
    wholes = list(M._whole_groups(iter([batch] * 40)))
    assert len(wholes) == 1 and wholes[0].nbytes < 8 * M._HELD_BYTES
    (merged,) = M._merged(wholes[0], 3)
    assert (M._decoded(merged.column("members"))[1] == offsets).all()


def test_a_hop_shuffles_packed_members(spark):
    """Three hops on a wide graph: a hop that shuffles pairs as rows writes many times the bytes of the packed ones."""
    vertices = spark.range(400)
    edges = vertices.selectExpr("id as src", "explode(transform(sequence(1, 10), k -> (id * 7 + k * k * 31) % 400)) as dst")
    graph = PropertyGraph(vertices, edges)
    hops = dict(R._packed_hops(graph, 3, "out", 1_000_000))
    pairs = R.reach(graph, 3).groupBy("level").count().collect()
    wide = {r["level"]: r["count"] for r in pairs}
    assert set(hops) == {2, 3, 4} and all(M.unpack(hops[n]).count() == wide[n] for n in hops)
    assert hops[3].agg(F.sum(F.length("members"))).first()[0] <= 2 * wide[3]


def test_members_and_facts_are_merged_only_where_a_fact_reads_like_a_member(spark):
    vertices = spark.range(4)
    for fact, shuffled in (("2", True), ("x", False)):
        edges = spark.createDataFrame([(0, 1, fact), (1, 2, "y"), (2, 3, "z")], "src bigint, dst bigint, fact string")
        found = R.members_and_facts(PropertyGraph(vertices, edges), 2)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Aggregate") == shuffled
        # fact "2" of vertex 0 comes at level 2, member 2 at level 3: once, at the least level
        of_zero = sorted((r["member"], r["level"]) for r in found.filter("id = 0").collect())
        assert of_zero == sorted([("0", 1), ("1", 2), (fact, 2), ("y", 3)] + ([] if fact == "2" else [("2", 3)]))


@pytest.mark.parametrize("key", ["g20_edge_facts_deep", "g26_reach_with_attributes_deep"])
def test_least_and_greatest_texts_are_found_without_sorting_all_rows(spark, tmp_path, key):
    import __spark_entry__ as entry_module

    spark.sql("select id as c_custkey, concat('c', 9 - id) as c_name, 0 as c_nationkey, 1.5D as c_acctbal, 's' as c_mktsegment from range(9)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select id + 1 as o_orderkey, nullif(id, 5) as o_custkey, 'F' as o_orderstatus, 2.5D as o_totalprice, timestamp_ntz '2020-01-01 00:00:00' as o_orderdate, '1-URGENT' as o_orderpriority from range(6)").write.parquet(f"{tmp_path}/orders.parquet")
    found = entry_module.queries()[key](spark, str(tmp_path))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    row = found.filter("id = 0").orderBy("level").collect()[-1]
    assert (row["least"], row["greatest"]) == (("3:4:4:F:1-URGENT",) * 2 if key.startswith("g20") else ("c4", "c4"))
