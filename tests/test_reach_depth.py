"""Reach queries at the reference's depth, on a chain where every hop finds one member more."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check_oracles import compare

# deepest level on a chain: rounds + 1
DEEPEST = {
    "g17_reach_set_deep": None, "g18_reach_levels_deep": 6, "g19_bidirectional_reach_deep": 6, "g20_edge_facts_deep": 5,
    "g21_capped_reach_deep": 5, "g21_capped_facts_deep": 5, "g22_members_and_facts_deep": 5,
    "g26_reach_with_attributes_deep": 6, "g27_hop_snapshots_deep": 5, "k2_snapshot_per_hop_deep": 5,
}


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("chain")
    spark.range(20).selectExpr(
        "id as c_custkey", "concat('c', id) as c_name", "0 as c_nationkey", "id * 1.5D as c_acctbal", "'seg' as c_mktsegment"
    ).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.range(10).selectExpr(
        "id + 1 as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "id * 2.5D as o_totalprice",
        "timestamp_ntz '2020-01-01 00:00:00' as o_orderdate", "'1-URGENT' as o_orderpriority",
    ).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("key", DEEPEST)
def test_chain_is_followed_to_the_reference_depth(spark, chain, key):
    connection = duckdb.connect()
    for name in ("customer", "orders"):
        connection.sql(f"create view {name} as select * from '{chain}/{name}.parquet/*.parquet'")
    df = entry_module.queries()[key](spark, chain)
    problem, _ = compare(df, connection, entry_module.oracle_sql()[key])
    assert not problem, problem
    rows = df.collect()
    if DEEPEST[key]:
        assert max(r["level"] for r in rows) == DEEPEST[key]
    else:
        assert max(r["members"] for r in rows) == 6
