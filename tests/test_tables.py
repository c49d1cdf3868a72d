"""Cleaning, encoding, scaling, sampling, ordering, readers and sinks on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.functions import vectors as V
from quillmesh.functions.tables import LongFields
from quillmesh.operators import cleansing as C
from quillmesh.operators import encoding as E
from quillmesh.operators import ordering as O
from quillmesh.operators import sampling as B
from quillmesh.operators import scaling as Z
from quillmesh.operators.lookup import encode_from, lookup_join
from quillmesh.session import scratch_path
from quillmesh.sources import readers as RD
from quillmesh.sources import writers as WR


def lines(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def one(df):
    return tuple(df.first())


def test_text_cleaning(spark):
    df = spark.createDataFrame([("", "12x"), ("7", "3.5")], "a string, b string")
    out = df.select(S.empty_to_zero(F.col("a")), S.safe_double(F.col("b")), S.prefix_number(F.col("b"), 2)).collect()
    assert [tuple(r) for r in out] == [("0", 0.0, 12.0), ("7", 3.5, 3.0)]


def test_positions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert C.drop_columns_at(df, [0, 2]).columns == ["b", "d"]
    assert C.keep_columns_at(df, [4, 5], shift=3).columns == ["b", "c"]
    arr = F.array("a", "b", "c", "d")
    assert one(df.select(S.drop_positions(arr, [1, 2]), S.keep_positions(arr, [3, 0]))) == ([1, 4], [4, 1])


def test_quarantine_and_markers(spark):
    df = spark.createDataFrame([("1", "2"), ("x", "3"), ("4", None), (None, "?")], "src string, dst string")
    good, bad = C.quarantine(df, ["src", "dst"])
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and bad.count() == 3
    assert C.drop_marked(df, ["dst"]).count() == 3


def test_level_maps(spark):
    df = spark.createDataFrame([("b:2 a:1", "b:1 c:5")], "x string, y string")
    merged = S.merge_smallest(S.parse_levels(F.col("x")), S.parse_levels(F.col("y")))
    assert one(df.select(S.pack_levels(merged))) == ("a:1 b:1 c:5",)


def test_kernels_by_hand(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    values = one(df.select(*[V.kernel(n)(a, b) for n in ("linear", "polynomial", "gaussian", "no such")]))
    assert values == pytest.approx((11.0, 144.0, 2.718281828459045**-4, 11.0))


def test_vocabulary_codes_and_unknowns(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None)], "p string, q string")
    codes = {tuple(r) for r in E.vocabularies(df, ["p", "q"]).collect()}
    assert codes == {("p", "a", 0), ("p", "b", 1), ("q", "x", 0)}
    other = spark.createDataFrame([("b",), ("z",)], "p string")
    encoded = encode_from(other, ["p"], E.category_index(df, "p"), "value", "code", default=-1)
    assert sorted(r[0] for r in encoded.collect()) == [-1, 1]
    with pytest.raises(ValueError):
        E.vocabulary_list(df, "p", max_values=1)


def test_lookup_join_leaves_broadcasts_to_sparks_size_check(spark):
    left = spark.range(50)
    right = spark.range(50).select("id", F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = lookup_join(left, right, "id")
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scaling_with_training_stats_and_constant_column(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    test = spark.createDataFrame([(5.0, 9.0)], "x double, k double")
    stats = Z.fit_stats(train, ["x", "k"])
    assert one(Z.scale(test, ["x", "k"], "z_score", stats)) == (3.0, 0.0)
    assert one(Z.scale(test, ["x", "k"], "min_max", stats)) == (2.0, 0.0)
    assert one(Z.scale(train.limit(1), ["x"], "thousand_steps", stats))[0] == 0.0


def test_dense_index_over_many_slices(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v * 3,) for v in values], "k bigint")
    out = O.dense_index(df, ["k"], slices=13).collect()
    assert sorted((r["row_index"], r["k"]) for r in out) == [(i, i * 3) for i in range(1000)]
    assert O.dense_index(df.limit(0), ["k"]).count() == 0


def test_prefix_sums_over_slices(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "k int, m int")
    total, expected = 0, {}
    for i in range(500):
        total += i % 7
        expected[i] = total
    assert {r["k"]: r["cum_m"] for r in O.prefix_sums(df, "k", ["m"], slices=9).collect()} == expected


def test_consecutive_pairs_of_a_hot_key(spark):
    chance = random.Random(2)
    data = [(0 if chance.random() < 0.4 else chance.randrange(1, 9), t, float(chance.randrange(50)) if t % 11 else None) for t in range(400)]
    df = spark.createDataFrame(data, "user int, t int, v double")
    found = O.consecutive_pairs(df, "user", ["t"], "v", slices=16)
    expected, last = {}, {}
    for user, t, v in data:
        if user in last:
            expected[(user, t)] = (last[user], v)
        last[user] = v
    assert {(r["user"], r["t"]): (r["previous"], r["current"]) for r in found.collect()} == expected


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_consecutive_pairs_of_one_key_in_many_slices(spark, slices):
    # one key holds all rows but those of two single ones; the null key is a key too
    data = [(None, t, t * t % 13 if t % 5 else None) for t in range(90)] + [(1, 3, 1), (2, 4, 2)]
    df = spark.createDataFrame(data, "user int, t int, v int")
    found = O.consecutive_pairs(df, "user", ["t"], "v", slices=slices).collect()
    values = [v for user, _, v in data if user is None]
    assert sorted((r["t"], r["previous"], r["current"]) for r in found) == [(t, values[t - 1], values[t]) for t in range(1, 90)]
    assert {r["user"] for r in found} == {None}
    used = O._range_slices(df, ["user", "t"], slices).select("__slice").distinct().count()
    assert used >= min(slices, 30)
    assert O.consecutive_pairs(df.limit(0), "user", ["t"], "v", slices=slices).count() == 0


def test_table_function_from_frames_and_sql(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, None, None), (None, "y", 3)], "id int, a string, b int")
    wanted = sorted(((i, f, v) for i, a, b in [(1, "x", "2"), (2, None, None), (None, "y", "3")] for f, v in (("a", a), ("b", b))), key=str)
    found = LongFields(df.asTable())
    assert found.columns == ["id", "field", "value"] and sorted(map(tuple, found.collect()), key=str) == wanted
    spark.udtf.register("long_fields", LongFields)
    df.createOrReplaceTempView("long_fields_input")
    by_sql = spark.sql("SELECT * FROM long_fields(TABLE(long_fields_input))")
    assert sorted(map(tuple, by_sql.collect()), key=str) == wanted
    assert LongFields(df.select("id").asTable()).count() == 0 and LongFields(df.limit(0).asTable()).count() == 0
    # 5,000 rows in three partitions stay where they are
    many = spark.range(0, 5000, 1, 3).select("id", (F.col("id") * 2).alias("twice"))
    out = LongFields(many.asTable()).withColumn("part", F.spark_partition_id())
    assert out.filter("cast(value as long) = 2 * id").count() == 5000 and out.select("part").distinct().count() == 3


def test_libsvm_with_and_without_width(spark):
    path = scratch_path(spark, "libsvm-width")
    lines(spark, "1 1:2.0 4:1.5", "0 2:1.0", "1").write.text(path)
    for width, size in ((None, 4), (6, 6)):
        rows = RD.read_libsvm(spark, path, width).collect()
        assert {r["features"].size for r in rows} == {size}
        assert sorted((r["label"], r["features"].toArray().sum()) for r in rows) == [(0.0, 1.0), (1.0, 0.0), (1.0, 3.5)]


def test_hash_split_is_a_partition_whatever_the_layout(spark):
    df = spark.range(2000)
    part = B.hash_part(F.col("id"), [0.7, 0.2, 0.1], seed=3)
    a = {r["id"]: r["p"] for r in df.select("id", part.alias("p")).collect()}
    b = {r["id"]: r["p"] for r in df.repartition(7).select("id", part.alias("p")).collect()}
    assert a == b
    shares = [sum(1 for p in a.values() if p == i) / 2000 for i in range(3)]
    assert shares == pytest.approx([0.7, 0.2, 0.1], abs=0.04)


def test_balancing(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "id bigint, label int")
    assert B.majority_ratio(df, "label") == 9.0
    raised = B.oversample_by_key(df, "label", "id", 9.0)
    assert one(B.class_balance(raised, "label"))[:2] == (90, 90)
    assert B.duplicate_class(df, "label").count() == 110
    lowered = B.undersample_by_key(df, "label", "id", 0.5)
    assert lowered.filter("label = 1").count() == 10 and 25 < lowered.filter("label = 0").count() < 65


def test_draws_do_not_depend_on_the_layout(spark):
    df = spark.range(300).withColumn("v", F.col("id") * 2)
    a = B.seeded_draws(df, "id", ["v"], 6).collect()
    b = B.seeded_draws(df.repartition(5), "id", ["v"], 6).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 6
    assert all(r["v"] == 2 * r["id"] for r in a)


def test_line_parsers(spark):
    assert one(lines(spark, "1,2,,").select(RD.split_fields(F.col("value")))) == (["1", "2", "", ""],)
    assert one(RD.dense_points(lines(spark, "1 2.5  3"))) == (1.0, [2.5, 3.0])
    assert one(RD.dense_points(lines(spark, "2.5 3"), labelled=False)) == ([2.5, 3.0],)
    assert one(RD.labelled_points(lines(spark, "0,1 2 x"))) == (0.0, [1.0, 2.0, None])
    assert one(RD.point_literals(lines(spark, "(1.5, [2, 3.5])"))) == (1.5, [2.0, 3.5])
    assert [tuple(r) for r in RD.vertices_with_tail(lines(spark, "1,a,b", "2", "x,y")).collect()] == [(1, ["a", "b"]), (2, [])]
    sep = RD.CTRL_A
    facts = RD.fact_edges(lines(spark, sep.join(["1", "2", "a", "b", "c", "d e"]), sep.join(["x", "2", "a", "b", "c", "d"]), "1"))
    assert [tuple(r) for r in facts.collect()] == [(1, 2, "1:2:a:b:c:d^e")]


def test_kept_rows_are_written_in_parallel_unless_one_file_is_asked_for(spark):
    df = spark.range(0, 100, 1, 4)
    one_file, many = scratch_path(spark, "one"), scratch_path(spark, "many")
    WR.write_kept(df, one_file, one_file=True)
    WR.write_kept(df, many)
    assert len(spark.read.parquet(one_file).inputFiles()) == 1 and len(spark.read.parquet(many).inputFiles()) == 4
    assert spark.read.parquet(many).count() == 100


def test_lines_refuse_a_field_with_the_separator(spark):
    df = spark.createDataFrame([("a,b", "c")], "x string, y string")
    with pytest.raises(Exception, match="holds a separator"):
        WR.write_lines(df, scratch_path(spark, "lines"), ["x", "y"])
    WR.write_lines(df, scratch_path(spark, "lines"), ["x", "y"], sep="|")


def test_delimited_reader_keeps_empty_tail(spark):
    path = scratch_path(spark, "csv")
    lines(spark, "1,,", "2,x,").write.text(path)
    back = RD.read_delimited(spark, path, "a int, b string, c string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, None, None), (2, "x", None)]


def test_draws_beyond_one_pass_and_on_an_empty_table(spark):
    df = spark.range(40)
    many = {r["draw"]: r["id"] for r in B.seeded_draws(df, "id", [], 70).collect()}
    few = {r["draw"]: r["id"] for r in B.seeded_draws(df, "id", [], 5).collect()}
    assert sorted(many) == list(range(1, 71)) and few == {i: many[i] for i in range(1, 6)}
    assert B.seeded_draws(df.limit(0), "id", [], 3).count() == 0
