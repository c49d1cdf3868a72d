"""Readers (S1-S14) and sinks (K1, K3, K4, K6, K7), as round trips of the driver tables through files."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillmesh.operators.lookup import encode_from
from quillmesh.operators.graph import load_edge_list
from quillmesh.operators.learning import as_vectors
from quillmesh.plans.bindings import FEATURES, order_features, order_relations, with_features, with_graph
from quillmesh.plans.registry import query
from quillmesh.plans.relational_queries import RATINGS_SQL, ratings
from quillmesh.session import scratch_path
from quillmesh.sources import readers as RD
from quillmesh.sources import writers as WR


def as_text(t, df, columns, sep=","):
    """Write rows as delimited lines and return the folder."""
    path = scratch_path(t.spark, "text")
    WR.write_lines(df, path, columns, sep)
    return path


def as_lines(t, df, value):
    path = scratch_path(t.spark, "lines")
    df.select(value.alias("value")).write.text(path)
    return RD.read_lines(t.spark, path)


@query(
    "s1_text_lines",
    "select value, count(*) as n from (select unnest(string_split(text, chr(10))) as value from documents) group by value",
)
def s1(t):
    path = scratch_path(t.spark, "documents")
    t.documents.select("text").write.text(path)
    return RD.read_lines(t.spark, f"{path}/*").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s2_comma_fields",
    """select c_custkey as id, c_name as name, 6 as fields, c_acctbal as balance from customer""",
)
def s2(t):
    """Two empty trailing fields stay fields."""
    padded = t.customer.withColumn("empty", F.lit("")).withColumn("last", F.lit(""))
    path = as_text(t, padded, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "empty", "last"])
    parts = RD.split_fields(F.col("value"))
    return RD.read_lines(t.spark, path).select(
        parts[0].cast("bigint").alias("id"),
        parts[1].alias("name"),
        F.size(parts).alias("fields"),
        parts[3].cast("double").alias("balance"),
    )


@query("s2_comma_schema", "select c_custkey as id, c_name as name, c_nationkey as nation, c_acctbal as balance from customer")
def s2_schema(t):
    path = as_text(t, t.customer, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    return RD.read_delimited(t.spark, path, "id bigint, name string, nation int, balance double")


@query("s3_ctrl_a_fields", "select o_orderkey as id, o_custkey as customer, o_totalprice as total, o_orderpriority as priority from orders")
def s3(t):
    path = as_text(t, t.orders, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], sep=RD.CTRL_A)
    return RD.read_ctrl_a(t.spark, path, "id bigint, customer bigint, total double, priority string")


@query("s4_census_fields", "select n_nationkey as code, n_name as name, n_regionkey as region from nation")
def s4(t):
    path = as_text(t, t.nation, ["n_nationkey", "n_name", "n_regionkey"], sep=", ")
    return RD.read_census(t.spark, path, "code int, name string, region int")


POINTS_SQL = """select label, n_lines, quantity, round(total, 2) as total, width, count(*) as n from
    (select label, n_lines, quantity, total, 3 as width from features) group by 1, 2, 3, 4, 5"""


def point_summary(points):
    x = F.col("features")
    shown = points.select(
        "label", x[0].alias("n_lines"), x[1].alias("quantity"), F.round(x[2], 2).alias("total"), F.size(x).alias("width")
    )
    return shown.groupBy(*shown.columns).agg(F.count(F.lit(1)).alias("n"))


@query("s5_dense_points", with_features(POINTS_SQL))
def s5(t):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("label", "n_lines", "quantity", "total")])
    return point_summary(RD.dense_points(as_lines(t, order_features(t), line)))


@query("s6_labelled_points", with_features(POINTS_SQL))
def s6(t):
    tail = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n_lines", "quantity", "total")])
    return point_summary(RD.labelled_points(as_lines(t, order_features(t), F.concat_ws(",", F.col("label").cast("string"), tail))))


LIBSVM_SQL = """select label, count(*) as n, sum(n_lines) as n_lines, sum(quantity) as quantity, round(sum(total), 2) as total,
    6 as width from features group by label"""


def libsvm_summary(t, width):
    path = scratch_path(t.spark, "libsvm")
    WR.write_libsvm(as_vectors(order_features(t), FEATURES), path)
    x = vector_to_array("features")
    rows = RD.read_libsvm(t.spark, path, width).select("label", x.alias("x"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x")[0]).alias("n_lines"),
        F.sum(F.col("x")[1]).alias("quantity"),
        F.round(F.sum(F.col("x")[5]), 2).alias("total"),
        F.max(F.size("x")).alias("width"),
    )


@query("s7_libsvm_read", with_features(LIBSVM_SQL))
def s7(t):
    return libsvm_summary(t, len(FEATURES))


@query("s7_libsvm_read_any_width", with_features(LIBSVM_SQL))
def s7_any_width(t):
    return libsvm_summary(t, None)


@query("s8_point_literals", with_features(POINTS_SQL))
def s8(t):
    inner = F.concat_ws(",", *[F.col(c).cast("string") for c in ("n_lines", "quantity", "total")])
    line = F.concat(F.lit("("), F.col("label").cast("string"), F.lit(",["), inner, F.lit("])"))
    return point_summary(RD.point_literals(as_lines(t, order_features(t), line)))


def edge_lines(t):
    return as_lines(t, order_relations(t), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")))


@query("s9_edge_list", with_graph("select src, dst, count(*) as n from facts group by src, dst"))
def s9(t):
    return load_edge_list(edge_lines(t)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("s9_canonical_edge_list", with_graph("select distinct least(src, dst) as src, greatest(src, dst) as dst from edges where src <> dst"))
def s9_canonical(t):
    return load_edge_list(edge_lines(t), canonical=True)


@query(
    "s10_vertices_with_tail",
    """select c_custkey as id, case when c_acctbal < 0 then 1 else 2 end as n_attrs,
         case when c_acctbal < 0 then c_name else c_name || '|' || c_mktsegment end as attrs from customer""",
)
def s10(t):
    name = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.concat_ws(",", "c_name", "c_mktsegment"))
    lines = as_lines(t, t.customer, F.concat_ws(",", F.col("c_custkey").cast("string"), name))
    vertices = RD.vertices_with_tail(lines)
    return vertices.select("id", F.size("attrs").alias("n_attrs"), F.array_join("attrs", "|").alias("attrs"))


@query(
    "s11_fact_edges",
    """select o_custkey as src, o_orderkey as dst, o_custkey::varchar || ':' || o_orderkey::varchar || ':' || o_orderstatus
         || ':a:b:' || replace(o_orderpriority, ' ', '^') as fact from orders""",
)
def s11(t):
    padded = t.orders.withColumn("a", F.lit("a")).withColumn("b", F.lit("b"))
    path = as_text(t, padded, ["o_custkey", "o_orderkey", "o_orderstatus", "a", "b", "o_orderpriority"], sep=RD.CTRL_A)
    return RD.fact_edges(RD.read_lines(t.spark, path))


@query(
    "s12_ratings",
    f"""with {RATINGS_SQL} select "user"::integer as user, item::integer as item, round(rate, 4) as rate from ratings""",
)
def s12(t):
    path = as_text(t, ratings(t), ["user", "item", "rate"])
    return RD.read_ratings(t.spark, path).select("user", "item", F.round("rate", 4).alias("rate"))


@query(
    "s13_literal_table",
    """with l(priority, weight) as (values ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 2), ('5-LOW', 1))
       select priority, weight, count(*) as n from orders join l on priority = o_orderpriority group by 1, 2""",
)
def s13(t):
    rows = [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 2), ("5-LOW", 1)]
    literal = t.spark.createDataFrame(rows, "priority string, weight int")
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(literal, "priority").select("priority", "weight", "n")


@query(
    "s14_lookup_file",
    "select s_suppkey, (s_nationkey + 1)::double as home from supplier",
)
def s14(t):
    """A lookup file ``code,name`` applied to names, with a size-checked broadcast."""
    lines = as_lines(t, t.nation, F.concat_ws(",", (F.col("n_nationkey") + 1).cast("string"), "n_name"))
    named = t.supplier.select("s_suppkey", F.concat(F.lit("NATION_"), "s_nationkey").alias("home"))
    return encode_from(named, ["home"], RD.dictionary_from_lines(lines), "name", "code", default=0.0)


PAIRS_SQL = """select '(' || o_custkey::varchar || ',' || n::varchar || ')' as value
    from (select o_custkey, count(*) as n from orders group by 1)"""


def saved_pairs(t):
    path = scratch_path(t.spark, "pairs")
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    WR.write_pairs(counts, path, "o_custkey", "n")
    return path


@query("k1_text_sink", PAIRS_SQL)
def k1(t):
    return RD.read_lines(t.spark, saved_pairs(t))


@query(
    "k3_single_file_sink",
    "select o_orderkey, o_custkey, 1 as files from orders where o_totalprice > 250000",
)
def k3(t):
    path = scratch_path(t.spark, "single")
    chosen = t.orders.filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    WR.write_kept(chosen, path, one_file=True)
    back = t.spark.read.parquet(path)
    return back.withColumn("files", F.lit(len(back.inputFiles())))


@query("k4_strip_parentheses", f"select replace(replace(value, '(', ''), ')', '') as value from ({PAIRS_SQL})")
def k4(t):
    target = scratch_path(t.spark, "stripped")
    WR.strip_parentheses(t.spark, saved_pairs(t), target)
    return RD.read_lines(t.spark, target)


@query("k6_preview", "select event_id, user_id, event_type from events order by event_id limit 5")
def k6(t):
    return WR.preview(t.events.select("event_id", "user_id", "event_type"), ["event_id"], 5)


@query("k7_libsvm_export", with_features("select label, count(*) as n, count(*) * 6 as entries from features group by label"))
def k7(t):
    """The exported lines, counted as text: one ``position:value`` entry per slot of the dense vectors."""
    path = scratch_path(t.spark, "libsvm")
    WR.write_libsvm(as_vectors(order_features(t), FEATURES), path)
    parts = F.split(F.trim("value"), " ")
    lines = RD.read_lines(t.spark, path).select(parts[0].cast("double").alias("label"), (F.size(parts) - 1).alias("k"))
    return lines.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("entries"))


REJECTS = {
    "edges": (RD.edge_fields, "concat_ws(' ', if(o_orderkey % 7 = 0, 'x', '') || o_custkey, if(o_orderkey % 11 = 0, null, o_orderkey))", "o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0"),
    "vertices": (RD.vertex_fields, "concat_ws(',', if(o_orderkey % 5 = 0, 'n/a', cast(o_custkey as string)), o_orderpriority, '')", "o_orderkey % 5 <> 0"),
    "facts": (RD.fact_fields, "concat_ws(char(1), o_custkey, o_orderkey, o_orderstatus, 'a', 'b', if(o_orderkey % 3 = 0, null, o_orderpriority))", "o_orderkey % 3 <> 0"),
    "dictionary": (RD.dictionary_fields, "concat_ws(',', if(o_orderkey % 4 = 0, '', cast(o_custkey as string)), o_orderpriority)", "o_orderkey % 4 <> 0"),
}


@query(
    "s9_reader_rejects",
    " union all ".join(
        f"""select '{name}' as reader, count(*) as lines, count(*) filter ({good}) as good, count(*) filter (not ({good})) as rejected,
              count(*) filter ({good}) as rows_kept, count(*) filter (not ({good})) as lines_kept from orders"""
        for name, (_, _, good) in REJECTS.items()
    ),
)
def s9_rejects(t):
    """Edges, vertices, facts and dictionary lines with bad ones among them: every line is a row or a reject."""
    rows = []
    for name, (fields, line, _) in REJECTS.items():
        path = scratch_path(t.spark, "lines")
        t.orders.select(F.expr(line).alias("value")).write.text(path)
        lines = RD.read_lines(t.spark, path)
        loaded = RD.load_checked(lines, *fields())
        rows.append((name, lines.count(), loaded.n_good, loaded.n_rejected, loaded.good.count(), loaded.rejects.count()))
    return t.spark.createDataFrame(rows, "reader string, lines bigint, good bigint, rejected bigint, rows_kept bigint, lines_kept bigint")
