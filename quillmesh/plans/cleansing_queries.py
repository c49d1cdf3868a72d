"""Projection, filter and cleansing queries (P1-P17) and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.functions import vectors as V
from quillmesh.functions.tables import LongFields
from quillmesh.operators import cleansing as C
from quillmesh.operators.ordering import dense_index
from quillmesh.plans.bindings import FEATURES, order_features, with_features
from quillmesh.plans.registry import query


@query(
    "p1_drop_columns",
    "select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus from lineitem",
)
def p1(t):
    return C.drop_columns_at(t.lineitem, [1, 2, 5, *range(10, 11)])


@query(
    "p1_drop_array_positions",
    "select p_partkey, p_brand || '|' || p_size::varchar as kept from part",
)
def p1_array(t):
    cells = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.array_join(S.drop_positions(cells, [0, 2]), "|").alias("kept"))


@query("p2_keep_columns", "select l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def p2(t):
    return C.keep_columns_at(t.lineitem, range(7, 11), shift=3)


@query(
    "p2_keep_array_positions",
    "select p_partkey, p_type || '|' || p_name as kept from part",
)
def p2_array(t):
    cells = F.array("p_name", "p_brand", "p_type")
    return t.part.select("p_partkey", F.array_join(S.keep_positions(cells, [5, 3], shift=3), "|").alias("kept"))


@query(
    "p3_empty_to_zero",
    """select page_id, coalesce(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), '0') as page_number from pages""",
)
def p3(t):
    return t.pages.select(
        "page_id", S.empty_to_zero(F.regexp_extract("url", r"page=([0-9]+)", 1)).alias("page_number")
    )


@query(
    "p4_safe_cast",
    """select p_partkey, coalesce(try_cast(p_name as double), 0) as from_name,
         coalesce(try_cast(substr(p_brand, 7) as double), 0) as from_brand from part""",
)
def p4(t):
    return t.part.select(
        "p_partkey",
        S.safe_double(F.col("p_name")).alias("from_name"),
        S.safe_double(F.substring("p_brand", 7, 20)).alias("from_brand"),
    )


@query(
    "p5_prefix_feature",
    """select c_custkey, coalesce(try_cast(substr(c_custkey::varchar, 1, 3) as double), 0) as key_prefix,
         coalesce(try_cast(substr(c_name, 1, 3) as double), 0) as name_prefix from customer""",
)
def p5(t):
    return t.customer.select(
        "c_custkey",
        S.prefix_number(F.col("c_custkey").cast("string"), 3).alias("key_prefix"),
        S.prefix_number(F.col("c_name"), 3).alias("name_prefix"),
    )


@query("p6_drop_marked_rows", "select page_id, url from pages where url not like '%?%'")
def p6(t):
    return C.drop_marked(t.pages.select("page_id", "url"), ["url"])


@query(
    "p7_quarantine_bad_keys",
    """select page_id, target, case when try_cast(target as bigint) is null then 'rejected' else 'kept' end as status
       from (select page_id, regexp_extract(url, 'page=([0-9]+)', 1) as target from pages)""",
)
def p7(t):
    edges = t.pages.select("page_id", F.regexp_extract("url", r"page=([0-9]+)", 1).alias("target"))
    kept, rejected = C.quarantine(edges, ["page_id", "target"])
    kept = kept.withColumn("target", F.col("target").cast("string")).withColumn("status", F.lit("kept"))
    return kept.unionByName(rejected.withColumn("status", F.lit("rejected")))


@query("p8_flag_filter", "select event_id, user_id, value from events where event_type = 'purchase'")
def p8(t):
    return t.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "value")


@query(
    "p9_class_label",
    "select o_orderkey, case when o_orderstatus in ('O', 'P') then 0 else 1 end as label from orders",
)
def p9(t):
    return t.orders.select("o_orderkey", S.class_label(F.col("o_orderstatus"), ["O", "P"]).alias("label"))


@query("p10_signed_label", "select doc_id, quality * 2 - 1 as signed from labels")
def p10(t):
    return t.labels.select("doc_id", S.signed_label(F.col("quality")).alias("signed"))


@query(
    "p11_reshape_layout",
    """select o_custkey as f0, o_totalprice as f1, 1 as answered, 1 as response from orders where o_orderstatus = 'F'
       union all select o_custkey, o_totalprice, 1, 0 from orders where o_orderstatus <> 'F'""",
)
def p11(t):
    """Two sources brought to one layout whose last two columns are the flag and the response."""
    layout = t.orders.select(F.col("o_custkey").alias("f0"), F.col("o_totalprice").alias("f1"), "o_orderstatus")
    finished = layout.filter("o_orderstatus = 'F'").select("f0", "f1", F.lit(1).alias("answered"), F.lit(1).alias("response"))
    others = layout.filter("o_orderstatus <> 'F'").select("f0", "f1", F.lit(1).alias("answered"), F.lit(0).alias("response"))
    return finished.unionByName(others)


@query(
    "p12_dense_features",
    with_features("""select id, label, 6 as width, n_lines as first_feature, total as last_feature,
        round(discount, 6) as discount_feature from features"""),
)
def p12(t):
    labelled = order_features(t).select("id", "label", C.dense_features(FEATURES).alias("features"))
    return labelled.select(
        "id",
        "label",
        F.size("features").alias("width"),
        F.col("features")[0].alias("first_feature"),
        F.element_at("features", -1).alias("last_feature"),
        F.round(F.col("features")[3], 6).alias("discount_feature"),
    )


@query(
    "p13_sparse_features",
    """with cells as (select l_orderkey, l_linenumber, l_partkey, list_filter([0, 1, 2], lambda i:
            [l_discount, l_tax, case when l_returnflag = 'R' then 1.0 else 0.0 end][i + 1] <> 0) as used from lineitem)
       select l_orderkey, l_linenumber, l_partkey, len(used)::integer as non_zero,
         (select max(list_max(used)) + 1 from cells)::integer as dimension from cells""",
)
def p13(t):
    columns = ["l_discount", "l_tax", "returned"]
    rows = t.lineitem.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    sparse = rows.select("l_orderkey", "l_linenumber", "l_partkey", C.sparse_features(columns).alias("features"))
    dimension = C.sparse_dimension(sparse, "features").first()[0]
    return sparse.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size("features").alias("non_zero"), F.lit(dimension).alias("dimension")
    )


@query(
    "p14_explode_fields",
    """select unnest([p_brand, p_type, p_name, p_size::varchar]) as value, 1 as one from part""",
)
def p14(t):
    return C.value_counts_of(t.part, ["p_brand", "p_type", "p_name", "p_size"])


@query(
    "p14_long_fields_by_table_function",
    """select p_partkey as id, unnest(['p_brand', 'p_type', 'p_name', 'p_size']) as field,
         unnest([p_brand, p_type, p_name, p_size::varchar]) as value from part""",
)
def p14_long(t):
    return LongFields(t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size").asTable())


TOKENS_SQL = r"""select doc_id, unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) as token from documents"""


@query(
    "p15_tokenise",
    f"""select doc_id, count(*) as n_tokens, count(distinct token) as n_distinct, max(length(token)) as longest
        from ({TOKENS_SQL}) where token <> '' group by doc_id""",
)
def p15(t):
    """Counted inside each document's row: no token is shuffled."""
    words = C.token_list("text")
    counted = t.documents.select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    return counted.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.array_max(F.transform("words", lambda w: F.length(w).cast("bigint"))).alias("longest"),
    )


@query("p17_row_index", "select vec_id, row_number() over (order by vec_id) - 1 as row_index from embeddings")
def p17(t):
    return dense_index(t.embeddings.select("vec_id"), ["vec_id"])


@query(
    "x1_split_trim",
    """select p_partkey, split_part(trim(p_name), ' ', 1) as head, len(string_split(trim(p_name), ' '))::integer as parts
       from part""",
)
def x1(t):
    parts = F.split(F.trim("p_name"), " ", -1)
    return t.part.select("p_partkey", parts[0].alias("head"), F.size(parts).alias("parts"))


@query(
    "x2_substring_find",
    """select page_id, substr(url, instr(url, '//') + 2) as rest, regexp_extract(url, '//([^/]+)', 1) as host from pages""",
)
def x2(t):
    rest = F.col("url").substr(F.locate("//", F.col("url")) + 2, F.length("url"))
    return t.pages.select("page_id", rest.alias("rest"), F.regexp_extract("url", "//([^/]+)", 1).alias("host"))


@query(
    "x3_regex_replace_test",
    """select o_orderkey, regexp_replace(o_orderpriority, ' ', '^', 'g') as priority,
         regexp_matches(o_orderpriority, '^[12]-') as pressing from orders""",
)
def x3(t):
    return t.orders.select(
        "o_orderkey",
        F.regexp_replace("o_orderpriority", " ", "^").alias("priority"),
        F.col("o_orderpriority").rlike("^[12]-").alias("pressing"),
    )


@query(
    "x4_pack_unpack",
    """select c_custkey, 'nation:' || c_nationkey::varchar || ' segment:' || length(c_mktsegment)::varchar as packed,
         c_nationkey + length(c_mktsegment)::integer as unpacked_sum from customer""",
)
def x4(t):
    levels = F.create_map(
        F.lit("segment"), F.length("c_mktsegment"), F.lit("nation"), F.col("c_nationkey")
    )
    packed = t.customer.select("c_custkey", S.pack_levels(levels).alias("packed"))
    back = S.parse_levels(F.col("packed"))
    return packed.select("c_custkey", "packed", (back["nation"] + back["segment"]).alias("unpacked_sum"))


@query(
    "x5_math",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log10(l_quantity + 1), 6) as log_quantity,
         round(atan(l_quantity) * 2 / pi(), 6) as squashed, round(pow(l_discount, 2), 6) as squared,
         round(sqrt(l_extendedprice), 6) as root, round(exp(-l_tax), 6) as decay from lineitem""",
)
def x5(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.log10(F.col("l_quantity") + 1), 6).alias("log_quantity"),
        F.round(F.atan("l_quantity") * 2 / F.pi(), 6).alias("squashed"),
        F.round(F.pow("l_discount", F.lit(2)), 6).alias("squared"),
        F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.round(F.exp(-F.col("l_tax")), 6).alias("decay"),
    )


@query(
    "x6_vector_algebra",
    """with v as (select vec_id, embedding::double[] as a, list_reverse(embedding::double[]) as b from embeddings)
       select vec_id, round(list_inner_product(a, b), 5) as dot, round(sqrt(list_inner_product(a, a)), 5) as norm,
         round(pow(list_distance(a, b), 2), 5) as squared_distance from v""",
)
def x6(t):
    v = t.embeddings.select("vec_id", V.as_doubles(F.col("embedding")).alias("a"))
    v = v.withColumn("b", F.reverse("a"))
    a, b = F.col("a"), F.col("b")
    return v.select(
        "vec_id",
        F.round(V.dot(a, b), 5).alias("dot"),
        F.round(V.norm(a), 5).alias("norm"),
        F.round(V.squared_distance(a, b), 5).alias("squared_distance"),
    )


@query(
    "x7_cast_and_format",
    """select c_custkey, try_cast(c_name as double) as no_number, try_cast(substr(c_name, 10) as bigint) as number,
         round(c_acctbal / 7, 2) as seventh, printf('%.2f', c_acctbal) as printed from customer""",
)
def x7(t):
    return t.customer.select(
        "c_custkey",
        F.col("c_name").try_cast("double").alias("no_number"),
        F.substring("c_name", 10, 20).try_cast("bigint").alias("number"),
        F.round(F.col("c_acctbal") / 7, 2).alias("seventh"),
        F.format_string("%.2f", "c_acctbal").alias("printed"),
    )


@query(
    "x8_map_lookup",
    """select c_custkey, c_mktsegment = 'BUILDING' as is_building, case when c_mktsegment = 'BUILDING' then c_nationkey
         else -1 end as building_nation, case when c_mktsegment = 'BUILDING' then 1 else 2 end as keys,
         case when c_mktsegment = 'BUILDING' then least(c_nationkey, 10) else 10 end as building_level from customer""",
)
def x8(t):
    own = F.create_map(F.col("c_mktsegment"), F.col("c_nationkey"))
    base = F.create_map(F.lit("BUILDING"), F.lit(10))
    merged = S.merge_smallest(own, base)
    return t.customer.select(
        "c_custkey",
        F.map_contains_key(own, "BUILDING").alias("is_building"),
        F.coalesce(F.try_element_at(own, F.lit("BUILDING")), F.lit(-1)).alias("building_nation"),
        F.size(merged).alias("keys"),
        merged["BUILDING"].alias("building_level"),
    )
