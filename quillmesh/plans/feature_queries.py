"""Feature engineering queries."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer, Tokenizer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.functions import vectors as V
from quillmesh.operators import encoding as E
from quillmesh.operators import scaling as Z
from quillmesh.operators.lookup import encode_from
from quillmesh.plans.bindings import order_features, with_features
from quillmesh.plans.registry import query

ORDER_CATEGORIES = ["o_orderstatus", "o_orderpriority"]
ORDER_CELLS_SQL = """cells as (select 'o_orderstatus' as feature, o_orderstatus as value from orders
    union all select 'o_orderpriority', o_orderpriority from orders)"""


@query(
    "f1_vocabularies",
    f"""with {ORDER_CELLS_SQL} select feature, value, row_number() over (partition by feature order by value) - 1 as code
        from (select distinct feature, value from cells)""",
)
def f1(t):
    return E.vocabularies(t.orders, ORDER_CATEGORIES)


@query(
    "f2_category_index",
    "select value, row_number() over (order by value) - 1 as code from (select distinct p_name as value from part)",
)
def f2(t):
    return E.category_index(t.part, "p_name")


@query(
    "f3_encode_categories",
    """with d as (select v, row_number() over (order by v) - 1 as code from (select distinct c_mktsegment as v from customer))
       select c_custkey, code as c_mktsegment from customer join d on v = c_mktsegment""",
)
def f3(t):
    dictionary = E.category_index(t.customer, "c_mktsegment")
    return encode_from(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], dictionary, "value", "code")


# The five market segments, as column names of the oracle.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "f4_one_hot",
    "select c_custkey, c_acctbal, "
    + ", ".join(f"(c_mktsegment = '{s}')::integer as seg_{s}" for s in SEGMENTS)
    + " from customer",
)
def f4(t):
    vocabulary = E.vocabulary_list(t.customer, "c_mktsegment")
    return t.customer.select("c_custkey", "c_acctbal", *E.one_hot("c_mktsegment", vocabulary, "seg"))


@query(
    "f4_sparse_one_hot",
    """with d as (select v, row_number() over (order by v) - 1 as code from (select distinct p_name as v from part))
       select p_partkey, code as slot, 1.0::double as value from part join d on v = p_name""",
)
def f4_sparse(t):
    """The form for wide vocabularies: one (slot, 1) entry per row."""
    names = t.part.select("p_partkey", "p_name")
    hot = E.sparse_one_hot(names, "p_name", E.category_index(names, "p_name"), "hot")
    return hot.select("p_partkey", F.explode("hot").alias("slot", "value"))


def balances_with_gaps(t):
    """Balances as text, NA where they are negative."""
    text = F.when(F.col("c_acctbal") < 0, "NA").otherwise(F.col("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", text.alias("balance"))


@query("f5_mean_ignoring_missing", "select round(avg(c_acctbal), 4) as mean from customer where c_acctbal >= 0")
def f5(t):
    return balances_with_gaps(t).agg(F.round(F.avg(F.col("balance").try_cast("double")), 4).alias("mean"))


@query(
    "f6_impute_mean",
    """select c_custkey, round(case when c_acctbal < 0 then (select avg(c_acctbal) from customer where c_acctbal >= 0)
         else c_acctbal end, 4) as balance from customer""",
)
def f6(t):
    return E.impute_mean(balances_with_gaps(t), "balance").select("c_custkey", F.round("balance", 4).alias("balance"))


# The hand-written code map.
RESPONSE_CODES = {"3": 0, "1": 1, "2": 3, "NA": 4}


@query(
    "f7_fixed_code_map",
    """select o_orderkey, case substr(o_orderpriority, 1, 1) when '3' then 0 when '1' then 1 when '2' then 3 else 4 end
         as code from orders""",
)
def f7(t):
    first = F.substring("o_orderpriority", 1, 1)
    return t.orders.select("o_orderkey", S.code_from(first, RESPONSE_CODES, "NA").alias("code"))


@query(
    "f8_lookup_encode",
    """with d as (select n_name, n_nationkey + 100 as code from nation), c as (select c_custkey,
           'NATION_' || c_nationkey::varchar as home, 'NATION_' || (c_nationkey + 5)::varchar as work,
           c_mktsegment as segment, 'NATION_' || (c_custkey % 40)::varchar as last from customer)
       select c_custkey, coalesce(h.code, 0) as home, coalesce(w.code, 0) as work, coalesce(s.code, 0) as segment,
         coalesce(l.code, 0) as last from c left join d h on h.n_name = home left join d w on w.n_name = work
         left join d s on s.n_name = segment left join d l on l.n_name = last""",
)
def f8(t):
    """Four columns against one dictionary, 0 for names it lacks."""
    named = t.customer.select(
        "c_custkey",
        F.concat(F.lit("NATION_"), "c_nationkey").alias("home"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey") + 5).alias("work"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("NATION_"), F.col("c_custkey") % 40).alias("last"),
    )
    dictionary = t.nation.select("n_name", (F.col("n_nationkey") + 100).alias("code"))
    return encode_from(named, ["home", "work", "segment", "last"], dictionary, "n_name", "code", default=0)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def measures_sql(select: str) -> str:
    return " union all ".join(
        f"select '{c}' as feature, {select.format(c=c)} from lineitem" for c in MEASURES
    )


@query("f9_min_max", measures_sql("min({c}) as least, max({c}) as greatest"))
def f9(t):
    return Z.stats_table(t.lineitem, MEASURES).select("feature", "least", "greatest")


@query("f10_mean_std", measures_sql("round(avg({c}), 5) as mean, round(stddev_pop({c}), 5) as std"))
def f10(t):
    stats = Z.stats_table(t.lineitem, MEASURES)
    return stats.select("feature", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def scaled_sql(formula: str) -> str:
    """``formula`` over {x}, {least}, {greatest}, {mean}, {std} of quantity and price."""

    def cell(c):
        parts = {k: f"s_{k}_{c}" for k in ("least", "greatest", "mean", "std")}
        return formula.format(x=c, **parts)

    stats = ", ".join(
        f"min({c}) as s_least_{c}, max({c}) as s_greatest_{c}, avg({c}) as s_mean_{c}, stddev_pop({c}) as s_std_{c}"
        for c in ("l_quantity", "l_extendedprice")
    )
    return (
        f"with s as (select {stats} from lineitem) select {', '.join(KEYS)}, "
        f"round({cell('l_quantity')}, 5) as l_quantity, round({cell('l_extendedprice')}, 5) as l_extendedprice "
        f"from lineitem, s"
    )


def scaled(t, how):
    columns = ["l_quantity", "l_extendedprice"]
    out = Z.scale(t.lineitem.select(*KEYS, *columns), columns, how)
    return out.select(*KEYS, *[F.round(c, 5).alias(c) for c in columns])


@query("f11_z_score", scaled_sql("({x} - {mean}) / {std}"))
def f11(t):
    return scaled(t, "z_score")


@query("f12_min_max_scale", scaled_sql("({x} - {least}) / ({greatest} - {least})"))
def f12(t):
    return scaled(t, "min_max")


@query("f13_log_shift", scaled_sql("log10({x} + 1)"))
def f13(t):
    return scaled(t, "log_shift")


@query("f14_log_of_min_max", scaled_sql("log10(({x} - {least}) / ({greatest} - {least}) + 1)"))
def f14(t):
    return scaled(t, "log_min_max")


@query(
    "f14_log_space_min_max",
    scaled_sql("(log10({x} + 1) - log10({least} + 1)) / (log10({greatest} + 1) - log10({least} + 1))"),
)
def f14_space(t):
    return scaled(t, "log_space_min_max")


@query(
    "f15_selected_log_ratio",
    f"""select {', '.join(KEYS)}, l_quantity, round(log10(l_extendedprice + 1)
        / log10((select max(l_extendedprice) from lineitem)), 5) as l_extendedprice from lineitem""",
)
def f15(t):
    """Only the listed columns are scaled, the others pass."""
    out = Z.scale(t.lineitem.select(*KEYS, "l_quantity", "l_extendedprice"), ["l_extendedprice"], "log_ratio")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 5))


@query("f16_mean_centring", scaled_sql("{x} - {mean}"))
def f16(t):
    return scaled(t, "centred")


@query("f17_arctan", scaled_sql("atan({x}) * 2 / pi()"))
def f17(t):
    return scaled(t, "arctan_squash")


@query(
    "f18_value_probability",
    f"""with {ORDER_CELLS_SQL} select feature, value, round(count(*)::double / (select count(*) from orders), 6)
        as probability from cells group by feature, value""",
)
def f18(t):
    table = E.value_probabilities(t.orders, ORDER_CATEGORIES)
    return table.select("feature", "value", F.round("probability", 6).alias("probability"))


@query("f19_thousand_steps", scaled_sql("round(({x} - {least}) / (({greatest} - {least}) / 1000), 2)"))
def f19(t):
    return scaled(t, "thousand_steps")


@query(
    "f20_category_arity",
    " union all ".join(
        f"select '{c}' as feature, {i} as position, count(distinct {c}) as arity from part"
        for i, c in enumerate(["p_brand", "p_type", "p_size"])
    ),
)
def f20(t):
    arity = E.arities(t.part, ["p_brand", "p_type", "p_size"])
    return arity.select("feature", F.col("position").cast("int").alias("position"), "arity")


@query(
    "f21_string_index",
    """select c_mktsegment, (row_number() over (order by count(*) desc, c_mktsegment) - 1)::double as indexed,
         c_mktsegment as restored from customer group by c_mktsegment""",
)
def f21(t):
    model = StringIndexer(inputCol="c_mktsegment", outputCol="indexed").fit(t.customer)
    indexed = model.transform(t.customer.select("c_mktsegment"))
    back = IndexToString(inputCol="indexed", outputCol="restored", labels=model.labels)
    return back.transform(indexed).distinct()


@query(
    "f22_detect_categories",
    with_features("""select i.id, i.label, (case when n <= 8 then (select count(distinct n_lines) from features f
          where f.n_lines < i.n_lines)::double else i.n_lines end) as n_lines, i.quantity
        from features i, (select count(distinct n_lines) as n from features)"""),
)
def f22(t):
    """Slots with few distinct values become category codes, the others stay as they are."""
    assembled = VectorAssembler(inputCols=["n_lines", "quantity"], outputCol="raw").transform(order_features(t))
    model = VectorIndexer(inputCol="raw", outputCol="indexed", maxCategories=8).fit(assembled)
    slots = vector_to_array("indexed")
    return model.transform(assembled).select("id", "label", slots[0].alias("n_lines"), slots[1].alias("quantity"))


TOKENIZER_SQL = r"""select doc_id, len(regexp_split_to_array(regexp_replace(lower(text), '[ \t\n\v\f\r]+$', ''),
    '[ \t\n\v\f\r]'))::integer as n_tokens from documents"""


@query("f23_tokenizer", TOKENIZER_SQL)
def f23(t):
    words = Tokenizer(inputCol="text", outputCol="words").transform(t.documents)
    return words.select("doc_id", F.size("words").alias("n_tokens"))


@query("f24_hashed_term_frequency", TOKENIZER_SQL)
def f24(t):
    """Term counts hashed to 1000 slots; their sum must be the number of tokens."""
    words = Tokenizer(inputCol="text", outputCol="words").transform(t.documents)
    hashed = HashingTF(inputCol="words", outputCol="frequencies", numFeatures=1000).transform(words)
    counted = V.total(vector_to_array("frequencies")).cast("int")
    return hashed.select("doc_id", counted.alias("n_tokens"))


@query(
    "f25_append_bias",
    "select vec_id, len(embedding)::integer + 1 as width, 1.0::double as last_slot, round(list_sum(embedding::double[]) + 1, 5) as slot_sum from embeddings",
)
def f25(t):
    biased = t.embeddings.select("vec_id", V.append_bias(V.as_doubles(F.col("embedding"))).alias("x"))
    return biased.select(
        "vec_id",
        F.size("x").alias("width"),
        F.element_at("x", -1).alias("last_slot"),
        F.round(V.total(F.col("x")), 5).alias("slot_sum"),
    )
