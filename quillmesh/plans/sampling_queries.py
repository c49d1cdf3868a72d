"""Sampling, balancing and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import sampling as B
from quillmesh.plans.registry import query


def unit_sql(key: str, seed: int | str = 0) -> str:
    return f"(('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 8))::bigint / 4294967296.0::double)"


def random_draw_check(rows, drawn, label: str, drawn_class: int, factor: float):
    """One row: rows of the other classes, rows the source lacks, and whether the drawn class has about ``factor`` times its rows.

    A draw of n rows at a given factor has a deviation of at most sqrt(n * factor);
    six of them and one row are let through.
    """
    few = rows.filter(F.col(label) == drawn_class).count()
    foreign = drawn.join(rows, ["doc_id", label], "left_anti").count()
    off = F.abs(F.count_if(F.col(label) == drawn_class) - F.lit(few * factor))
    return drawn.agg(
        F.count_if(F.col(label) != drawn_class).alias("others"),
        F.lit(foreign).cast("bigint").alias("foreign_rows"),
        (off <= 6 * (few * factor) ** 0.5 + 1).alias("within_bound"),
    )


def random_draw_sql(label: str, drawn_class: int) -> str:
    return f"""select count(*) filter ({label} <> {drawn_class}) as others, 0::bigint as foreign_rows,
        true as within_bound from labels"""


@query(
    "b1_hash_split",
    f"""select o_orderkey, case when {unit_sql('o_orderkey', 11)} < 0.7::double then 0
        when {unit_sql('o_orderkey', 11)} < 0.9::double then 1 else 2 end as part from orders""",
)
def b1(t):
    return t.orders.select("o_orderkey", B.hash_part(F.col("o_orderkey"), [7, 2, 1], seed=11).alias("part"))


@query("b1_random_split", "select count(*) as n, count(distinct o_orderkey) as distinct_keys from orders")
def b1_random(t):
    """The parts of a seeded random split are disjoint and cover the table."""
    first, second = B.random_split(t.orders.select("o_orderkey"), [0.7, 0.3], seed=42)
    return first.unionByName(second).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys")
    )


@query(
    "b2_oversample_by_key",
    f"""with r as (select count(*) filter (quality <> 0)::double / count(*) filter (quality = 0) as factor from labels)
        select doc_id, quality, unnest(range(1, (case when quality <> 0 then 1 else floor(factor)
          + (case when {unit_sql('doc_id', 5)} < factor - floor(factor) then 1 else 0 end) end)::bigint + 1))::integer as copy
        from labels, r""",
)
def b2(t):
    """The minority (quality 0) raised to the size of the majority, the same rows on every run."""
    rows = t.labels.select("doc_id", "quality")
    factor = B.majority_ratio(rows, "quality", minority=0)
    return B.oversample_by_key(rows, "quality", "doc_id", factor, seed=5, minority=0)


@query("b2_oversample_random")
def b2_random(t):
    rows = t.labels.select("doc_id", "quality")
    factor = B.majority_ratio(rows, "quality", minority=0)
    return B.oversample_random(rows, "quality", factor, seed=7, minority=0)


@query("b2_oversample_random_bounds", random_draw_sql("quality", 0))
def b2_random_bounds(t):
    rows = t.labels.select("doc_id", "quality")
    factor = B.majority_ratio(rows, "quality", minority=0)
    return random_draw_check(rows, b2_random(t), "quality", 0, factor)


@query("b3_fixed_factor_oversample")
def b3(t):
    return B.oversample_random(t.labels.select("doc_id", "toxic"), "toxic", 93.0, seed=7)


@query("b3_fixed_factor_bounds", random_draw_sql("toxic", 1))
def b3_bounds(t):
    return random_draw_check(t.labels.select("doc_id", "toxic"), b3(t), "toxic", 1, 93.0)


@query(
    "b3_fixed_factor_by_key",
    f"""select doc_id, toxic, unnest(range(1, case when toxic <> 1 then 2
          else 2 + (case when {unit_sql('doc_id', 3)} < 0.5::double then 1 else 0 end) end))::integer as copy from labels""",
)
def b3_key(t):
    return B.oversample_by_key(t.labels.select("doc_id", "toxic"), "toxic", "doc_id", 1.5, seed=3)


@query(
    "b4_duplicate_class",
    "select doc_id, toxic from labels union all select doc_id, toxic from labels where toxic = 1",
)
def b4(t):
    return B.duplicate_class(t.labels.select("doc_id", "toxic"), "toxic")


@query(
    "b5_undersample_by_key",
    f"select doc_id, toxic from labels where toxic <> 0 or {unit_sql('doc_id', 9)} < 0.15::double",
)
def b5(t):
    return B.undersample_by_key(t.labels.select("doc_id", "toxic"), "toxic", "doc_id", 0.15, seed=9)


@query("b5_undersample_random")
def b5_random(t):
    return B.undersample_random(t.labels.select("doc_id", "toxic"), "toxic", {0: 0.15, 1: 1.0}, seed=9)


@query("b5_undersample_random_bounds", random_draw_sql("toxic", 0))
def b5_random_bounds(t):
    return random_draw_check(t.labels.select("doc_id", "toxic"), b5_random(t), "toxic", 0, 0.15)


@query(
    "b6_class_balance",
    """select count(*) filter (toxic = 1) as positives, count(*) filter (toxic = 0) as negatives,
         round(count(*) filter (toxic = 1)::double / count(*) filter (toxic = 0), 6) as ratio,
         round(count(*) filter (toxic = 1)::double / count(*), 6) as positive_share from labels""",
)
def b6(t):
    balance = B.class_balance(t.labels, "toxic")
    return balance.select(
        "positives", "negatives", F.round("ratio", 6).alias("ratio"), F.round("positive_share", 6).alias("positive_share")
    )


@query(
    "b7_seeded_draws",
    " union all ".join(
        f"""select * from (select {i} as draw, vec_id, label from embeddings
            order by md5(vec_id::varchar || ':{42 + i}'), vec_id limit 1)"""
        for i in range(1, 9)
    ),
)
def b7(t):
    return B.seeded_draws(t.embeddings, "vec_id", ["label"], draws=8)
