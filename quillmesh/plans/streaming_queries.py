"""Streaming queries (T1-T8); each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import scoring as SC
from quillmesh.plans.bindings import FEATURES, order_features, with_features
from quillmesh.plans.registry import query
from quillmesh.plans.relational_queries import WORDS_SQL
from quillmesh.session import input_bytes, scratch_path
from quillmesh.sources.writers import write_lines
from quillmesh.streaming import jobs as ST
from quillmesh.streaming import line_source as LS


# input behind one incoming file; a task writes it, and another one reads it
FILE_BYTES = 16 << 20


def files_per_part(rows, parts=4):
    """How many files each of ``parts`` takes, so that no file holds more than about FILE_BYTES of what ``rows`` are read from."""
    return max(1, -(-input_bytes(rows) // (parts * FILE_BYTES)))


def table_stream(t, name, columns=None, batches=4):
    """The rows of a driver table, spread over files in no order, as a stream of ``batches`` micro-batches."""
    path = scratch_path(t.spark, "incoming")
    rows = getattr(t, name).select(*(columns or ["*"]))
    each = files_per_part(rows, batches)
    rows.repartition(batches * each).write.parquet(path)
    return ST.file_stream(t.spark, path, rows.schema, "parquet", files_per_batch=each)


def line_stream(t, df, columns, sep=",", batches=4):
    """Rows as text lines in files of bounded size, as a stream of ``batches`` micro-batches."""
    path = scratch_path(t.spark, "incoming")
    each = files_per_part(df, batches)
    write_lines(df.repartition(batches * each), path, columns, sep)
    return ST.file_stream(t.spark, path, files_per_batch=each)


@query("t1_new_files_source", "select o_orderkey::varchar || ',' || o_orderstatus || ',' || o_custkey::varchar as value from orders")
def t1(t):
    return ST.to_table(line_stream(t, t.orders, ["o_orderkey", "o_orderstatus", "o_custkey"])).select("value")


@query(
    "t2_any_line_source",
    """select word as token, count(*) as n from (select unnest([event_type, 'user' || user_id::varchar]) as word from events)
       group by word""",
)
def t2(t):
    """Counting works on any stream with a value column, here text files instead of a socket."""
    words = t.events.select("event_type", F.concat(F.lit("user"), "user_id").alias("who"))
    lines = line_stream(t, words, ["event_type", "who"], sep=" ", batches=2)
    return ST.count_rows(ST.tokens(lines), ["token"])


@query(
    "t2_line_folder_restarts",
    """select word as token, count(*) as n, 4::bigint as batches from (select unnest([event_type, 'user' || user_id::varchar]) as word from events)
       group by word""",
)
def t2_line_folder(t):
    """Lines through a source of its own, four times started again on its offsets as files are added."""
    words = t.events.select("event_id", F.concat_ws(" ", "event_type", F.concat(F.lit("user"), "user_id")).alias("value"))
    folder, job = scratch_path(t.spark, "lines"), scratch_path(t.spark, "job")
    for part in range(4):
        words.filter(F.col("event_id") % 4 == part).select("value").write.text(f"{folder}/{part:06d}")
        lines = LS.line_stream(t.spark, folder)
        table = ST.to_table(ST.tokens(lines), each=lambda b: b.groupBy("token").agg(F.count(F.lit(1)).alias("n")), folder=job)
    batches = table.agg(F.count_distinct("batch").alias("batches"))
    return table.groupBy("token").agg(F.sum("n").alias("n")).crossJoin(batches)


@query("t3_streaming_word_count", WORDS_SQL)
def t3(t):
    lines = table_stream(t, "documents", ["text"]).select(F.col("text").alias("value"))
    return ST.count_rows(ST.tokens(lines), ["token"])


@query(
    "t4_interval_counts",
    """select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2""",
)
def t4(t):
    table = ST.interval_counts(table_stream(t, "events", ["ts", "event_type"]), "ts", "1 hour", ["event_type"])
    return table.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "t5_record_map",
    """select case when c_mktsegment = 'BUILDING' then '0' else c_mktsegment end || '|' || c_custkey::varchar as fields from customer""",
)
def t5(t):
    """Drop two positions, empty fields become 0."""
    rows = t.customer.withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    lines = line_stream(t, rows, ["c_name", "segment", "c_nationkey", "c_custkey"], batches=2)
    mapped = ST.map_records(lines, dropped=[0, 2])
    return ST.to_table(mapped.select(F.array_join("fields", "|").alias("fields"))).select("fields")


@query("t5_decorate", "select 'ok' || n_name || 'yes' as value from nation")
def t5_decorate(t):
    return ST.to_table(ST.decorate(line_stream(t, t.nation, ["n_name"], batches=2))).select("value")


@query("t6_score_stream", with_features("select count(*) as n, 0::bigint as differing from features"))
def t6(t):
    """A saved model scores rows as they arrive; every prediction must be the one it gives in batch."""
    path, model_path = scratch_path(t.spark, "rows"), scratch_path(t.spark, "model")
    features = order_features(t)
    each = files_per_part(features)
    features.repartition(4 * each).write.parquet(path)
    data = t.spark.read.parquet(path)
    SC.save_model(SC.train_forest(data, FEATURES, trees=5, depth=4), model_path)
    model = SC.load_model(model_path)
    stream = ST.file_stream(t.spark, path, data.schema, "parquet", files_per_batch=2 * each)
    arrived = ST.to_table(ST.score_stream(stream, model, FEATURES).select("id", "prediction"))
    batch = SC.score(data, model, FEATURES).select("id", F.col("prediction").alias("expected"))
    return arrived.join(batch, "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") != F.col("expected")).alias("differing")
    )


@query(
    "t7_online_regression",
    """with s as (select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_discount) as b, sum(l_quantity * l_tax) as c,
           sum(l_discount * l_discount) as e, sum(l_discount * l_tax) as f, sum(l_tax * l_tax) as i,
           sum(l_quantity * l_extendedprice) as y0, sum(l_discount * l_extendedprice) as y1, sum(l_tax * l_extendedprice) as y2
           from lineitem),
         d as (select *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) as det from s),
         w as (select (y0 * (e * i - f * f) - b * (y1 * i - f * y2) + c * (y1 * f - e * y2)) / det as w0,
           (a * (y1 * i - f * y2) - y0 * (b * i - f * c) + c * (b * y2 - y1 * c)) / det as w1,
           (a * (e * y2 - y1 * f) - b * (b * y2 - y1 * c) + y0 * (b * f - e * c)) / det as w2 from d)
       select l_orderkey, l_linenumber, l_partkey, round(w0 * l_quantity + w1 * l_discount + w2 * l_tax, 2) as prediction
       from lineitem, w""",
)
def t7(t):
    features = ["l_quantity", "l_discount", "l_tax"]
    model = ST.OnlineRegression(t.spark, "l_extendedprice", features).train_on(table_stream(t, "lineitem"))
    predicted = model.predict(table_stream(t, "lineitem"))
    kept = predicted.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 2).alias("prediction"))
    return ST.to_table(kept).drop("batch")


@query("t8_bounded_run", "select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def t8(t):
    """Everything available is processed, or the run fails."""
    table = ST.to_table(table_stream(t, "events", ["event_type", "value"]))
    return table.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
