"""Streams of driver tables: files of bounded size, as many micro-batches as before."""

import pytest
from pyspark.sql import functions as F

from quillmesh.plans import streaming_queries as Q
from quillmesh.plans.registry import Tables


@pytest.mark.parametrize("limit, files", [(Q.FILE_BYTES, 4), (2000, 8)])
def test_files_grow_in_number_with_the_table(spark, tmp_path, monkeypatch, limit, files):
    monkeypatch.setattr(Q, "FILE_BYTES", limit)
    spark.range(2000).selectExpr("id as event_id", "cast(id % 7 as string) as event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    stream = Q.table_stream(Tables(spark, str(tmp_path)), "events")
    Q.ST.run_batches(stream, lambda batch, n: seen.append((batch.select(F.input_file_name()).distinct().count(), batch.count())))
    assert len(seen) == 4 and sum(n for _, n in seen) == 2000
    assert sum(n for n, _ in seen) == files
