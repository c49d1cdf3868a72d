"""Table functions: the third way of extension beside Column functions and pandas UDFs.

A class with ``eval`` under ``arrow_udtf`` gets whole Arrow batches of a table
argument and yields Arrow tables, so no row passes through Python by itself:

    LongFields(df.select("id", "a", "b").asTable())              # DataFrame API
    spark.udtf.register("long_fields", LongFields)               # SQL
    spark.sql("SELECT * FROM long_fields(TABLE(some_view))")

A table argument without PARTITION BY is worked on where its rows lie, without
a shuffle.  Where an expression says the same, as ``cleansing.value_counts_of``
does without the names, it is the faster choice.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


@F.arrow_udtf(returnType="id bigint, field string, value string")
class LongFields:
    """One (id, field, value) row per row and field of a table whose first column is the id.

    Values are cast to text; null cells stay as rows with a null value.  A table
    of the id alone gives no rows.
    """

    def eval(self, batch: pa.RecordBatch):
        ids = pc.cast(batch.column(0), pa.int64())
        for name, cells in zip(batch.schema.names[1:], batch.columns[1:]):
            yield pa.table({"id": ids, "field": pa.repeat(name, len(ids)), "value": pc.cast(cells, pa.string())})
