"""Small driver-side tables and the size check in front of every broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_LIMIT = 64 * 1024 * 1024
AUTO_LIMIT = 10 * 1024 * 1024  # below this Spark broadcasts by itself


def _arrow(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_map(kind):
        return [(k, _arrow(v, kind.item_type)) for k, v in value.items()]
    if pa.types.is_struct(kind):
        return {f.name: _arrow(v, f.type) for f, v in zip(kind, value)}
    return value


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Configuration rows as a table whose size the optimizer knows exactly."""
    schema = to_arrow_schema(T._parse_datatype_string(ddl))
    columns = [
        pa.array([_arrow(row[i], field.type) for row in rows], field.type)
        for i, field in enumerate(schema)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Ask for a broadcast only of data measured to fit ``limit`` bytes.

    Where the optimizer already knows the side is under its own threshold nothing is run.
    A side that does not fit is returned as it is, for a shuffled join that AQE splits on skew.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) <= AUTO_LIMIT:
        return df
    text = F.length(F.to_json(F.struct(*df.columns)))
    size = df.agg(F.sum(text + 64)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
