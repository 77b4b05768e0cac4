"""Arrow batches of rows for the operators that work in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.sources.runtime import ship_package

ROWS = 256
#: Bytes of an Arrow batch on its way to Python and back; by default such a batch of long texts takes many times as much, on both sides.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def parse_schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_batches(df: DataFrame, start: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], ddl: str, rows: int = ROWS) -> DataFrame:
    """Apply start()'s function to small batches (column name to list) and collect columns by ddl.

    start runs once in each task, so that what it builds is shared by the task's batches. Only one
    batch of `rows` rows is held as Python objects at a time, and Arrow batches hold BATCH_BYTES unless the session sets something else.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    schema = parse_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out_schema = start(), to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                out = work(whole.slice(at, rows).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema)
                out = None
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, ddl)
