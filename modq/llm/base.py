"""Shared plumbing of the training-data operators.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; Python code runs in
Arrow batches (``mapInArrow``), one Arrow batch in memory at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..checkpoint import cut, release
from ..ship import ship
from ..spread import spread

__all__ = ["cut", "map_batches", "nonblank", "read_table", "release", "spread"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` over column lists: ``fn`` gets ``{column: python list}`` of one batch and returns the output columns."""
    ship(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def nonblank(column: str) -> "F.Column":
    """True for text with at least one non-whitespace character (Unicode whitespace)."""
    return F.col(column).isNotNull() & F.col(column).rlike("[^\\s\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
