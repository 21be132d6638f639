"""Arrow-batched Python, for what has no expression in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_lists(df: DataFrame, schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """Rows of f(*lists of a batch's columns) for every Arrow batch of df."""
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            rows = f(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=x.type) for k, x in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def flat_map(df: DataFrame, schema: str, f: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows of f(*columns of a row) for every row of df; f runs on Arrow batches' Python values."""
    return map_lists(df, schema, lambda *columns: [r for values in zip(*columns) for r in f(*values)])
