"""Python functions over rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 1000  # rows of a result that are sent at once


def flat_map(df: DataFrame, make: Callable[[dict], Iterable[dict]], ddl: str) -> DataFrame:
    """Every row of ``df`` becomes the rows that ``make`` gives for it; columns that a row lacks are null."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in parts:
            for row in part.to_pylist():
                held += make(row)
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, ddl)
