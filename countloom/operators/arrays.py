"""Many columns of a table as one array for Python, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def row_of(columns: list[str]) -> Column:
    """x, the columns as one array: rows of so many columns take several times as long to Python."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A line for each row of row_of's arrays; a null is not a number."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches together, so many rows or little more at once."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(map(len, some)) >= rows:
            yield pa.Table.from_batches(some)
            some = []
    if sum(map(len, some)):
        yield pa.Table.from_batches(some)
