"""Small helpers for operators whose inner loop works on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with ``fn`` giving a dict of columns (lists or Arrow arrays) for each batch, cut to
    ``rows`` rows at most if told; such tasks give their memory back when they end."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            step = rows or max(1, big.num_rows)
            for i in range(0, max(1, big.num_rows), step):
                got = fn(big.slice(i, step))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for t, x in ((f, got[f.name]) for f in arrow)], schema=arrow)
                del got
            if rows:
                trim()

    return df.mapInArrow(run, out)


def free_name(name: str, *used: list[str]) -> str:
    """``name``, with underscores put in front until no column of ``used`` has it in any case."""
    taken = {c.lower() for cols in used for c in cols}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def trim() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
