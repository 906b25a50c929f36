"""Python over Arrow batches, a few rows at a time, so that a worker's memory doesn't follow the batches' size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows of a part, and the bytes from which a part has fewer of them.
ROWS, BYTES = 256, 1_000_000


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, and of about so many bytes where a row has fewer than that."""
    for batch in batches:
        step = max(1, min(rows, most * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_value(kind: DataType, arrow: pa.DataType) -> Callable[[Callable], Callable]:
    """A UDF of a function of one value; null stays null. One value at a time is a Python object."""

    def make(f: Callable):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array((f(v.as_py()) if v.is_valid else None for v in batch), arrow)

        run.__name__ = f.__name__
        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, kind)

    return make
