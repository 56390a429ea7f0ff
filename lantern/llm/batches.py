"""Row batches for the operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that a helper works on at once; a longer text is a slice of its own.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about size bytes in the column, so that memory
    follows the bytes and not the row count."""
    if batch.nbytes <= size:
        yield batch
        return
    start, total = 0, 0
    for i, x in enumerate(batch.column(column)):
        n = len(x.as_py() or "")
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_rows(df: DataFrame, function: Callable[[list[dict]], list[tuple] | Iterator[tuple]], schema: str, text: str = "text") -> DataFrame:
    """function over lists of rows (as dicts of columns: lists), giving result tuples."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                if rows := list(function(b.to_pydict())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, out)


#: Bytes that one broadcast table may take in memory, on the driver and on every executor.
BROADCAST_BYTES = 16 << 20


def counted(df: DataFrame) -> DataFrame:
    """df (a written table of numbers), to be broadcast if it takes at most BROADCAST_BYTES as
    a hash table (8 bytes a column, and 32 a row); Spark deals out both sides of a join with
    it otherwise."""
    most = BROADCAST_BYTES // (8 * len(df.columns) + 32)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fold_rows(df: DataFrame, start: Callable, step: Callable, finish: Callable, schema: str, text: str = "text") -> DataFrame:
    """One state per task: start() makes it, step(state, rows) takes rows in (as in
    map_rows), finish(state) gives the result tuples."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for whole in batches:
            for b in slices(whole, text):
                step(state, b.to_pydict())
        if rows := list(finish(state)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def map_columns(df: DataFrame, function: Callable[[dict], list], schema: str, text: str = "text", size: int = SLICE) -> DataFrame:
    """As map_rows, for functions that give columns (arrays or lists) instead of rows."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = [[pa.array(c, f.type) for c, f in zip(function(b.to_pydict()), arrow)] for b in slices(whole, text, size)]
            table = pa.Table.from_batches([pa.RecordBatch.from_arrays(p, schema=arrow) for p in parts], arrow)
            yield from table.combine_chunks().to_batches()

    return df.mapInArrow(run, out)
