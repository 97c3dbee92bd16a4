"""Rows on which a function fails become rows with an error; all others keep their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Recogniser = Callable[[pa.RecordBatch], pa.RecordBatch]


def halved(batch: pa.RecordBatch, recognise: Recogniser) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, str | None]]:
    """(rows, results, error) in the rows' order: a batch that raises is cut in half until single rows are left to fail.

    One failing row of n makes about 2 log2(n) calls more, so a row is called log2(n) + 1 times at most. Interrupts of
    the task pass through.
    """
    waiting = [batch]
    while waiting:
        part = waiting.pop()
        try:
            out = recognise(part)
            if out.num_rows != part.num_rows:
                raise ValueError(f"{out.num_rows} results for {part.num_rows} rows")
        except Exception as e:
            if part.num_rows == 1:
                yield part, None, f"{type(e).__name__}: {e}"
                continue
            middle = part.num_rows // 2
            waiting += [part.slice(middle), part.slice(0, middle)]
            continue
        yield part, out, None


def recognised(rows: DataFrame, recognise: Recogniser, results: StructType | str, error: str = "error") -> DataFrame:
    """rows with the columns that a function makes of a batch of them, and `error`, null where it did not fail.

    recognise gets Arrow batches of rows and returns as many rows of `results`; it may be called again with parts of a
    batch in which a row fails, so it must depend on the rows alone. Failed rows have null results. Results that are
    named as a column of rows are an error, and empty batches are not passed on.
    """
    spark = rows.sparkSession
    made = StructType.fromDDL(results) if isinstance(results, str) else results
    clash = {c.lower() for c in rows.columns} & {c.lower() for c in [*made.names, error]}
    if clash:
        raise ValueError(f"columns that are there already: {', '.join(sorted(clash))}")
    schema = StructType([*rows.schema.fields, *made.fields]).add(error, "string")
    types = {f.name: t for f, t in zip(made.fields, spark.createDataFrame([], made).toArrow().schema.types)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, out, why in halved(batch, recognise):
                own = [pa.nulls(part.num_rows, t) if out is None else out.column(out.schema.get_field_index(c)).cast(t) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *own, pa.array([why] * part.num_rows, pa.string())], [*part.schema.names, *types, error])

    return rows.mapInArrow(run, schema)
