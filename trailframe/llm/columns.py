"""Adding columns computed from a text column, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trailframe.llm.segments import slices


def append_columns(docs: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]],
                   make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``docs`` with the columns ``fields`` behind its own.  ``make`` is
    called once in each task and gives a function from a list of texts to
    one list per field.  A column of ``docs`` that has the name of a new one
    is replaced."""
    base = docs.drop(*[f[0] for f in fields])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t, _ in fields]])
    at = base.columns.index(text_col)
    names = schema.names
    kinds = [k for _, _, k in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in it:
            texts = batch.column(at).to_pylist()
            for first, part in slices(texts):
                own = [c.slice(first, len(part)) for c in batch.columns]
                new = [pa.array(v, k) for v, k in zip(fn(part), kinds)]
                yield pa.RecordBatch.from_arrays([*own, *new], names=names)

    return base.mapInArrow(run, schema)
