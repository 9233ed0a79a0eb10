"""Row functions over Arrow batches in small slices, so that long texts stay bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE = 512


def map_rows(
    df: DataFrame,
    setup: Callable[[], Callable[[list[tuple]], Iterable[tuple]]],
    schema: str,
) -> DataFrame:
    """Give slices of rows (tuples of all columns) to the function that ``setup`` makes.

    ``setup`` runs once per task, so that models and caches are made on the executor.
    """
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = list(work(list(zip(*(c.to_pylist() for c in part.columns), strict=True))))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
                    )

    return df.mapInArrow(run, schema)


def row_test(make: Callable[[], Callable[[list], list[bool]]]):
    """A boolean function of one column, given in slices of values to what ``make`` makes."""

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        work = make()
        parts = (values.slice(at, SLICE).to_pylist() for at in range(0, len(values), SLICE))
        return pa.array([bool(x) for part in parts for x in work(part)], pa.bool_())

    return test
