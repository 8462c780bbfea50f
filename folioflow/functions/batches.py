"""Arrow batches: keys and other columns that an operator doesn't look at pass through as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def arrow_types(schema: str | T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).types)


def with_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField]) -> DataFrame:
    """df with the columns that make()(batch) returns, in one narrow pass; make is called once a task. df's columns of these names go."""
    new = {f.name.lower() for f in fields}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    out = T.StructType([df.schema[i] for i in kept] + fields)
    types = arrow_types(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            made = [x if isinstance(x, pa.Array) else pa.array(x, t, from_pandas=False) for x, t in zip(work(b), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *made], names=out.names)

    return df.mapInArrow(run, out)


def same(a: object, b: object) -> bool:
    """Whether two keys are one: null is itself, and so is NaN."""
    return a == b or (a != a and b != b)


def spread(df: DataFrame) -> DataFrame:
    """df, or if it is a scan of fewer splits than there are cores, df dealt out; a table of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
