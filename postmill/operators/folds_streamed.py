"""A fold that goes through the rows of a key one after the other: a task holds a batch and the fold's own state, never the key's rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type


def streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], begin: Callable[[], Callable[[dict], object]], added: str) -> DataFrame:
    """df with one more column ("name type"): begin() is called for each key, and what it gives for each of its rows, in order."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    name = added.split()[0]
    kind = to_arrow_type(df.sparkSession.createDataFrame([], added).schema[0].dataType)
    keys = list(keys)

    def run(batches):
        last = one = None
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            out = []
            for values in zip(*columns.values(), strict=True):
                row = dict(zip(columns, values, strict=True))
                key = tuple(row[k] for k in keys)
                if one is None or key != last:
                    last, one = key, begin()
                out.append(one(row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, name])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
