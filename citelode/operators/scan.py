"""State carried along sorted rows, a batch at a time: for folds that windows can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types that a scan can add.
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def scan(df: DataFrame, by: list[str], order: list[str], reads: list[str], adds: str, fresh: Callable[[], Any], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """``df`` with the columns ``adds`` (a schema), which ``step(state, *reads) -> (state, values)`` gives row after row.

    Rows are dealt by ``by`` and sorted by it and ``order``; each group begins with ``fresh()``.
    A task holds one batch and one state, whatever a group's size. Nulls in ``by`` are one value.
    """
    names = [c.split(" ")[0] for c in adds.split(", ")]
    types = [_ARROW[c.split(" ")[1]] for c in adds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            out = []
            for key, *values in zip(keys, *(batch.column(c).to_pylist() for c in reads), strict=True):
                if key != now:
                    now, state = key, fresh()
                state, made = step(state, *values)
                out.append(made)
            new = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), adds])
    return df.repartition(*by).sortWithinPartitions(*[F.asc_nulls_first(c) for c in (*by, *order)]).mapInArrow(run, schema)
