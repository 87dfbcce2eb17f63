"""Folds that are sequential by definition, streamed over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], start: Callable[[], list], step: Callable[..., Any], out: str, kind: str) -> DataFrame:
    """``rows`` with the column ``out`` (of the Arrow type and DDL name ``kind``): what ``step(state, *values)`` returns.

    The rows of each ``key`` are folded in ``order`` from a fresh ``start()``; ``step`` changes the state in place. A key's
    rows pass through one task in Arrow batches, none of them are held, and each costs one call. Without a key all rows
    pass through one task: keep them narrow.
    """
    spark_type = rows.sparkSession.range(0).selectExpr(f"CAST(NULL AS {kind}) AS x").schema[0].dataType
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}[spark_type.simpleString()]
    dealt = rows.repartition(*key) if key else rows.repartition(1)
    names = [*key, *values]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            columns = [batch[name].to_pylist() for name in names]
            found = []
            for row in zip(*columns, strict=True):
                own = row[: len(key)]
                if own != last:
                    last, state = own, start()
                found.append(step(state, *row[len(key) :]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.sortWithinPartitions(*key, *order).mapInArrow(fold, f"{fields}, `{out}` {kind}")
