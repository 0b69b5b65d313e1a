"""Places of rows in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .storage import kept


def in_order(states: DataFrame, *by: str) -> DataFrame:
    """``states`` with ``place``, from 0 on, in the order of ``by``, which should tell all rows apart.

    Ranges are sorted where they are, and each one's place follows from the sizes of those before it: one number a partition.
    """
    ship(states.sparkSession)
    columns = states.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))], names=[*columns, "part", "k"])
            done += n

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema.fields)
    numbered = kept(states.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, f"{kinds}, part int, k long"), "in-order")
    before, starts = 0, {}
    for row in sorted(numbered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts[row.part] = before
        before += row.n
    start = F.element_at(F.create_map(*(F.lit(v) for x in starts.items() for v in x)), F.col("part")) if starts else F.lit(0)
    return numbered.select(*columns, (F.col("k") + start).cast("long").alias("place"))
