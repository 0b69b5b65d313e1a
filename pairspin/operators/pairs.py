"""Work on whole pairs: the q x q bins of many pairs at once as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Numbers of a batch of pairs that are worked on at once.
HELD = 4_000_000


def pair_rows(bins: DataFrame, *columns: str) -> DataFrame:
    """(i, j, and an array of each column in order of (a, b)): one row a pair.  All bins of a pair are there."""
    key = [F.col(c).cast("int").alias(c) for c in ("i", "j")]
    x = bins.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("a", "b", *columns))).alias("x"))
    return x.select("i", "j", *(F.col(f"x.{c}").alias(c) for c in columns))


def _arrays(batch: pa.RecordBatch, columns: int, copies: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Parts of a batch of ``pair_rows`` with the alphabet's length and the columns as arrays (pairs, q, q)."""
    if not batch.num_rows:
        return
    q = isqrt(len(batch.column(2)[0]))
    at_once = max(1, HELD // (copies * q * q))
    for k in range(0, batch.num_rows, at_once):
        part = batch.slice(k, at_once)
        yield part, q, [part.column(2 + c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, q, q) for c in range(columns)]


def per_pair(bins: DataFrame, columns: Sequence[str], made: Sequence[str], f: Callable[..., Sequence[np.ndarray]], copies: int) -> DataFrame:
    """(i, j, a, b, ``made``): ``f`` takes arrays (pairs, q, q) of ``columns`` and gives one for each name made.  ``copies``: numbers that ``f`` holds for each of a pair's bins."""
    ship(bins.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q, arrays in _arrays(batch, len(columns), copies):
                n = part.num_rows
                a, b = np.divmod(np.arange(q * q, dtype=np.int32), q)
                i, j = (np.repeat(part.column(c).to_numpy(), q * q) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, np.tile(a, n), np.tile(b, n), *(v.reshape(-1) for v in f(*arrays)))], names=["i", "j", "a", "b", *made])

    return pair_rows(bins, *columns).mapInArrow(run, "i int, j int, a int, b int, " + ", ".join(f"{m} double" for m in made))


def of_pairs(bins: DataFrame, columns: Sequence[str], made: Sequence[str], f: Callable[..., Sequence[np.ndarray]], copies: int) -> DataFrame:
    """(i, j, ``made``): as ``per_pair`` where ``f`` gives one number a pair for each name."""
    ship(bins.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, arrays in _arrays(batch, len(columns), copies):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.asarray(v, float)) for v in f(*arrays))], names=["i", "j", *made])

    return pair_rows(bins, *columns).mapInArrow(run, "i int, j int, " + ", ".join(f"{m} double" for m in made))
