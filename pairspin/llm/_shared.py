"""What several operators need: the shared folder, lineage cuts, table reading and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the scale-factor folder, read by Spark (any file system that Spark knows)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once an application."""
    _ship(spark.sparkContext.applicationId, spark)


@lru_cache(maxsize=8)
def _ship(application: str, spark: SparkSession) -> None:
    root = Path(__file__).resolve().parents[2]
    name = Path(__file__).resolve().parents[1].name
    with tempfile.NamedTemporaryFile(prefix=f"{name}-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for p in sorted((root / name).rglob("*.py")):
                z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(f.name)


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only where that is unset (tests, a laptop) a folder
    beside the warehouse is used, which is shared as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder, with these options of the writer, and read it back.

    The files survive lost executors, so a later failure recomputes from here only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.startswith(("file:", "/")) or "://" in path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that are done with, rather than whenever memory next runs low."""
    gc.collect()
    spark._jvm.System.gc()


def tidy() -> None:
    """Give a finished task's memory back to the system; worker processes outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole runs of equal leading columns in sorted batches: (rows, bounds of the runs in them)."""
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
        if held is None or not len(held):
            continue
        keys = [held.column(c).to_numpy() for c in range(n_keys)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if len(held) > 1 else np.zeros(0, np.int64)
        # the last run may go on in the next batch
        whole = len(held) if batch is None else int(cuts[-1]) if len(cuts) else 0
        if whole:
            yield held.slice(0, whole), [0, *(c for c in cuts.tolist() if c < whole), whole]
            held = held.slice(whole)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)``: one row (node, component = smallest reachable node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is a grouped
    minimum and a join on the same key, so a node with very many neighbours costs a partial
    aggregate and a join that AQE can split, never one large group in memory.  Each round's
    edges are written to the shared folder; nothing is collected but two sums a round.
    """
    e = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-edges",
    )
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = materialize(small, f"{name}-small")
        discard(e, large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
