"""Alignments and parameters derived from the driver's tables; the same expressions in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A_LENGTH, A_Q = 6, 4
B_LENGTH, B_Q = 12, 4
#: Letters of one lineitem row, in Spark SQL and DuckDB.
A_LETTERS = (
    "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end",
    "case l_linestatus when 'F' then 0 else 1 end",
    "cast(floor((l_quantity-1)/12.5) as int)",
    "cast(least(3,floor(round(l_discount*100)/3)) as int)",
    "cast(least(3,floor(round(l_tax*100)/2)) as int)",
    "cast((l_linenumber-1)%4 as int)",
)


def msa_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq): lineitem as 6 columns of 4 letters; six columns are read."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr(f"array({', '.join(A_LETTERS)})").alias("seq"))


#: Coordinates of an embedding, all of which make B's letters: position p sums the coordinates p, p + 12, p + 24 and so on.
DIMENSIONS = 64
CUTS = (-0.19, 0.0, 0.19)


def b_letter(p: int, coordinate: str, length: int = B_LENGTH) -> str:
    """SQL of B's letter at ``p``; ``coordinate`` formats the number of a coordinate."""
    total = " + ".join(f"CAST({coordinate.format(k)} AS DOUBLE)" for k in range(p, DIMENSIONS, length))
    cuts = CUTS if length == B_LENGTH else (-0.08, 0.0, 0.08)
    return "CASE " + " ".join(f"WHEN {total} < CAST({c} AS DOUBLE) THEN {k}" for k, c in enumerate(cuts)) + " ELSE 3 END"


def msa_b(spark: SparkSession, sf_dir: str, length: int = B_LENGTH) -> DataFrame:
    """(seq_id, seq, w): each embedding folded to ``length`` sums of coordinates, cut into 4 letters."""
    letters = ", ".join(b_letter(p, "embedding[{}]", length) for p in range(length))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq_id"), F.expr(f"array({letters})").alias("seq"), F.expr("(vec_id % 4 + 1) / 4.0D").alias("w"))


def msa_wide(spark: SparkSession, sf_dir: str, length: int, q: int) -> DataFrame:
    """(seq_id, seq, w): embeddings as sequences of the shape of large families; each letter is a sum of two coordinates cut into q parts."""
    total = f"cast(embedding[p % {DIMENSIONS}] as double) + cast(embedding[(7 * p + 3 + p div {DIMENSIONS}) % {DIMENSIONS}] as double)"
    letters = f"transform(sequence(0, {length - 1}), p -> least({q - 1}, greatest(0, cast(floor(({total} + 0.35D) / 0.7D * {q}) as int))))"
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq_id"), F.expr(letters).alias("seq"), F.lit(1.0).alias("w"))


def couplings(spark: SparkSession, length: int, q: int) -> DataFrame:
    """Couplings of a small model to try things on, by a formula."""
    from ..operators.marginals import grid

    return grid(spark, length, q).withColumn("cpl", F.expr("(((i*31 + j*17 + a*7 + b*13) % 17) - 8) / 16.0D"))


def fields(spark: SparkSession, length: int, q: int) -> DataFrame:
    """Fields of a small model to try things on, by a formula."""
    from ..operators.marginals import uni_grid

    return uni_grid(spark, length, q).withColumn("h", F.expr("(((pos*5 + res*3) % 9) - 4) / 8.0D"))


def table_couplings(counts: DataFrame) -> DataFrame:
    """(i, j, a, b, cpl) from pair counts: minus the covariance, by a power of two near the count to the 3/2.

    All values are whole multiples of one power of two, so that sums are exact in any order.
    """
    from ..operators.marginals import COLUMN, PAIR, ROW

    n, x = F.col("n").cast("double"), counts.repartition("i", "j")
    total = F.sum(n).over(PAIR())
    c = n * total - F.sum(n).over(ROW()) * F.sum(n).over(COLUMN())
    return x.select("i", "j", "a", "b", (-c * F.pow(F.lit(2.0), -F.ceil(F.log2(total) * 1.5 + 0.1))).alias("cpl"))


def table_fields(counts: DataFrame) -> DataFrame:
    """(pos, res, h) from counts (pos, res, n): the total less four times the count, by a power of two near its root."""
    from pyspark.sql import Window

    n = F.col("n").cast("double")
    total = F.sum(n).over(Window.partitionBy("pos"))
    return counts.select("pos", "res", ((total - 4 * n) * F.pow(F.lit(2.0), -F.ceil(F.log2(total) * 0.5 + 0.1))).alias("h"))
