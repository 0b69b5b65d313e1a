"""Gauge transforms of a pairwise model: fields (pos, res, h) and couplings (i, j, a, b, cpl).

All give the same probabilities.  Couplings are changed by windows on a pair; fields collect what the
couplings give up, as grouped sums by (pos, res).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marginals import COLUMN, PAIR, ROW, uni_grid


def no_fields(couplings: DataFrame, length: int, q: int) -> DataFrame:
    """Fields that are all zero."""
    return uni_grid(couplings.sparkSession, length, q).withColumn("h", F.lit(0.0))


def _summed(*fields: DataFrame) -> DataFrame:
    out = fields[0].select("pos", "res", "h")
    for f in fields[1:]:
        out = out.union(f.select("pos", "res", "h"))
    return out.groupBy("pos", "res").agg(F.sum("h").alias("h"))


def _means(couplings: DataFrame, weight: str | None) -> DataFrame:
    """Adds ma (mean over b for each a), mb (over a for each b) and mm (over all)."""
    x = couplings.repartition("i", "j")
    w = F.col(weight) if weight else F.lit(1.0)
    for name, by in (("ma", ROW()), ("mb", COLUMN()), ("mm", PAIR())):
        x = x.withColumn(name, F.sum(F.col("cpl") * w).over(by) / F.sum(w).over(by))
    return x


def zero_couplings(couplings: DataFrame, weight: str | None = None) -> DataFrame:
    """Couplings whose (weighted) row and column means vanish."""
    kept = [c for c in couplings.columns if c != "cpl"]
    return _means(couplings, weight).select(*kept, (F.col("cpl") - F.col("ma") - F.col("mb") + F.col("mm")).alias("cpl"))


def zero_j(fields: DataFrame, couplings: DataFrame, length: int, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Zero-mean couplings; the fields take up the rest, so energies stay.  Infinite parameters are an error."""
    bad = couplings.where(F.abs("cpl") == float("inf")).limit(1).count() + fields.where(F.abs("h") == float("inf")).limit(1).count()
    if bad:
        raise ValueError("no zero gauge with infinite parameters")
    m = _means(couplings, weight)
    rows = m.groupBy(F.col("i").alias("pos"), "j", F.col("a").alias("res")).agg(F.first("ma").alias("h"))
    columns = m.groupBy(F.col("j").alias("pos"), F.col("i").alias("other"), F.col("b").alias("res")).agg(F.first("mb").alias("h"))
    whole = m.groupBy("i", "j").agg(F.first("mm").alias("mm")).agg((-F.sum("mm") / length).alias("h"))
    shift = fields.select("pos", "res").crossJoin(whole)  # one row on the right
    return _summed(fields, rows, columns, shift), zero_couplings(couplings, weight)


def zero(fields: DataFrame, couplings: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """As ``zero_j``, and each position's fields have mean zero: energies shift by a constant."""
    from pyspark.sql import Window

    h, j = zero_j(fields, couplings, length)
    return h.withColumn("h", F.col("h") - F.avg("h").over(Window.partitionBy("pos"))), j


def _with_fields(fields: DataFrame, couplings: DataFrame) -> DataFrame:
    hi = fields.select(F.col("pos").alias("i"), F.col("res").alias("a"), F.col("h").alias("hi"))
    hj = fields.select(F.col("pos").alias("j"), F.col("res").alias("b"), F.col("h").alias("hj"))
    return couplings.join(hi, ["i", "a"]).join(hj, ["j", "b"])


def fieldless_distributed(fields: DataFrame, couplings: DataFrame, length: int) -> DataFrame:
    """Couplings with each field spread evenly over its position's pairs; no fields remain."""
    x = _with_fields(fields, couplings)
    return x.select("i", "j", "a", "b", (F.col("cpl") + (F.col("hi") + F.col("hj")) / (length - 1)).alias("cpl"))


def fieldless(fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """Couplings with all fields moved to the pairs of position 0; no fields remain."""
    x = _with_fields(fields, couplings)
    extra = F.when(F.col("i") == 0, F.col("hj") + F.when(F.col("j") == 1, F.col("hi")).otherwise(0.0)).otherwise(0.0)
    return x.select("i", "j", "a", "b", (F.col("cpl") + extra).alias("cpl"))


def fieldless_even(fields: DataFrame, couplings: DataFrame, length: int) -> DataFrame:
    """The canonical form: zero gauge, then fields spread evenly.  The same for all gauges of one model."""
    h, j = zero(fields, couplings, length)
    return fieldless_distributed(h, j, length)


def unpacked(couplings: DataFrame) -> DataFrame:
    """Couplings of all ordered pairs."""
    return couplings.select("i", "j", "a", "b", "cpl").union(couplings.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("a").alias("b"), "cpl"))


def tensor(couplings: DataFrame, length: int, q: int) -> DataFrame:
    """As ``unpacked``, with null rows for each position with itself."""
    spark = couplings.sparkSession
    n = spark.range(length * q * q)
    same = n.select(F.expr(f"cast(id div {q * q} as int)").alias("i"), F.expr(f"cast(id div {q * q} as int)").alias("j"), F.expr(f"cast(id div {q} % {q} as int)").alias("a"), F.expr(f"cast(id % {q} as int)").alias("b"), F.lit(None).cast("double").alias("cpl"))
    return unpacked(couplings).union(same)


def independent_model(unimarg: DataFrame, couplings: DataFrame, length: int) -> DataFrame:
    """Couplings of the model with fields -ln f, in the canonical form.  ``couplings``: zeros of the right shape."""
    h = unimarg.select("pos", "res", (-F.log("f")).alias("h"))
    return fieldless_even(h, couplings, length)
