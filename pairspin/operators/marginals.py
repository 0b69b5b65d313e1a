"""One- and two-column weighted histograms, and the algebra on them.

An alignment is (seq_id, seq array<int>) with an optional weight; a pair table is dense: (i, j, a, b, f) for
all i < j and all letters.  Pairs are counted into dense vectors (``bins``), never by a self-join; equal
sequences are grouped first if there are many.  Tables on pairs are dealt by (i, j) once, which serves every
window on a pair, its rows and its columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .bins import dense_counts
from .pairs import per_pair


def PAIR() -> WindowSpec:  # noqa: N802
    """The rows of a pair."""
    return Window.partitionBy("i", "j")


def ROW() -> WindowSpec:  # noqa: N802
    """A row of a pair: one first letter."""
    return Window.partitionBy("i", "j", "a")


def COLUMN() -> WindowSpec:  # noqa: N802
    """A column of a pair: one second letter."""
    return Window.partitionBy("i", "j", "b")


def grid(spark: SparkSession, length: int, q: int) -> DataFrame:
    """All (i, j, a, b) with i < j."""
    n = spark.range(length * length * q * q)
    at = [F.expr(f"cast(id div {length * q * q} as int)").alias("i"), F.expr(f"cast(id div {q * q} % {length} as int)").alias("j")]
    return n.select(*at, F.expr(f"cast(id div {q} % {q} as int)").alias("a"), F.expr(f"cast(id % {q} as int)").alias("b")).where("i < j")


def uni_grid(spark: SparkSession, length: int, q: int) -> DataFrame:
    """All (pos, res)."""
    return spark.range(length * q).select(F.expr(f"cast(id div {q} as int)").alias("pos"), F.expr(f"cast(id % {q} as int)").alias("res"))


def distinct_sequences(msa: DataFrame, weight: Column | None = None) -> DataFrame:
    """(seq, n): equal sequences once, with their number or summed weight."""
    return msa.groupBy("seq").agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def pair_bins(msa: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row (i, j, a, b) for each sequence and pair."""
    pairs = f"flatten(transform(sequence(0, {length - 2}), i -> transform(sequence(i + 1, {length - 1}), j -> named_struct('i', i, 'j', j, 'a', seq[i], 'b', seq[j]))))"
    return msa.select(*keep, F.expr(f"inline({pairs})"))


def bicounts(msa: DataFrame, length: int, q: int, weight: str | None = None, compress: bool = True) -> DataFrame:
    """(i, j, a, b, n): dense counts, or sums of ``weight``.

    ``compress=False`` skips the grouping of equal sequences, for alignments with few.
    """
    w = F.col(weight) if weight else None
    rows = distinct_sequences(msa, w) if compress else msa.select("seq", (w if weight else F.lit(1).cast("long")).alias("n"))
    return dense_counts(rows, length, q, weight is None)


def unicounts(msa: DataFrame, length: int, q: int, weight: str | None = None) -> DataFrame:
    """(pos, res, n): dense counts, or sums of ``weight``, at each position."""
    rows = distinct_sequences(msa, F.col(weight) if weight else None)
    zero = F.lit(0.0 if weight else 0).cast("double" if weight else "long").alias("n")
    bins = rows.select("n", F.posexplode("seq").alias("pos", "res")).select("pos", "res", "n").union(uni_grid(msa.sparkSession, length, q).select("pos", "res", zero))
    return bins.groupBy("pos", "res").agg(F.sum("n").alias("n"))


def normalised(df: DataFrame, value: str = "f", by: WindowSpec | None = None) -> DataFrame:
    """``value`` divided by its sum over each pair (or other group)."""
    return df.withColumn(value, F.try_divide(F.col(value), F.sum(value).over(by or PAIR())))


def bimarg(msa: DataFrame, length: int, q: int, weight: str | None = None, compress: bool = True) -> DataFrame:
    """(i, j, a, b, f): each pair's frequencies sum to 1."""
    counts = bicounts(msa, length, q, weight, compress).withColumnRenamed("n", "f").withColumn("f", F.col("f").cast("double"))
    return normalised(counts)


def unimarg(msa: DataFrame, length: int, q: int, weight: str | None = None) -> DataFrame:
    """(pos, res, f)."""
    counts = unicounts(msa, length, q, weight).select("pos", "res", F.col("n").cast("double").alias("f"))
    return normalised(counts, "f", Window.partitionBy("pos"))


def merge_bicounts(*parts: DataFrame) -> DataFrame:
    """Sum of several count tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n"))


def merge_bimargs(*parts: DataFrame) -> DataFrame:
    """Mean of several pair tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j", "a", "b").agg(F.avg("f").alias("f"))


def to_unimarg(ff: DataFrame) -> DataFrame:
    """(pos, res, f) from a pair table: position 0 by the rows of pair (0, 1), the others by the columns of (0, p)."""
    first = ff.where("i = 0 and j = 1").groupBy(F.lit(0).alias("pos"), F.col("a").alias("res")).agg(F.sum("f").alias("f"))
    rest = ff.where("i = 0").groupBy(F.col("j").alias("pos"), F.col("b").alias("res")).agg(F.sum("f").alias("f"))
    return normalised(first.union(rest), "f", Window.partitionBy("pos"))


def with_sides(ff: DataFrame) -> DataFrame:
    """Adds fa, fb: the pair's own one-column marginals."""
    return ff.repartition("i", "j").withColumn("fa", F.sum("f").over(ROW())).withColumn("fb", F.sum("f").over(COLUMN()))


def independent(ff: DataFrame) -> DataFrame:
    """f = fa fb."""
    return with_sides(ff).select("i", "j", "a", "b", (F.col("fa") * F.col("fb")).alias("f"))


def covariance(ff: DataFrame) -> DataFrame:
    """(i, j, a, b, c, rho): covariance and correlation; rho is null where a letter has no variance."""
    x = with_sides(ff).withColumn("c", F.col("f") - F.col("fa") * F.col("fb"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("fa") * (1 - F.col("fa")) * F.col("fb") * (1 - F.col("fb"))))
    return x.select("i", "j", "a", "b", "c", F.try_divide("c", sd).alias("rho"))


def square(scores: DataFrame, length: int, value: str = "score", diagonal: float | None = 0.0) -> DataFrame:
    """(i, j, value) for all ordered pairs; the diagonal holds ``diagonal``."""
    spark = scores.sparkSession
    same = spark.range(length).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(diagonal).cast("double").alias(value))
    return scores.select("i", "j", value).union(scores.select(F.col("j").alias("i"), F.col("i").alias("j"), value)).union(same)


def validation(ff: DataFrame, eps: float = 1e-5) -> DataFrame:
    """One row of checks: frequencies out of [0, 1], zeros, pairs that don't sum to 1, and largest difference of one-column marginals."""
    sides = ff.groupBy(F.col("i").alias("pos"), "j", F.col("a").alias("res")).agg(F.sum("f").alias("f")).select("pos", F.col("j").alias("other"), "res", "f")
    sides = sides.union(ff.groupBy(F.col("j").alias("pos"), F.col("i").alias("other"), F.col("b").alias("res")).agg(F.sum("f").alias("f")))
    off = sides.join(to_unimarg(ff).withColumnRenamed("f", "g"), ["pos", "res"]).agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("max_diff"))
    pairs = ff.groupBy("i", "j").agg(F.sum("f").alias("s")).agg(F.sum((F.abs(F.col("s") - 1) > eps).cast("long")).alias("bad_pairs"))
    cells = ff.agg(F.sum(((F.col("f") < 0) | (F.col("f") > 1)).cast("long")).alias("out_of_range"), F.sum((F.col("f") == 0).cast("long")).alias("zeros"))
    return cells.crossJoin(pairs).crossJoin(off).withColumn("consistent", F.col("max_diff") <= eps)


def kl(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row (kl): sum of p ln(p/q) over all bins."""
    from ..functions.numerics import xlogy_ratio

    both = p.select("i", "j", "a", "b", F.col("f").alias("p")).join(q.select("i", "j", "a", "b", F.col("f").alias("q")), ["i", "j", "a", "b"])
    return both.agg(F.sum(xlogy_ratio(F.col("p"), F.col("q"))).alias("kl"))


# ---- pseudocounts


def pc_mutation(ff: DataFrame, n: float, q: int, mode: str = "jeffreys") -> DataFrame:
    """Pseudocount that keeps covariances' signs; ``n`` is the effective number of sequences."""
    mu = q / (2 * n + q) if mode == "jeffreys" else q / (n + q)
    x = with_sides(ff)
    f = (1 - mu) ** 2 * F.col("f") + (1 - mu) * mu * (F.col("fa") + F.col("fb")) / q + (mu / q) ** 2
    return normalised(x.select("i", "j", "a", "b", f.alias("f")))


def pc_constant(ff: DataFrame, pc: float) -> DataFrame:
    if not 0 <= pc <= 1:
        raise ValueError("pc is from 0 to 1")
    return normalised(ff.repartition("i", "j").withColumn("f", F.col("f") + pc))


def _side_mix(ff: DataFrame, pc: float, q: int, side, weight: float) -> DataFrame:
    x = with_sides(ff)
    smoothed = lambda c: (F.col(c) + pc) / (1 + q * pc)  # noqa: E731  a side sums to 1
    return normalised(x.select("i", "j", "a", "b", ((1 - weight) * F.col("f") + weight * side(smoothed("fa"), F.col("fa")) * side(smoothed("fb"), F.col("fb"))).alias("f")))


def pc_unijmix(ff: DataFrame, pc: float, weight: float, q: int) -> DataFrame:
    """Mixture with the product of smoothed one-column marginals."""
    return _side_mix(ff, pc, q, lambda smooth, plain: smooth, weight)


def pc_meanfield(ff: DataFrame, pc: float, q: int) -> DataFrame:
    if not 0 <= pc < 1:
        raise ValueError("pc is from 0 to below 1")
    return normalised(ff.repartition("i", "j").withColumn("f", F.col("f") + pc / (1 - pc) / (q * q)))


def pc_test(ff: DataFrame, pc: float, weight: float, q: int) -> DataFrame:
    """Mixture whose one-column marginals are the smoothed ones."""
    return _side_mix(ff, pc, q, lambda smooth, plain: (smooth - (1 - weight) * plain) / weight, weight)


def pre_regularize(ff: DataFrame, n: float, steps: int = 100) -> DataFrame:
    """(i, j, a, b, f, lam): each pair mixed with independence by the largest weight that the data can't tell from none.

    Weights are ``steps`` even ones from 0 to 1; a weight passes while KL(ff || mixture) is below the expected
    one of a posterior with ``n`` observations.
    """
    lam = np.arange(steps) / float(steps - 1)
    small = (n - 1) / (2 * n * n)

    def mixed(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = f.sum(2, keepdims=True) * f.sum(1, keepdims=True)
        x, y = f.reshape(len(f), 1, -1), apart.reshape(len(f), 1, -1)
        g = (1 - lam[:, None]) * x + lam[:, None] * y
        fp = g + (1 - g) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            loss = np.where(x > 0, x * np.log(x / g), 0.0).sum(2)
            bound = np.where(g > 0, g * (np.log(fp / g) - small * g * (1 - g) / (fp * fp)), 0.0).sum(2)
        chosen = np.where(loss < bound, lam, 0.0).max(1)[:, None, None]
        return (1 - chosen) * f + chosen * apart, np.broadcast_to(chosen, f.shape)

    return per_pair(ff, ["f"], ["f", "lam"], mixed, 6 * steps)


# ---- fit statistics


def fit_stats(target: DataFrame, model: DataFrame) -> DataFrame:
    """One row (ferr, ssr, max_diff): mean relative error where the target exceeds 0.01, squared and largest difference."""
    both = target.select("i", "j", "a", "b", F.col("f").alias("t")).join(model.select("i", "j", "a", "b", F.col("f").alias("m")), ["i", "j", "a", "b"])
    d = F.col("t") - F.col("m")
    return both.agg(F.avg(F.when(F.col("t") > 0.01, F.abs(d) / F.col("t"))).alias("ferr"), F.sum(d * d).alias("ssr"), F.max(F.abs(d)).alias("max_diff"))


def expected_error(ff: DataFrame, n: float) -> DataFrame:
    """One row (ssr, ferr): what sampling ``n`` sequences alone leaves."""
    var = F.col("f") * (1 - F.col("f")) / n
    return ff.agg(F.sum(var).alias("ssr"), F.avg(F.when(F.col("f") > 0.01, F.sqrt(F.lit(2 / 3.141592653589793)) * F.sqrt(var) / F.col("f"))).alias("ferr"))


def effective_size(weights: DataFrame, w: str = "w") -> DataFrame:
    """One row (sum_w, sum_w2, neff)."""
    s = weights.agg(F.sum(w).alias("sum_w"), F.sum(F.col(w) * F.col(w)).alias("sum_w2"))
    return s.withColumn("neff", F.try_divide(F.col("sum_w") * F.col("sum_w"), F.col("sum_w2")))
