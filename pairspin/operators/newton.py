"""Coupling updates and regularisers of the quasi-Newton step: projections over windows on a pair.

A step's table has (i, j, a, b, f, cpl, dj): model marginals, couplings and the change so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .marginals import COLUMN, PAIR, ROW
from .mutants import mutant_slopes, mutant_sums


def update(x: DataFrame, gamma: float, pc: float) -> DataFrame:
    """dj - gamma (target - f)/(f + pc); ``x`` has a column target too."""
    return x.withColumn("dj", F.col("dj") - gamma * (F.col("target") - F.col("f")) / (F.col("f") + pc))


def energy_weights(e: DataFrame, ref: float | None = None) -> DataFrame:
    """w = exp(-de + ref); the smallest de is the reference unless one is given, so that no weight overflows."""
    if ref is None:
        low = e.agg(F.min("de").alias("_low"))
        return e.crossJoin(F.broadcast(low)).withColumn("w", F.exp(F.col("_low") - F.col("de"))).drop("_low")
    return e.withColumn("w", F.exp(F.lit(ref) - F.col("de")))


def beta_weights(e: DataFrame, beta: float, ref: float) -> DataFrame:
    """w = exp((beta - 1)(e - ref)): from samples at ``beta`` to 1."""
    return e.withColumn("w", F.exp((beta - 1) * (F.col("e") - ref)))


def predicted_size(e: DataFrame, beta: float, beta_gen: float) -> DataFrame:
    """One row (neff): effective size expected at ``beta``, from energies at ``beta_gen``, by a Gaussian approximation."""
    v = e.agg(F.var_pop("e").alias("v"))
    x = e.crossJoin(F.broadcast(v)).withColumn("lw", -(1 - beta) * (F.col("e") - (beta_gen - beta) * F.col("v")))
    top = x.agg(F.max("lw").alias("top"))
    w = F.exp(F.col("lw") - F.col("top"))
    return x.crossJoin(F.broadcast(top)).agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("neff"))


def _zero(v: Column) -> Column:
    return v - F.avg(v).over(ROW()) - F.avg(v).over(COLUMN()) + F.avg(v).over(PAIR())


def _with_zero(x: DataFrame) -> DataFrame:
    return x.repartition("i", "j").withColumn("_v", F.col("cpl") + F.col("dj")).withColumn("_z", _zero(F.col("_v")))


def _snapped(x: DataFrame, step: Column) -> DataFrame:
    """Adds ``step``; where it would change the sign of the zero-gauge coupling, that becomes 0 instead."""
    turned = F.signum("_z") != F.signum(F.col("_z") + step)
    return x.withColumn("dj", F.col("dj") + F.when(turned, -F.col("_z")).otherwise(step)).drop("_v", "_z")


def l1z(x: DataFrame, gamma: float, pc: float, lam: float) -> DataFrame:
    return _snapped(_with_zero(x), -lam * F.signum("_z") * gamma / (F.col("f") + pc))


def l2z(x: DataFrame, gamma: float, pc: float, lam: float) -> DataFrame:
    return _snapped(_with_zero(x), -lam * F.col("_z") * gamma / (F.col("f") + pc))


def scad(v: Column, r: Column | float, a: float, inner: Column) -> Column:
    """Size of the SCAD slope: ``inner`` below r, falling to 0 at a r."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    return F.when(F.abs(v) < r, inner).when(F.abs(v) < a * r, (a * r - F.abs(v)) / (a - 1)).otherwise(0.0)


def scadj(x: DataFrame, gamma: float, pc: float, r: float, a: float = 4.0) -> DataFrame:
    if a < 2:
        raise ValueError("a is 2 or more")
    x = _with_zero(x)
    slope = scad(F.col("_z"), r, a, F.least(F.lit(float(r)), F.abs("_z") / gamma))
    return x.withColumn("dj", F.col("dj") - slope * gamma * F.signum("_z") / (F.col("f") + pc)).drop("_v", "_z")


def _with_x(x: DataFrame, pc: float) -> DataFrame:
    """Adds _c, _x = sum of c times coupling, _n = sum of c^2/(f + pc), _g = c + f (x - xab), xab in this function's own sign."""
    x = x.repartition("i", "j").withColumn("_v", F.col("cpl") + F.col("dj"))
    x = x.withColumn("_fa", F.sum("f").over(ROW())).withColumn("_fb", F.sum("f").over(COLUMN())).withColumn("_c", F.col("f") - F.col("_fa") * F.col("_fb"))
    x = x.withColumn("_x", F.sum(F.col("_v") * F.col("_c")).over(PAIR())).withColumn("_n", F.sum(F.col("_c") * F.col("_c") / (F.col("f") + pc)).over(PAIR()))
    t = F.sum(F.col("_v") * F.col("_fa") * F.col("_fb")).over(PAIR())
    xab = t - F.sum(F.col("_v") * F.col("_fb")).over(ROW()) - F.sum(F.col("_v") * F.col("_fa")).over(COLUMN()) + F.col("_v")
    return x.withColumn("_g", F.col("_c") + F.col("f") * (F.col("_x") - xab))


def _done(x: DataFrame, step: Column) -> DataFrame:
    return x.withColumn("dj", F.col("dj") - step).drop("_v", "_fa", "_fb", "_c", "_x", "_n", "_g")


def x_norm(x: DataFrame, gamma: float, pc: float, lam: Column | float) -> DataFrame:
    """Pull of each pair's X to 0 by ``lam``, a number or a column, clipped so that X doesn't cross 0."""
    x = _with_x(x, pc)
    size = F.least(lam if isinstance(lam, Column) else F.lit(float(lam)), F.try_divide(F.abs("_x"), F.col("_n") * gamma))
    return _done(x, F.coalesce(gamma * size * F.col("_c") * F.signum("_x") / (F.col("f") + pc), F.lit(0.0)))


def scadx(x: DataFrame, gamma: float, pc: float, cost: float, r: float, a: float = 4.0) -> DataFrame:
    """SCAD on X; ``cost`` is what a large X costs."""
    if a < 2:
        raise ValueError("a is 2 or more")
    s = 2 * cost / ((1 + a) * r * r)
    x = _with_x(x, pc)
    slope = scad(F.col("_x"), r, a, F.least(F.lit(float(r)), F.coalesce(F.try_divide(F.abs("_x"), F.col("_n") * gamma * s), F.lit(0.0))))
    return _done(x, slope * F.signum("_x") * gamma * s * F.col("_g") / (F.col("f") + pc))


def exp_x(x: DataFrame, gamma: float, pc: float, lam: float) -> DataFrame:
    x = _with_x(x, pc)
    return _done(x, gamma * F.signum("_x") * F.exp(-F.abs("_x") / lam) * F.col("_g") / (F.col("f") + pc))


def _changed(x: DataFrame) -> DataFrame:
    return x.select("i", "j", "a", "b", (F.col("cpl") + F.col("dj")).alias("cpl"))


def dde(x: DataFrame, gamma: float, pc: float, lam: float, q: int) -> DataFrame:
    """Pull of every double-mutant energy to 0, by ``lam``."""
    grad = mutant_sums(_changed(x), q).select("i", "j", "a", "b", (F.col("sign") / (q - 1) ** 2).alias("_r"))
    return x.join(grad, ["i", "j", "a", "b"]).withColumn("dj", F.col("dj") - lam * F.col("_r") * gamma / (F.col("f") + pc)).drop("_r")


def scad_dde(x: DataFrame, gamma: float, pc: float, lam: float, r: float | None, q: int, a: float = 4.0) -> DataFrame:
    """SCAD on each double-mutant energy, of slope ``lam`` up to ``r`` (``lam`` unless given), from where it falls to 0 at a r."""
    r = lam if r is None else r
    if a < 2 or r <= 0:
        raise ValueError("a is 2 or more, and r above 0")
    grad = mutant_slopes(_changed(x), q, r, a).select("i", "j", "a", "b", (lam * F.col("slope") / (q - 1) ** 2).alias("_r"))
    return x.join(grad, ["i", "j", "a", "b"]).withColumn("dj", F.col("dj") - F.col("_r") * gamma / (F.col("f") + pc)).drop("_r")


def regulariser(spec: str, q: int) -> Callable[[DataFrame, float, float], DataFrame]:
    """From ``type:arg[:arg[:arg]]``: l2z, l1z, SCADJ, X, SCADX, expX, ddE, SCADddE.

    Xij, whose argument names a table of strengths, wants these as a column named lam.
    """
    name, *text = spec.split(":")
    args = [] if name == "Xij" else [float(t) for t in text if t]
    known: dict[str, tuple[int, int, Callable]] = {
        "l1z": (1, 1, l1z),
        "l2z": (1, 1, l2z),
        "SCADJ": (1, 2, scadj),
        "X": (1, 1, x_norm),
        "Xij": (0, 0, lambda x, g, p: x_norm(x, g, p, F.col("lam"))),
        "SCADX": (2, 3, scadx),
        "expX": (1, 1, exp_x),
        "ddE": (1, 1, lambda x, g, p, lam: dde(x, g, p, lam, q)),
        "SCADddE": (1, 2, lambda x, g, p, lam, r=None: scad_dde(x, g, p, lam, r, q)),
    }
    if name not in known or not known[name][0] <= len(args) <= known[name][1]:
        raise ValueError(f"no regulariser {spec}")
    return lambda x, gamma, pc: known[name][2](x, gamma, pc, *args)
