"""Energies of sequences, and interaction scores of position pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import xlogy_ratio
from ..functions.ship import ship
from .gauge import zero_couplings
from .marginals import PAIR, independent, pair_bins, to_unimarg, with_sides
from .mutants import mutant_sums
from .pairs import of_pairs

#: Couplings are broadcast to map tasks up to so many values (8 bytes each); beyond, they are joined.
BROADCAST_COUPLINGS = 32_000_000
KEY = ["i", "j", "a", "b"]


def energy_terms(msa: DataFrame, couplings: DataFrame, length: int) -> DataFrame:
    """(seq_id, i, j, e): what each pair adds to a sequence's energy; an equi-join with the couplings."""
    return pair_bins(msa, length, "seq_id").join(couplings, KEY).select("seq_id", "i", "j", F.col("cpl").alias("e"))


def coupling_array(couplings: DataFrame, length: int, q: int) -> np.ndarray:
    """Driver copy [i, j, a, b] of both orders, for map tasks; couplings are model parameters, not data."""
    t = couplings.select(*KEY, "cpl").toArrow()
    i, j, a, b, v = (t.column(c).to_numpy() for c in range(5))
    out = np.zeros((length, length, q, q))
    out[i, j, a, b] = v
    out[j, i, b, a] = v
    return out


def energies(msa: DataFrame, couplings: DataFrame, length: int, q: int, how: str | None = None) -> DataFrame:
    """(seq_id, e): sum of couplings over all pairs of each sequence.

    ``how``: ``array`` maps batches against a broadcast array, ``join`` joins; by default the array if its size allows.
    """
    if how is None:
        how = "array" if length * length * q * q <= BROADCAST_COUPLINGS else "join"
    if how == "join":
        return energy_terms(msa, couplings, length).groupBy("seq_id").agg(F.sum("e").alias("e"))
    ship(msa.sparkSession)
    shared = msa.sparkSession.sparkContext.broadcast(coupling_array(couplings, length, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.asarray(batch.column(1).flatten()).reshape(-1, length)
            e = np.zeros(len(s))
            for i in range(length - 1):
                for j in range(i + 1, length):
                    e += shared.value[i, j][s[:, i], s[:, j]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e)], names=["seq_id", "e"])

    return msa.select("seq_id", "seq").mapInArrow(run, "seq_id long, e double")


def independent_energies(msa: DataFrame, fields: DataFrame) -> DataFrame:
    """(seq_id, e): sum of fields."""
    rows = msa.select("seq_id", F.posexplode("seq").alias("pos", "res"))
    return rows.join(fields, ["pos", "res"]).groupBy("seq_id").agg(F.sum("h").alias("e"))


def energy_changes(msa: DataFrame, couplings: DataFrame, position: int, letter: int) -> DataFrame:
    """(seq_id, de) of setting ``position`` to ``letter`` in each sequence."""
    from .gauge import unpacked

    there = unpacked(couplings).where(F.col("i") == position).select("j", "a", "b", "cpl")
    other = msa.select("seq_id", F.expr(f"seq[{position}]").alias("old"), F.posexplode("seq").alias("j", "b")).where(F.col("j") != position)
    new = there.where(F.col("a") == letter).select("j", "b", F.col("cpl").alias("new"))
    old = there.select("j", F.col("a").alias("old"), "b", F.col("cpl").alias("was"))
    return other.join(new, ["j", "b"]).join(old, ["j", "old", "b"]).groupBy("seq_id").agg(F.sum(F.col("new") - F.col("was")).alias("de"))


def energy_summary(e: DataFrame) -> DataFrame:
    """One row (min_e, mean_e, std_e), the population's deviation."""
    return e.agg(F.min("e").alias("min_e"), F.avg("e").alias("mean_e"), F.stddev_pop("e").alias("std_e"))


def both(ff: DataFrame, couplings: DataFrame) -> DataFrame:
    """Pair table and couplings in one, dealt by pair."""
    return ff.select(*KEY, "f").join(couplings.select(*KEY, "cpl"), KEY).repartition("i", "j")


def pair_energy(x: DataFrame) -> DataFrame:
    """Adds fa, fb, c, and xab = -t + t_i[b] + t_j[a] - J, whose mean under f is the pair's X = -sum of c J."""
    from .marginals import COLUMN, ROW

    x = x.withColumn("fa", F.sum("f").over(ROW())).withColumn("fb", F.sum("f").over(COLUMN())).withColumn("c", F.col("f") - F.col("fa") * F.col("fb"))
    t = F.sum(F.col("fa") * F.col("fb") * F.col("cpl")).over(PAIR())
    t_a = F.sum(F.col("fb") * F.col("cpl")).over(ROW())
    t_b = F.sum(F.col("fa") * F.col("cpl")).over(COLUMN())
    return x.withColumn("xab", -t + t_a + t_b - F.col("cpl"))


def xij(ff: DataFrame, couplings: DataFrame) -> DataFrame:
    """(i, j, score)."""
    return pair_energy(both(ff, couplings)).groupBy("i", "j").agg((-F.sum(F.col("c") * F.col("cpl"))).alias("score"))


def xijab(ff: DataFrame, couplings: DataFrame) -> DataFrame:
    """(i, j, a, b, xab)."""
    return pair_energy(both(ff, couplings)).select(*KEY, "xab")


def total_x(ff: DataFrame, couplings: DataFrame) -> DataFrame:
    """One row (x): sum of covariance times coupling, of opposite sign to ``xij``."""
    return pair_energy(both(ff, couplings)).agg(F.sum(F.col("c") * F.col("cpl")).alias("x"))


def xab_of_sequence(ff: DataFrame, couplings: DataFrame, sequence: list[int]) -> DataFrame:
    """(i, j, xab, excess): the sequence's letters looked up, and their difference from the pair's X."""
    found = F.array(*map(F.lit, sequence))
    x = pair_energy(both(ff, couplings)).withColumn("x", -F.sum(F.col("c") * F.col("cpl")).over(PAIR()))
    return x.where((F.get(found, F.col("i")) == F.col("a")) & (F.get(found, F.col("j")) == F.col("b"))).select("i", "j", "xab", (F.col("xab") - F.col("x")).alias("excess"))


def double_mutants(couplings: DataFrame) -> DataFrame:
    """(i, j, a, b, g, d, dde) = -J_ab + J_ad + J_gb - J_gd for g, d other than a, b: equi-joins within a pair.

    The full list has q^4 rows a pair; sums over it come from ``mutants`` without it.
    """
    j = couplings.select(*KEY, "cpl")
    ab = j.withColumnRenamed("cpl", "ab")
    ad = j.select("i", "j", "a", F.col("b").alias("d"), F.col("cpl").alias("ad"))
    gb = j.select("i", "j", F.col("a").alias("g"), "b", F.col("cpl").alias("gb"))
    gd = j.select("i", "j", F.col("a").alias("g"), F.col("b").alias("d"), F.col("cpl").alias("gd"))
    x = ab.join(ad, ["i", "j", "a"]).where("b <> d").join(gb, ["i", "j", "b"]).where("a <> g").join(gd, ["i", "j", "g", "d"])
    return x.select(*KEY, "g", "d", (-F.col("ab") + F.col("ad") + F.col("gb") - F.col("gd")).alias("dde"))


def rdde(couplings: DataFrame, q: int) -> tuple[DataFrame, DataFrame]:
    """(i, j, score) and its gradient (i, j, a, b, grad); the sign of a cycle is that of J_ab here.  All q letters are there at each position."""
    m = mutant_sums(couplings, q)
    r = m.groupBy("i", "j").agg((F.sum("size") / (4 * (q - 1) ** 2)).alias("score"))
    return r, m.select(*KEY, (F.col("sign") / (q - 1) ** 2).alias("grad"))


WEIGHTS = {
    "fbw": lambda f, fi: f,
    "fbwsqrt": lambda f, fi: F.sqrt(f),
    "fbwsi": lambda f, fi: F.sqrt(fi),
    "fbwexp": lambda f, fi: 1 - F.exp(-4 * f),
}


def score(name: str, ff: DataFrame, couplings: DataFrame | None, q: int, pc: float = 0.0) -> DataFrame:
    """(i, j, score) by name: fb, fbw, fbwsqrt, fbwsi, fbwexp, Xij, absXij, absfXij, MI, DI, maxC, TVDC, RddE.

    MI, maxC and TVDC need no couplings.  ``pc`` is added to all bins first, and pairs normalised again.
    """
    from .marginals import pc_constant

    ff = pc_constant(ff, pc) if pc else ff
    if couplings is None and name not in ("MI", "maxC", "TVDC"):
        raise ValueError(f"{name} needs couplings")
    per = lambda x, e: x.groupBy("i", "j").agg(e.alias("score"))
    if name in ("MI", "maxC", "TVDC"):
        x = with_sides(ff).withColumn("g", F.col("fa") * F.col("fb"))
        c = F.abs(F.col("f") - F.col("g"))
        return per(x, {"MI": F.sum(xlogy_ratio(F.col("f"), F.col("g"))), "maxC": F.max(c), "TVDC": 0.5 * F.sum(c)}[name])
    if name == "fb":
        return per(zero_couplings(couplings), F.sqrt(F.sum(F.col("cpl") * F.col("cpl"))))
    if name in WEIGHTS:
        x = both(ff, couplings).join(independent(ff).withColumnRenamed("f", "g"), KEY)
        x = zero_couplings(x.select(*KEY, "cpl", WEIGHTS[name](F.col("f"), F.col("g")).alias("w")), "w")
        return per(x, F.sqrt(F.sum((F.col("cpl") * F.col("w")) ** 2)))
    if name == "Xij":
        return xij(ff, couplings)
    if name in ("absXij", "absfXij"):
        x = pair_energy(both(ff, couplings))
        return per(x, F.sum(F.abs(F.col("xab") if name == "absXij" else F.col("f") * F.col("xab"))))
    if name == "RddE":
        return rdde(couplings, q)[0]
    if name == "DI":
        return direct_information(ff, couplings, q).select("i", "j", "score")
    raise ValueError(f"no score {name}")


#: Turns of a pair's fields at most, and the change of them all below which they are found.
TURNS, FOUND = 10_000, 1e-10


def solved(cpl: np.ndarray, f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(information, whether fields were found) of two-site models with couplings (pairs, q, q) and one-column marginals f and g (pairs, q).

    Fields of both sides are set to their marginals in turn, as logarithms, so that no weight is too large or small; pairs leave when theirs are found.
    """
    n = len(cpl)
    x, y, found = np.zeros(f.shape), np.zeros(g.shape), np.zeros(n, bool)
    left = np.arange(n)
    with np.errstate(divide="ignore"):
        lf, lg = np.log(f), np.log(g)

    def total(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis))

    for _ in range(TURNS):
        w = -cpl[left]
        new_x = lf[left] - total(w + y[left][:, None, :], 2)
        new_y = lg[left] - total(w + new_x[:, :, None], 1)
        with np.errstate(invalid="ignore"):
            moved = np.abs(np.nan_to_num(new_y - y[left], nan=0.0, posinf=np.inf, neginf=np.inf)).max(1)
        x[left], y[left] = new_x, new_y
        found[left[moved <= FOUND]] = True
        left = left[moved > FOUND]
        if not len(left):
            break
    lp = -cpl + x[:, :, None] + y[:, None, :]
    lp -= total(lp.reshape(n, -1), 1)[:, None, None]
    p = np.exp(lp)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (lp - lf[:, :, None] - lg[:, None, :]), 0.0).sum((1, 2)), found


def direct_information(ff: DataFrame, couplings: DataFrame, q: int) -> DataFrame:
    """(i, j, score, converged): information of the two-site model with the given one-column marginals.

    ``converged`` is false where fields were still moving after ``TURNS`` turns.
    """
    f = to_unimarg(ff)
    fi = f.select(F.col("pos").alias("i"), F.col("res").alias("a"), F.col("f").alias("fi"))
    fj = f.select(F.col("pos").alias("j"), F.col("res").alias("b"), F.col("f").alias("fj"))
    x = zero_couplings(couplings).join(fi, ["i", "a"]).join(fj, ["j", "b"]).select(*KEY, "cpl", "fi", "fj")
    out = of_pairs(x, ["cpl", "fi", "fj"], ["score", "converged"], lambda c, a, b: solved(c, a[:, :, 0], b[:, 0, :]), 12)
    return out.withColumn("converged", F.col("converged") > 0)
