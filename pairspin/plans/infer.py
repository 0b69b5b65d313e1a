"""Inference of couplings: rounds of sampling and reweighted quasi-Newton steps.

The driver holds the loop, and once a round the model (L^2 q^2 numbers) that the sampler needs in every task; steps of models beyond ``WHOLE`` numbers go
over tiles (``tiles``), with three numbers a step on the driver.  Walkers live in Parquet tables of the shared folder: each
round reads the last one's, so lineage stays short and a lost executor costs one round at most.  A Newton step is
one pass over the walkers: partial weighted bins in each task, summed by bin.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numerics import spearman, spearman_p
from ..functions.ship import ship
from ..functions.storage import kept, scratch, stored
from ..operators import newton, sampling, scores
from . import tiles

KEY = ["i", "j", "a", "b"]
#: Numbers of a model (L^2 q^2) up to which a step sends it whole to every task, 8 bytes each; beyond, steps go over tiles.
WHOLE = 8_000_000


@dataclass
class Options:
    """Options of a fit; the defaults are those of a full run."""

    walkers: int = 1 << 15
    rounds: int = 64
    newton_steps: int = 1024
    newton_delta: int = 32
    keep_size: float = 0.9
    gamma: float = 0.0004
    damping: float = 0.001
    regulariser: str | None = None  # type:arg[:arg[:arg]]; Xij:path has a strength for each pair, see ``pair_strengths``
    reseed: str = "single_indep"
    equilibration: int | None = None  # steps; None: until energies decorrelate
    min_equilibration: int = 64
    max_equilibration: int = 32768
    beta: float | None = None
    seed: int = 0
    start: str = "uniform"  # couplings: uniform (zero) or independent
    preopt: bool = False  # Newton steps on the first sequences, before any sampling
    tempering: tuple[float, ...] | None = None  # inverse temperatures, dealt to the walkers in turn
    swaps: int = 128  # rounds of swaps after every ``swap_every`` steps
    swap_every: int = 256
    track: int = 0  # steps between snapshots of a round's sampling; 0: none
    tracked: tuple[str, ...] = ("bim", "E")  # of bim, E, seq
    own_positions: bool = False  # each walker draws its own position in a step

    def __post_init__(self):
        if self.tempering and self.beta is not None:
            raise ValueError("tempering and beta exclude each other")
        if unknown := set(self.tracked) - {"bim", "E", "seq"}:
            raise ValueError(f"can't track {sorted(unknown)}")

    @property
    def sampled_beta(self) -> float | None:
        """Inverse temperature of the walkers that count; None: 1, and no reweighting for it."""
        top = max(self.tempering) if self.tempering else self.beta
        return None if self.tempering and top == 1 else top


@dataclass
class Fit:
    couplings: DataFrame
    log: list[dict] = field(default_factory=list)


def packed(j: np.ndarray) -> pd.DataFrame:
    """(i, j, a, b, cpl) of an array [i, j, a, b]."""
    length, q = j.shape[0], j.shape[2]
    x, y = np.triu_indices(length, 1)
    a, b = np.divmod(np.arange(q * q), q)
    frame = {"i": np.repeat(x, q * q), "j": np.repeat(y, q * q), "a": np.tile(a, len(x)), "b": np.tile(b, len(x))}
    return pd.DataFrame({k: v.astype(np.int32) for k, v in frame.items()} | {"cpl": j[x, y].reshape(-1)})


def unpacked(v: np.ndarray, length: int, q: int) -> np.ndarray:
    """Array [i, j, a, b] of both orders, from pairs in order."""
    x, y = np.triu_indices(length, 1)
    out = np.zeros((length, length, q, q))
    v = v.reshape(-1, q, q)
    out[x, y], out[y, x] = v, v.transpose(0, 2, 1)
    return out


def with_energies(walkers: DataFrame, j: np.ndarray) -> DataFrame:
    """Adds e to (walker_id, seq, beta)."""
    ship(walkers.sparkSession)
    shared, length = walkers.sparkSession.sparkContext.broadcast(j), j.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, length)
            e = sum((shared.value[x, y][s[:, x], s[:, y]] for x in range(length - 1) for y in range(x + 1, length)), np.zeros(len(s)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(e)], names=["walker_id", "seq", "beta", "e"])

    return walkers.select("walker_id", "seq", "beta").mapInArrow(run, "walker_id long, seq array<int>, beta double, e double")


def swapped(walkers: DataFrame, swaps: int, seed: int) -> DataFrame:
    """Walkers with their betas after rounds of swaps."""
    states = sampling.exchanged(walkers, swaps, seed).select("walker_id", "beta")
    return walkers.select("walker_id", "seq", "e").join(states, "walker_id").select("walker_id", "seq", "beta", "e")


def coldest(walkers: DataFrame) -> DataFrame:
    """Walkers at the largest beta."""
    return walkers.where(F.col("beta") == walkers.agg(F.max("beta")).first()[0])


def snapshot(walkers: DataFrame, length: int, q: int, tracked: tuple[str, ...], folder: str) -> None:
    """Of the coldest walkers bim (pair marginals), E (energies) and seq (sequences), as ``tracked`` names them; betas of all, where they differ."""
    cold = coldest(walkers)
    if "bim" in tracked:
        sums, w, _, _ = weighted_bins(cold, np.zeros((length, length, q, q)), 0.0)
        stored(walkers.sparkSession.createDataFrame(packed(np.zeros((length, length, q, q)))[KEY].assign(f=sums / w)), f"{folder}/bimarg")
    if "E" in tracked:
        stored(walkers.select("walker_id", "beta", "e"), f"{folder}/energies")
    if "seq" in tracked:
        stored(cold.select("walker_id", "seq"), f"{folder}/seqs")


def _once(spark: SparkSession, made: Callable[[], DataFrame], path: str | None, name: str) -> DataFrame:
    """What ``made`` gives, stored under ``path``, or read if a run before has finished it; under a new path without one."""
    if path and exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    return stored(made(), path or scratch(spark, name))


def equilibrate(
    spark: SparkSession,
    walkers: DataFrame,
    j: np.ndarray,
    seed: int,
    steps: int | None = None,
    least: int = 64,
    most: int = 32768,
    block: int = 8,
    o: Options | None = None,
    folder: str | None = None,
    log: str | None = None,
) -> DataFrame:
    """(walker_id, seq, beta, e) after ``steps`` steps, or by rank correlation of energies.

    Automatic: 8 blocks, then 8, 16, 32 ... more; it stops once three snapshots are there, the last one's energies
    are uncorrelated (p > 0.02) with both before it, and ``least`` steps are done; or at ``most`` steps.
    ``o`` tells of tempering, of positions, and of the snapshots kept in ``folder``/step_N: every ``track`` steps, or one after
    each stretch of an automatic run.  Where steps are cut doesn't change a chain without tempering.
    ``log``: a folder that keeps the walkers of each stretch; what is there from a run that broke off is read, not sampled again.
    """
    o = o or Options()
    done = 0

    def on(walkers: DataFrame, end: int) -> DataFrame:
        """To step ``end``, with swaps at each multiple of ``swap_every`` and at the end."""
        nonlocal done
        swaps = range((done // o.swap_every + 1) * o.swap_every, end, o.swap_every) if o.tempering else ()
        shots = range((done // o.track + 1) * o.track, end, o.track) if o.track and steps is not None else ()
        for at in sorted({*swaps, *shots, end}):
            before, from_ = walkers, done
            walkers = _once(spark, lambda: with_energies(sampling.metropolis(before, j, at - from_, seed, from_, o.own_positions), j), log and f"{log}/step_{at}", "walkers")
            done = at
            if o.tempering and (at == end or at % o.swap_every == 0):
                moved = walkers
                walkers = _once(spark, lambda: swapped(moved, o.swaps, seed + at), log and f"{log}/swapped_{at}", "swapped")
            if o.track and folder and (at % o.track == 0 if steps is not None else at == end):
                snapshot(walkers, j.shape[0], j.shape[2], o.tracked, f"{folder}/step_{at}")
        return walkers

    if steps is not None:
        return on(walkers, steps)
    size, taken, snapshots = 8, walkers, []
    while True:
        taken = on(taken, done + size * block)
        snapshots.append(taken.select("walker_id", F.col("e").alias(f"e{len(snapshots)}")))
        if done >= most:
            return taken
        if len(snapshots) >= 3 and done >= least:
            ps = []
            for back in (2, 3):
                x = snapshots[-1].join(snapshots[-back], "walker_id")
                row = spearman(x, *x.columns[1:]).first()
                ps.append(spearman_p(row.rho if row.rho is not None else 1.0, row.n))
            if min(ps) > 0.02:
                return taken
        size = size if len(snapshots) == 1 else size * 2


def tempered(spark: SparkSession, walkers: DataFrame, j: np.ndarray, seed: int, loops: int, steps: int, swaps: int = 128) -> DataFrame:
    """Walkers at the largest beta after ``loops`` of ``steps`` steps, each with ``swaps`` rounds of swaps after it."""
    o = Options(tempering=(1.0,), swaps=swaps, swap_every=steps)
    return coldest(equilibrate(spark, walkers, j, seed, loops * steps, o=o))


def weighted_bins(walkers: DataFrame, dj: np.ndarray, ref: float, beta: float | None = None) -> tuple[np.ndarray, float, float, float]:
    """(weighted pair sums in order of pairs, sum of weights, of their squares, least change of energy) under couplings changed by ``dj``."""
    ship(walkers.sparkSession)
    shared, length, q = walkers.sparkSession.sparkContext.broadcast(dj), dj.shape[0], dj.shape[2]
    cells = length * (length - 1) // 2 * q * q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, low = np.zeros(cells + 2), np.inf
        for b in batches:
            s = np.asarray(b.column(0).flatten(), np.int64).reshape(-1, length)
            pairs = [(x, y) for x in range(length - 1) for y in range(x + 1, length)]
            de = sum((shared.value[x, y][s[:, x], s[:, y]] for x, y in pairs), np.zeros(len(s)))
            if beta is not None:
                de = de - (beta - 1) * b.column(1).to_numpy()
            w = np.exp(ref - de)
            for n, (x, y) in enumerate(pairs):
                bins[n * q * q : (n + 1) * q * q] += np.bincount(s[:, x] * q + s[:, y], w, q * q)
            bins[cells] += w.sum()
            bins[cells + 1] += (w * w).sum()
            low = min(low, de.min(initial=np.inf))
        at = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(bins[at], 0.0)), pa.array(np.append(np.full(len(at), np.inf), low))], names=["bin", "v", "low"])

    t = walkers.select("seq", "e").mapInArrow(run, "bin long, v double, low double").groupBy("bin").agg(F.sum("v").alias("v"), F.min("low").alias("low")).toArrow()
    out = np.zeros(cells + 3)
    at = t.column(0).to_numpy()
    out[at] = t.column(1).to_numpy()
    shared.destroy()  # a fit makes one of them a step
    return out[:cells], float(out[cells]), float(out[cells + 1]), float(t.column(2).to_numpy()[at == -1][0])


def pair_strengths(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, lam) of a Parquet table with these columns, or of an .npy vector of all pairs in order."""
    if not path.endswith(".npy"):
        return spark.read.parquet(path).select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("lam").cast("double"))
    v = np.load(io.BytesIO(spark.read.format("binaryFile").load(path).first().content)).reshape(-1)
    i, j = np.triu_indices((1 + isqrt(1 + 8 * len(v))) // 2, 1)
    if len(i) != len(v):
        raise ValueError(f"{path} has {len(v)} values, not one a pair")
    return spark.createDataFrame(pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "lam": v.astype(float)}))


#: Steps after which the state of a run of steps is written again.
LOGGED = 32


def last_logged(spark: SparkSession, log: str | None, steps: int) -> int:
    """The last step up to ``steps`` whose state is in the log, 0 for none."""
    return next((n for n in range(steps // LOGGED * LOGGED, 0, -LOGGED) if exists(spark, f"{log}/step_{n}/_SUCCESS")), 0) if log else 0


def newton_steps(spark: SparkSession, walkers: DataFrame, j: np.ndarray, target: np.ndarray, o: Options, steps: int, log: str | None = None) -> tuple[np.ndarray, dict, np.ndarray]:
    """Couplings after up to ``steps`` reweighted steps, which end when the effective size falls below the kept share.  The walkers are kept in executors for it.

    With them the state, and the pair marginals that the reweighted walkers predict for the new couplings, in order of pairs.
    ``log``: a folder that keeps what the steps go on from, every ``LOGGED`` steps; what is there from a run that broke off is gone on from.
    """
    lam = pair_strengths(spark, o.regulariser.split(":", 1)[1]) if o.regulariser and o.regulariser.startswith("Xij:") else None
    if j.size > WHOLE:
        length, q = j.shape[0], j.shape[2]
        regular = newton.regulariser(o.regulariser, q) if o.regulariser else None
        bins = kept(spark.createDataFrame(packed(j).assign(target=target)), "model")
        found, predicted, state = tiles.newton_steps(walkers, bins, length, q, o.gamma, o.damping, steps, o.keep_size, o.sampled_beta, regular, lam, log)
        return scores.coupling_array(found, length, q), state, predicted.orderBy(*KEY).select("f").toArrow().column(0).to_numpy()
    walkers = walkers.persist()
    try:
        return _newton_steps(spark, walkers, j, target, o, steps, lam, log)
    finally:
        walkers.unpersist()


def _newton_steps(spark: SparkSession, walkers: DataFrame, j: np.ndarray, target: np.ndarray, o: Options, steps: int, lam: DataFrame | None, log: str | None) -> tuple[np.ndarray, dict, np.ndarray]:
    length, q, beta = j.shape[0], j.shape[2], o.sampled_beta
    regular = newton.regulariser(o.regulariser, q) if o.regulariser else None
    base = packed(j)
    strengths = base[["i", "j"]].merge(lam.toPandas(), how="left")[["lam"]] if lam is not None else None
    if strengths is not None and strengths["lam"].isna().any():
        raise ValueError("a pair has no strength")
    done = last_logged(spark, log, steps)
    if done:
        kept_ = np.load(io.BytesIO(spark.read.parquet(f"{log}/step_{done}").first().state))
        dj, sums, (w, w2, low, size0) = kept_["dj"], kept_["sums"], kept_["scalars"].tolist()
    else:
        dj = np.zeros(len(base))
        sums, w, w2, low = weighted_bins(walkers, np.zeros_like(j), 0.0, beta)
        if beta is not None:
            sums, w, w2, low = weighted_bins(walkers, np.zeros_like(j), low, beta)
        size0 = w * w / w2
    size = w * w / w2
    while done < steps and (not done or size >= o.keep_size * size0):
        f = sums / w
        dj = dj - o.gamma * (target - f) / (f + o.damping)
        if regular:
            x = base.assign(f=f, dj=dj)
            x = spark.createDataFrame(x if strengths is None else x.assign(lam=strengths["lam"].to_numpy()))
            dj = regular(x, o.gamma, o.damping).orderBy(*KEY).select("dj").toArrow().column(0).to_numpy()
        done += 1
        step = unpacked(dj, length, q)
        # the last step's least change keeps weights in range; it cancels in all that is used
        new = weighted_bins(walkers, step, low if np.isfinite(low) else 0.0, beta)
        if not np.isfinite(new[1]) or new[1] == 0:
            new = weighted_bins(walkers, step, new[3], beta)
        sums, w, w2, low = new
        size = w * w / w2
        if log and done % LOGGED == 0:
            held = io.BytesIO()
            np.savez(held, dj=dj, sums=sums, scalars=np.array([w, w2, low, size0]))
            stored(spark.createDataFrame([(held.getvalue(),)], "state binary"), f"{log}/step_{done}")
    return unpacked(base["cpl"].to_numpy() + dj, length, q), {"steps": done, "size": size, "size0": size0}, sums / w


def reseeded(spark: SparkSession, walkers: DataFrame, policy: str, o: Options, uni: list[list[float]], round_: int, msa: DataFrame | None = None) -> DataFrame:
    """Walkers to begin the next round with: none, single_best, single_random, single_indep, independent, uniform or msa (rows seq_id, seq, over and over)."""
    length, q = len(uni), len(uni[0])
    if policy == "none":
        return walkers.select("walker_id", "seq", "beta")
    if policy in ("independent", "uniform"):
        new = sampling.independent_sequences(spark, o.walkers, uni, o.seed + round_) if policy == "independent" else sampling.uniform_sequences(spark, o.walkers, length, q, o.seed + round_)
    elif policy == "msa":
        n, last = msa.agg(F.count("*"), F.max("seq_id")).first()
        whole, rest = divmod(o.walkers, n)
        parts = [msa.select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("k"))] if whole else []
        if rest:
            parts.append(msa.orderBy(F.xxhash64("seq_id"), "seq_id").limit(rest).select("seq_id", "seq", F.lit(whole).alias("k")))
        # numbers follow from the rows', whatever the partitions
        new = reduce(DataFrame.unionByName, parts).select((F.col("k") * F.lit(last + 1) + F.col("seq_id")).alias("seq_id"), "seq")
    else:
        one = {
            "single_best": lambda: walkers.orderBy("e", "walker_id").limit(1),
            "single_random": lambda: walkers.orderBy(F.xxhash64("walker_id", F.lit(o.seed + round_))).limit(1),
            "single_indep": lambda: sampling.independent_sequences(spark, 1, uni, o.seed + round_),
        }[policy]().first()
        new = spark.range(o.walkers).select(F.col("id").alias("seq_id"), F.array(*map(F.lit, one.seq)).alias("seq"))
    return with_betas(new, o)


def with_betas(rows: DataFrame, o: Options) -> DataFrame:
    """Walkers (walker_id, seq, beta) of sequences (seq_id, seq); inverse temperatures are dealt in turn."""
    betas = o.tempering or (o.beta or 1.0,)
    beta = F.element_at(F.array(*(F.lit(float(b)) for b in betas)), (F.pmod("seq_id", F.lit(len(betas))) + 1).cast("int"))
    return rows.select(F.col("seq_id").alias("walker_id"), "seq", beta.alias("beta"))


def fit(spark: SparkSession, target: DataFrame, length: int, q: int, o: Options | None = None, folder: str | None = None, msa: DataFrame | None = None, couplings: DataFrame | None = None) -> Fit:
    """Couplings whose pair marginals are ``target``'s.

    ``folder`` keeps of each round ``run_NN``: couplings, walkers (with energies; of a tempered run all, of which the coldest count), bimarg
    (the walkers' pair marginals, before the round's steps), predicted (those expected after them), state, and equilibration (the
    snapshots, if tracked); while it goes on also log, from which a fit that was broken off inside the round goes on.  With ``Options.preopt`` the rounds begin after Newton steps on ``msa``, or else on sequences of the
    reseeding policy; ``preopt`` then holds the same tables.  A fit that finds rounds there goes on after the last one as it would have without the break.
    ``couplings`` (i, j, a, b, cpl), such as a stored round's, begin the first round in place of ``Options.start``.
    """
    from ..operators import gauge
    from ..operators.marginals import to_unimarg

    o = o or Options()
    t = target.orderBy(*KEY).select("f").toArrow().column(0).to_numpy()
    uni = [[0.0] * q for _ in range(length)]
    for r in to_unimarg(target).collect():
        uni[r.pos][r.res] = r.f
    folder = folder or scratch(spark, "fit")
    log = _rounds(spark, folder)
    if log:
        j = scores.coupling_array(spark.read.parquet(f"{folder}/run_{len(log) - 1:02d}/couplings"), length, q)
    elif couplings is not None:
        j = scores.coupling_array(couplings, length, q)
    elif o.start == "independent":
        zero = target.select(*KEY, F.lit(0.0).alias("cpl"))
        j = scores.coupling_array(gauge.independent_model(to_unimarg(target).where("f > 0"), zero, length), length, q)
    else:
        j = np.zeros((length, length, q, q))
    if o.preopt and not log:
        if not _ended(spark, f"{folder}/preopt"):
            policy = "msa" if msa is not None else o.reseed if o.reseed in ("uniform", "single_indep") else "independent"
            first = stored(with_energies(reseeded(spark, None, policy, replace(o, beta=None, tempering=None), uni, 0, msa), j), f"{folder}/preopt/walkers")
            _bimarg_of(spark, first, j, f"{folder}/preopt")
            j, state, predicted = newton_steps(spark, first, j, t, replace(o, beta=None, tempering=None), o.newton_steps)
            _keep(spark, j, predicted, state, o, f"{folder}/preopt")
        j = scores.coupling_array(spark.read.parquet(f"{folder}/preopt/couplings"), length, q)
    walkers = spark.read.parquet(f"{folder}/run_{len(log) - 1:02d}/walkers") if log else None
    budget, worst = log[-1]["budget"] if log else o.newton_steps, [state["ssr"] for state in log]
    for n in range(len(log), o.rounds):
        policy = o.reseed if n or o.reseed == "msa" else "independent" if o.reseed == "none" else o.reseed
        if walkers is None and policy in ("single_best", "single_random", "none"):
            policy = "independent"
        run = f"{folder}/run_{n:02d}"
        seeds = coldest(walkers) if walkers is not None and o.tempering and policy != "none" else walkers
        start = reseeded(spark, seeds, policy, o, uni, n, msa)
        sampled = equilibrate(spark, start, j, o.seed + 7919 * n, o.equilibration, o.min_equilibration, o.max_equilibration, o=o, folder=f"{run}/equilibration", log=f"{run}/log/walkers")
        walkers = _once(spark, lambda: sampled, f"{run}/walkers", "")
        cold = coldest(walkers) if o.tempering else walkers
        ssr = float(((_bimarg_of(spark, cold, j, run) - t) ** 2).sum())
        if len(worst) >= 1 and ssr > (worst[-1] + min(worst)) / 2:
            budget = max(o.newton_delta, budget - int(1.5 * o.newton_delta))
        worst.append(ssr)
        j, state, predicted = newton_steps(spark, cold, j, t, o, budget, f"{run}/log/newton")
        budget = min(2048, max(o.newton_delta, state["steps"]) + o.newton_delta)
        state |= {"round": n, "ssr": ssr, "budget": budget}
        log.append(state)
        _keep(spark, j, predicted, state, o, run)
        _remove(spark, f"{run}/log")
    return Fit(spark.createDataFrame(packed(j)), log)


def _bimarg_of(spark: SparkSession, walkers: DataFrame, j: np.ndarray, folder: str) -> np.ndarray:
    """Pair marginals of the walkers in order of pairs, which are stored."""
    sums, w, _, _ = weighted_bins(walkers, np.zeros_like(j), 0.0)
    stored(spark.createDataFrame(packed(j)[KEY].assign(f=sums / w)), f"{folder}/bimarg")
    return sums / w


def _keep(spark: SparkSession, j: np.ndarray, predicted: np.ndarray, state: dict, o: Options, folder: str) -> None:
    """Stores what a round found; the state comes last."""
    table = packed(j)
    stored(spark.createDataFrame(table[KEY].assign(f=predicted)), f"{folder}/predicted")
    stored(spark.createDataFrame(table), f"{folder}/couplings")
    spark.createDataFrame([(json.dumps(state | {"options": asdict(o)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _ended(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/state/_SUCCESS")


def _rounds(spark: SparkSession, folder: str) -> list[dict]:
    """States of the finished rounds in ``folder``, in order; a round counts once its state is there."""
    out: list[dict] = []
    while _ended(spark, f"{folder}/run_{len(out):02d}"):
        out.append(json.loads(spark.read.text(f"{folder}/run_{len(out):02d}/state").first().value))
    return out
