"""Sampling of sequences: uniform, independent, Metropolis and parallel tempering, by counter random numbers.

Every draw depends on (seed, walker, step) alone: a task that runs again makes the same chain, and results
don't depend on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import in_order
from ..functions.rng import bits, even, places, threefry, uniform, uniform_array
from ..functions.ship import ship
from ..functions.storage import kept
from .filters import runs


def uniform_sequences(spark: SparkSession, n: int, length: int, q: int, seed: int = 0) -> DataFrame:
    """(seq_id, seq): all letters alike."""
    letters = [F.floor(uniform(seed, F.col("id"), p) * q).cast("int") for p in range(length)]
    return spark.range(n).select(F.col("id").alias("seq_id"), F.array(*letters).alias("seq"))


def independent_sequences(spark: SparkSession, n: int, unimarg: list[list[float]], seed: int = 0) -> DataFrame:
    """(seq_id, seq): each position by its own frequencies, by inverting the cumulative sums."""
    letters = []
    for p, f in enumerate(unimarg):
        total, sums = float(sum(f)), np.cumsum(f).tolist()
        limits = F.array(*(F.lit(s / total) for s in sums[:-1]))
        letters.append(places(uniform(seed, F.col("id"), p), limits))
    return spark.range(n).select(F.col("id").alias("seq_id"), F.array(*letters).alias("seq"))


def positions(seed: int, first: int, n: int, length: int) -> np.ndarray:
    """The position of each step; all walkers share it."""
    return (bits(seed ^ 0x5DEECE66D, 0, np.arange(first, first + n)) % np.uint64(length)).astype(np.int64)


def sweep(seqs: np.ndarray, walkers: np.ndarray, beta: np.ndarray, couplings: np.ndarray, steps: int, seed: int, first: int = 0, own: bool = False) -> np.ndarray:
    """``steps`` Metropolis steps of all walkers at once; returns the new sequences.  ``own``: each walker draws its own position."""
    s, q = seqs.copy(), couplings.shape[2]
    length = s.shape[1]
    if own:
        return _own_sweep(s, walkers, beta, couplings, steps, seed, first)
    rows = np.arange(length)
    for step, p in enumerate(positions(seed, first, steps, length).tolist(), first):
        draw = bits(seed, walkers, 2 * step)
        new, old = (draw % np.uint64(q)).astype(np.int64), s[:, p]
        delta = np.zeros(len(s))
        for m in rows[rows != p].tolist():
            table = couplings[p, m]
            delta += table[new, s[:, m]] - table[old, s[:, m]]
        accept = np.exp(-np.clip(beta * delta, -700, 700)) > uniform_array(seed, walkers, 2 * step + 1)
        s[:, p] = np.where(accept, new, old)
    return s


def _own_sweep(s: np.ndarray, walkers: np.ndarray, beta: np.ndarray, couplings: np.ndarray, steps: int, seed: int, first: int) -> np.ndarray:
    """Positions and letters of Threefry counters, without the bias of a remainder."""
    length, q = s.shape[1], couplings.shape[2]
    at = np.arange(len(s))
    for step in range(first, first + steps):
        p, new = even(length, seed, walkers, step, 0), even(q, seed, walkers, step, 1)
        old = s[at, p]
        delta = np.zeros(len(s))
        for m in range(length):
            delta += np.where(p == m, 0.0, couplings[p, m, new, s[:, m]] - couplings[p, m, old, s[:, m]])
        draw = (threefry((seed & (2**64 - 1), walkers), (step, 2))[0] >> np.uint64(11)).astype(np.float64) * 2.0**-53
        accept = np.exp(-np.clip(beta * delta, -700, 700)) > draw
        s[at, p] = np.where(accept, new, old)
    return s


def metropolis(walkers: DataFrame, couplings: np.ndarray, steps: int, seed: int, first: int = 0, own: bool = False) -> DataFrame:
    """Walkers (walker_id, seq, beta) after ``steps`` steps; ``couplings`` [i, j, a, b] are broadcast once an executor.

    The position of a step is shared by all walkers, or with ``own`` drawn by each; the new letter is uniform and may be the old one.
    """
    ship(walkers.sparkSession)
    shared = walkers.sparkSession.sparkContext.broadcast(couplings)
    length = couplings.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seqs = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, length)
                out = sweep(seqs, b.column(0).to_numpy(), b.column(2).to_numpy(), shared.value, steps, seed, first, own)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*out.astype(np.int32)], pa.list_(pa.int32())), b.column(2)], names=["walker_id", "seq", "beta"])

    return walkers.select(F.col("walker_id").cast("long"), "seq", F.col("beta").cast("double")).mapInArrow(run, "walker_id long, seq array<int>, beta double")


#: Walkers of a stretch of the energy order that one task swaps.
STRETCH = 1 << 16


def temper(e: np.ndarray, beta: np.ndarray, rounds: int, seed: int, first: int = 0) -> np.ndarray:
    """Inverse temperatures after swaps between neighbours, even and odd pairs in turn.

    ``e``, ``beta``: in order of energy; ``first``: the place of the first one among all walkers, which decides pairs and draws.
    """
    b = beta.copy()
    for n in range(rounds):
        for odd in (0, 1):
            x = np.arange((first + odd) % 2, len(b) - 1, 2)
            y = x + 1
            delta = (e[x] - e[y]) * (b[x] - b[y])
            go = (b[x] != b[y]) & ((delta >= 0) | (np.exp(np.minimum(delta, 0)) > uniform_array(seed, first + x, 2 * n + odd)))
            b[x[go]], b[y[go]] = b[y[go]], b[x[go]]
    return b


def exchanged(states: DataFrame, rounds: int, seed: int, stretch: int | None = None) -> DataFrame:
    """(walker_id, e, beta) after ``rounds`` of swaps between neighbours in the order of energy (ties by id), even pairs and then odd ones in each.

    A beta moves two places a round at most, so a stretch of the order needs that many walkers from either side for all rounds to be right
    within it, and stretches are swapped in tasks of their own.  Pairs and draws depend on places alone: the result is the same for any stretch
    and any partitions.
    """
    size, halo = stretch or max(STRETCH, 8 * rounds), 2 * rounds
    placed = kept(in_order(states.select("walker_id", "e", "beta"), "e", "walker_id"), "placed")
    last = F.lit((placed.count() - 1) // size)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - halo) / size)), F.least(last, F.floor((F.col("place") + halo) / size)))
    copies = placed.select(F.explode(near).alias("stretch"), "place", "walker_id", "e", "beta").repartition("stretch").sortWithinPartitions("stretch", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 1):
            for s, x in zip(bounds[:-1], bounds[1:], strict=True):
                part = t.slice(s, x - s)
                place, e, beta = (part.column(c).to_numpy() for c in (1, 3, 4))
                beta = temper(e, beta, rounds, seed, int(place[0]))
                own = place // size == part.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(part.column(2).to_numpy()[own]), pa.array(e[own]), pa.array(beta[own])], names=["walker_id", "e", "beta"])

    return copies.mapInArrow(run, "walker_id long, e double, beta double")


#: Sets of marked letters, and distinct backgrounds, of a cell; and numbers of a cell's table that are worked on at once.
SETS, BACKGROUNDS, HELD = 4096, 16_384, 4_000_000


def subsequence_logfreq(subsequences: DataFrame, backgrounds: DataFrame, marked: list[int], couplings: np.ndarray) -> DataFrame:
    """(seq_id, logfreq): log of the sum over backgrounds of exp(E(background) - E(background with the subsequence's marked letters)).

    Only pairs with a marked position change.  For a background, what each letter at each marked position meets outside is one vector of contexts; a set of letters
    picks one entry a position, so a table of sets by backgrounds is a matrix product, and what the letters meet among themselves is one number a set.
    Distinct sets and distinct backgrounds are dealt to blocks by hash; a cell is a block of either, and sends a maximum and a sum for each
    set.  Without backgrounds the log is null.
    """
    ship(backgrounds.sparkSession)
    length, q, m = couplings.shape[0], couplings.shape[2], len(marked)
    rest = [p for p in range(length) if p not in marked]
    # the marked positions' couplings only
    shared = backgrounds.sparkSession.sparkContext.broadcast(np.ascontiguousarray(couplings[marked]))
    keyed = subsequences.select("seq_id", F.array(*(F.col("seq")[p].cast("int") for p in marked)).alias("letters"))
    letters = kept(keyed.select("letters").distinct(), "marked-letters")
    different = kept(backgrounds.groupBy("seq").agg(F.count("*").cast("double").alias("n")), "backgrounds")
    set_blocks, blocks = max(1, -(-letters.count() // SETS)), max(1, -(-different.count() // BACKGROUNDS))

    def among(own: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What letters (rows x marked) meet among themselves."""
        return sum((j[x, marked[y]][own[:, x], own[:, y]] for x in range(m) for y in range(x + 1, m)), np.zeros(len(own)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            s = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, length)
            c = np.zeros((len(s), m, q))
            for x in range(m):
                for u in rest:
                    c[:, x] += j[x, u][:, s[:, u]].T
            own = s[:, marked]
            e = among(own, j) + np.take_along_axis(c, own[:, :, None], 2)[:, :, 0].sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(c.reshape(-1), m * q).cast(pa.list_(pa.float64())), pa.array(e + np.log(b.column(2).to_numpy()))], names=["y", "c", "e"])

    def cell(sets: pa.Table, back: pa.Table) -> pa.Table:
        if not len(sets) or not len(back):
            return pa.table({"letters": pa.array([], pa.list_(pa.int32())), "top": pa.array([], pa.float64()), "total": pa.array([], pa.float64())})
        own = np.asarray(sets.column("letters").combine_chunks().flatten(), np.int64).reshape(-1, m)
        pick = np.zeros((len(own), m * q))
        np.put_along_axis(pick, own + np.arange(m) * q, 1.0, 1)
        inner, c, e = among(own, shared.value), np.asarray(back.column("c").combine_chunks().flatten()).reshape(-1, m * q), back.column("e").to_numpy()
        top, total = np.empty(len(own)), np.empty(len(own))
        step = max(1, HELD // len(e))
        for k in range(0, len(own), step):
            v = e[None, :] - pick[k : k + step] @ c.T
            high = v.max(1)
            top[k : k + step], total[k : k + step] = high - inner[k : k + step], np.exp(v - high[:, None]).sum(1)
        return pa.table({"letters": sets.column("letters"), "top": top, "total": total})

    left = letters.withColumn("x", F.expr(f"cast(pmod(xxhash64(letters), {set_blocks}) as int)")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    vectors = different.select(F.expr(f"cast(pmod(xxhash64(seq), {blocks}) as int)").alias("y"), "seq", "n").mapInArrow(contexts, "y int, c array<double>, e double")
    right = vectors.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(set_blocks - 1))))
    parts = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(cell, "letters array<int>, top double, total double")
    scaled = parts.withColumn("high", F.max("top").over(Window.partitionBy("letters")))
    scored = scaled.groupBy("letters").agg((F.first("high") + F.log(F.sum(F.col("total") * F.exp(F.col("top") - F.col("high"))))).alias("logfreq"))
    return keyed.join(scored, "letters", "left").select("seq_id", "logfreq")
