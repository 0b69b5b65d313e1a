"""Row and column filters, repetition, substitution and re-encoding of alignments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import in_order
from ..functions.rng import places, uniform
from .marginals import PAIR


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
        whole = len(held) if batch is None else int(cuts[-1]) if len(cuts) else 0
        if whole:
            yield held.slice(0, whole), [0, *(c for c in cuts.tolist() if c < whole), whole]
            held = held.slice(whole)


def gap_fractions(msa: DataFrame, length: int, gap: int = 0) -> DataFrame:
    """(pos, gap_fraction), from one aggregate of ``length`` sums."""
    sums = msa.agg(*(F.avg((F.get("seq", F.lit(p)) == gap).cast("double")).alias(f"p{p}") for p in range(length)))
    stacked = ", ".join(f"{p}, p{p}" for p in range(length))
    return sums.selectExpr(f"stack({length}, {stacked}) as (pos, gap_fraction)")


def kept_columns(msa: DataFrame, length: int, most: float = 0.1, gap: int = 0) -> list[int]:
    """Positions whose gap fraction is below ``most``."""
    return [r.pos for r in gap_fractions(msa, length, gap).where(F.col("gap_fraction") < most).orderBy("pos").collect()]


def select_columns(msa: DataFrame, positions: list[int]) -> DataFrame:
    """Sequences of these positions only."""
    return msa.withColumn("seq", F.array(*(F.get("seq", F.lit(p)) for p in positions)) if positions else F.array().cast("array<int>"))


def drop_gapped_rows(msa: DataFrame, length: int, most: float = 0.1, gap: int = 0) -> DataFrame:
    """Rows with fewer gaps than ``most`` times ``length``, the length before any columns were dropped."""
    return msa.where(F.size(F.filter("seq", lambda x: x == gap)) / F.lit(float(length)) < most)


def first_rows(msa: DataFrame, n: int) -> DataFrame:
    """The first n by seq_id."""
    return msa.orderBy("seq_id").limit(n)


def repeated(msa: DataFrame, n: int, rows: int) -> DataFrame:
    """(seq_id, copy, seq), n rows: each of ``rows`` sequences is repeated in place, in order of seq_id, and the end is cut off.

    A sequence's copies follow from its place, so no sort of all copies is needed.
    """
    times = -(-n // max(rows, 1))
    placed = in_order(msa.select("seq_id", "seq"), "seq_id").withColumn("first", F.col("place") * times).where(F.col("first") < n)
    copies = F.sequence(F.lit(0), F.least(F.lit(times), n - F.col("first")).cast("int") - 1)
    return placed.select("seq_id", F.explode(copies).alias("copy"), "seq")


def with_subsequence(msa: DataFrame, donor: list[int], marked: list[int]) -> DataFrame:
    """Every sequence with the donor's letters at the marked positions."""
    letters, marks = F.array(*map(F.lit, donor)), F.array(*map(F.lit, marked))
    return msa.withColumn("seq", F.transform("seq", lambda x, p: F.when(F.array_contains(marks, p), F.get(letters, p)).otherwise(x)))


def tiled(spark, seed: list[int], n: int) -> DataFrame:
    """n copies of one sequence."""
    return spark.range(n).select(F.col("id").alias("seq_id"), F.array(*map(F.lit, seed)).alias("seq"))


def permuted(msa: DataFrame, seed: int) -> DataFrame:
    """Adds ``place``, a number that orders the rows at random; sort by (place, seq_id)."""
    return msa.withColumn("place", uniform(seed, F.col("seq_id")))


# ---- alphabet maps: for each position a list of groups of old letters


def map_literal(groups: list[list[list[int]]], q: int) -> Column:
    """Column array[pos][old] -> new letter; letters in no group become 0."""
    table = [[next((n for n, g in enumerate(position) if old in g), 0) for old in range(q)] for position in groups]
    return F.array(*(F.array(*map(F.lit, row)) for row in table))


def parse_map(text: str, alphabet: str) -> list[list[list[int]]]:
    """Groups from lines ``ALPHAq group group ...``; padding groups of ``*`` are skipped."""
    return [[[alphabet.index(c) for c in g] for g in line.split()[1:] if set(g) != {"*"}] for line in text.splitlines() if line.strip()]


def mapped_sequences(msa: DataFrame, groups: list[list[list[int]]], q: int) -> DataFrame:
    """Sequences in the reduced alphabets: one projection, no join."""
    table = map_literal(groups, q)
    return msa.withColumn("seq", F.transform("seq", lambda x, p: F.get(F.get(table, p), x)))


def mapped_bimarg(ff: DataFrame, groups: list[list[list[int]]], q: int) -> DataFrame:
    """Pair table of the reduced alphabets; each pair sums to 1 again."""
    table = map_literal(groups, q)
    known = F.array(*(F.array(*(F.lit(any(old in g for g in position)) for old in range(q))) for position in groups))
    rows = ff.where(F.get(F.get(known, F.col("i")), F.col("a")) & F.get(F.get(known, F.col("j")), F.col("b")))
    small = rows.groupBy("i", "j", F.get(F.get(table, F.col("i")), F.col("a")).alias("a"), F.get(F.get(table, F.col("j")), F.col("b")).alias("b")).agg(F.sum("f").alias("f"))
    return small.withColumn("f", F.col("f") / F.sum("f").over(PAIR()))


def expanded_couplings(couplings: DataFrame, unimarg: DataFrame, groups: list[list[list[int]]], q: int) -> DataFrame:
    """Couplings of a reduced model on the full alphabet: within a group, fields -ln of the letter's share; canonical form."""
    from pyspark.sql import Window

    from .gauge import fieldless_even
    from .marginals import grid

    length = len(groups)
    table = map_literal(groups, q)
    new = grid(couplings.sparkSession, length, q)
    new = new.withColumn("ra", F.get(F.get(table, F.col("i")), F.col("a"))).withColumn("rb", F.get(F.get(table, F.col("j")), F.col("b")))
    small = couplings.select("i", "j", F.col("a").alias("ra"), F.col("b").alias("rb"), "cpl")
    full = new.join(small, ["i", "j", "ra", "rb"]).select("i", "j", "a", "b", "cpl")
    group = F.get(F.get(table, F.col("pos")), F.col("res"))
    share = F.col("f") / F.sum("f").over(Window.partitionBy("pos", "g"))
    h = unimarg.withColumn("g", group).select("pos", "res", (-F.log(share)).alias("h"))
    return fieldless_even(h, full, length)


def expanded_sequences(msa: DataFrame, unimarg: list[list[float]], groups: list[list[list[int]]], seed: int = 0) -> DataFrame:
    """Sequences with a letter of each group drawn by its share, evenly if the group has none."""
    choices, bounds = [], []
    for p, position in enumerate(groups):
        choices.append(F.array(*(F.array(*map(F.lit, g)) for g in position)))
        rows = []
        for g in position:
            mass = [unimarg[p][x] for x in g]
            mass = [m / sum(mass) for m in mass] if sum(mass) else [1 / len(g)] * len(g)
            rows.append(F.array(*(F.lit(float(sum(mass[: k + 1]))) for k in range(len(g) - 1)), F.lit(2.0)))
        bounds.append(F.array(*rows))
    out = []
    for p in range(len(groups)):
        old = F.get("seq", F.lit(p))
        k = places(uniform(seed, F.col("seq_id"), p), F.get(bounds[p], old))
        out.append(F.get(F.get(choices[p], old), k))
    return msa.withColumn("seq", F.array(*out))
