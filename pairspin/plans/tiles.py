"""Newton steps for models too large to be whole in every task.

Positions are cut into stretches, and a tile holds the pairs of two stretches: their target, couplings, change and marginals in one row.  Walkers are
packed in blocks, each with its letters of every stretch.  A cell is a tile with a share of the blocks: it has the tile's change and the
letters that the tile reads, so it can say what the tile adds to each walker's energy.  These parts are summed by block, weights go back to
the cells, and bins weighted by them are summed by tile.  The driver sees three numbers a step.

Cells are dealt by tile and share once, and kept in executors so dealt; a step moves a change a cell, and for each tile one number a walker there and back.
Tables of a step are written to the shared folder, so that lineage ends there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, inf, isfinite, isqrt

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.storage import discard, kept, stored
from ..operators import newton

#: Values of a tile, walkers of a block, and blocks of a cell at most.
TILE_VALUES, BLOCK_WALKERS, CELL_BLOCKS = 1 << 18, 1 << 13, 32
TILE = ("target", "cpl", "dj", "f")
STATE = "x int, y int, " + ", ".join(f"{c} array<double>" for c in TILE)


@dataclass(frozen=True)
class Shape:
    """Lengths of sequences and alphabet, and the stretches of positions that follow from them."""

    length: int
    q: int
    values: int

    @property
    def side(self) -> int:
        return max(1, isqrt(self.values) // self.q)

    @property
    def stretches(self) -> int:
        return ceil(self.length / self.side)

    def width(self, x: int) -> int:
        return min(self.length, (x + 1) * self.side) - x * self.side

    def tile(self, values: np.ndarray, x: int, y: int) -> np.ndarray:
        return values.reshape(self.width(x), self.width(y), self.q, self.q)

    def pairs(self, x: int, y: int) -> list[tuple[int, int]]:
        """Pairs of a tile, as places in its two stretches."""
        return [(i, j) for i in range(self.width(x)) for j in range(i + 1 if x == y else 0, self.width(y))]


def _lists(*values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays([0, len(v)], pa.array(v)) for v in values]


def tiled(bins: DataFrame, shape: Shape) -> DataFrame:
    """``STATE`` of a pair table (i, j, a, b, target, cpl, dj, f)."""
    q, side = shape.q, shape.side

    def pack(t: pa.Table) -> pa.Table:
        i, j, a, b = (t.column(c).to_numpy() for c in ("i", "j", "a", "b"))
        x, y = int(i[0] // side), int(j[0] // side)
        at = np.ravel_multi_index((i - x * side, j - y * side, a, b), (shape.width(x), shape.width(y), q, q))
        out = []
        for c in TILE:
            v = np.zeros(shape.width(x) * shape.width(y) * q * q)
            v[at] = t.column(c).to_numpy()
            out.append(v)
        return pa.Table.from_arrays([pa.array([x], pa.int32()), pa.array([y], pa.int32()), *_lists(*out)], names=["x", "y", *TILE])

    x = bins.withColumn("x", F.floor(F.col("i") / side).cast("int")).withColumn("y", F.floor(F.col("j") / side).cast("int"))
    return x.select("x", "y", "i", "j", "a", "b", *TILE).groupBy("x", "y").applyInArrow(pack, STATE)


def untiled(state: DataFrame, shape: Shape, *columns: str) -> DataFrame:
    """(i, j, a, b, ``columns``) of tiles (x, y, ``columns``)."""
    q, side = shape.q, shape.side

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                pairs = np.array(shape.pairs(x, y), np.int32).reshape(-1, 2)
                if not len(pairs):
                    continue
                a, b = np.divmod(np.arange(q * q, dtype=np.int32), q)
                found = [shape.tile(batch.column(2 + c)[k].values.to_numpy(), x, y)[pairs[:, 0], pairs[:, 1]].reshape(-1) for c in range(len(columns))]
                keys = (np.repeat(pairs[:, 0] + np.int32(x * side), q * q), np.repeat(pairs[:, 1] + np.int32(y * side), q * q), np.tile(a, len(pairs)), np.tile(b, len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*keys, *found)], names=["i", "j", "a", "b", *columns])

    return state.select("x", "y", *columns).mapInArrow(unpack, "i int, j int, a int, b int, " + ", ".join(f"{c} double" for c in columns))


def packed_walkers(walkers: DataFrame, shape: Shape) -> DataFrame:
    """(block, e, letters): runs of walkers with their energies and, for each stretch, their letters as bytes, walker by walker."""
    rows, cuts = BLOCK_WALKERS, [x * shape.side for x in range(shape.stretches)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                s = np.asarray(part.column(0).flatten(), np.int64).reshape(-1, shape.length).astype(np.uint8)
                letters = [s[:, c : c + shape.side].tobytes() for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *_lists(part.column(1).to_numpy()), pa.array([letters], pa.list_(pa.binary()))], names=["block", "e", "letters"])
                number += 1

    return walkers.select("seq", F.col("e").cast("double").alias("e")).mapInArrow(pack, "block long, e array<double>, letters array<binary>")


class Steps:
    """Steps on the tiles of a model with fixed walkers; ``close`` gives back what they keep in executors."""

    def __init__(self, walkers: DataFrame, bins: DataFrame, length: int, q: int, beta: float | None = None):
        ship(walkers.sparkSession)
        self.shape, self.beta = Shape(length, q, TILE_VALUES), beta
        self.blocks = kept(packed_walkers(walkers, self.shape), "walker-blocks")
        self.parts = max(1, ceil(self.blocks.count() / CELL_BLOCKS))
        self.tiles = [(x, y) for x in range(self.shape.stretches) for y in range(x, self.shape.stretches) if self.shape.pairs(x, y)]
        placed = self._at_all_tiles(self.blocks).select("x", "y", "part", "block", F.get("letters", F.col("x")).alias("lx"), F.get("letters", F.col("y")).alias("ly"))
        self.cells = placed.repartition("x", "y", "part").persist(StorageLevel.MEMORY_AND_DISK)
        self.state = kept(tiled(bins, self.shape), "tiles")

    def _at_all_tiles(self, by_block: DataFrame) -> DataFrame:
        tiles = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in self.tiles))
        at = by_block.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(self.parts)).cast("int")).withColumn("tile", F.explode(tiles))
        return at.select(F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), *[c for c in at.columns if c != "tile"])

    def close(self) -> None:
        self.cells.unpersist()
        discard(self.blocks)

    def weights(self, ref: float) -> tuple[DataFrame, float, float, float]:
        """((block, w), sum of weights, of their squares, least change of energy) under the tiles' change."""
        shape, beta = self.shape, self.beta

        def parts(cells: pa.Table, tile: pa.Table) -> pa.Table:
            x, y = tile.column("x")[0].as_py(), tile.column("y")[0].as_py()
            d, blocks, out = shape.tile(tile.column("dj")[0].values.to_numpy(), x, y), cells.column("block"), []
            for k in range(len(cells)):
                sx, sy = _letters(cells, k, shape, x, y)
                de = np.zeros(len(sx))
                for i, j in shape.pairs(x, y):
                    de += d[i, j][sx[:, i], sy[:, j]]
                out.append(de)
            return pa.table({"block": blocks, "de": pa.array(out, pa.list_(pa.float64()))})

        def summed(key: tuple, changes: pa.Table, block: pa.Table) -> pa.Table:
            de = sum((v.values.to_numpy() for v in changes.column("de")), np.zeros(len(block.column("e")[0].values)))
            if beta is not None:
                de = de - (beta - 1) * block.column("e")[0].values.to_numpy()
            w = np.exp(ref - de)
            return pa.Table.from_arrays([block.column("block"), *_lists(w), pa.array([w.sum()]), pa.array([(w * w).sum()]), pa.array([de.min(initial=inf)])], names=["block", "w", "s", "s2", "low"])

        copies = self.state.select("x", "y", "dj").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        by = ("x", "y", "part")
        de = self.cells.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_both(parts, {"block": pa.int64(), "de": pa.list_(pa.float64())}), "block long, de array<double>")
        w = de.groupBy("block").cogroup(self.blocks.select("block", "e").groupBy("block")).applyInArrow(summed, "block long, w array<double>, s double, s2 double, low double")
        w = kept(w, "weights")
        s, s2, low = w.agg(F.sum("s"), F.sum("s2"), F.min("low")).first()
        return w.select("block", "w"), s, s2, low

    def marginals(self, w: DataFrame) -> None:
        """The tiles' f becomes what walkers of these weights show."""
        shape = self.shape
        q = shape.q

        def bins(cells: pa.Table, weights: pa.Table) -> pa.Table:
            x, y, part = (cells.column(c)[0].as_py() for c in ("x", "y", "part"))
            of = {b: v.values.to_numpy() for b, v in zip(weights.column("block").to_pylist(), weights.column("w"), strict=True)}
            out = np.zeros((shape.width(x), shape.width(y), q * q))
            for k, block in enumerate(cells.column("block").to_pylist()):
                sx, sy = _letters(cells, k, shape, x, y)
                for i, j in shape.pairs(x, y):
                    out[i, j] += np.bincount(sx[:, i].astype(np.int64) * q + sy[:, j], of[block], q * q)
            return pa.Table.from_arrays([pa.array([x], pa.int32()), pa.array([y], pa.int32()), *_lists(out.reshape(-1))], names=["x", "y", "v"])

        def shared(tile: pa.Table, found: pa.Table) -> pa.Table:
            v = sum(p.values.to_numpy() for p in found.column("v")).reshape(-1, q * q)
            total = v.sum(1, keepdims=True)
            f = np.divide(v, total, out=np.zeros_like(v), where=total > 0)
            return tile.set_column(tile.schema.get_field_index("f"), "f", _lists(f.reshape(-1))[0])

        by = ("x", "y", "part")
        sums = self.cells.groupBy(*by).cogroup(self._at_all_tiles(w).groupBy(*by)).applyInArrow(_both(bins, {"x": pa.int32(), "y": pa.int32(), "v": pa.list_(pa.float64())}), "x int, y int, v array<double>")
        self._now(self.state.groupBy("x", "y").cogroup(sums.groupBy("x", "y")).applyInArrow(shared, STATE))

    def update(self, gamma: float, pc: float, regular: Callable[[DataFrame, float, float], DataFrame] | None = None, lam: DataFrame | None = None) -> None:
        """One change of the couplings, regularised; ``lam`` (i, j, lam) for a regulariser that wants a column of that name."""
        x = untiled(self.state, self.shape, *TILE)
        x = newton.update(x, gamma, pc)
        if regular:
            x = regular(x if lam is None else x.join(lam, ["i", "j"]), gamma, pc)
        self._now(tiled(x.select("i", "j", "a", "b", *TILE), self.shape))

    def _now(self, state: DataFrame) -> None:
        before, self.state = self.state, kept(state, "tiles")
        discard(before)

    def table(self, column: Column, name: str) -> DataFrame:
        return untiled(self.state, self.shape, *TILE).select("i", "j", "a", "b", column.alias(name))


def _letters(cells: pa.Table, k: int, shape: Shape, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(cells.column(c)[k].as_buffer(), np.uint8).reshape(-1, shape.width(p)) for c, p in (("lx", x), ("ly", y)))


def _both(f: Callable[[pa.Table, pa.Table], pa.Table], empty: dict[str, pa.DataType]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``f`` where both sides have rows: a tile's share may have no blocks."""
    return lambda left, right: f(left, right) if len(left) and len(right) else pa.table({c: pa.array([], t) for c, t in empty.items()})


def newton_steps(
    walkers: DataFrame, bins: DataFrame, length: int, q: int, gamma: float, pc: float, steps: int, keep_size: float, beta: float | None = None, regularised: Callable[[DataFrame, float, float], DataFrame] | None = None, lam: DataFrame | None = None, log: str | None = None
) -> tuple[DataFrame, DataFrame, dict]:
    """Couplings (i, j, a, b, cpl) and predicted marginals (i, j, a, b, f) after up to ``steps`` reweighted steps, and the state.

    ``bins``: (i, j, a, b, target, cpl); ``walkers``: (seq, e).  The same steps as those that hold the model in every task.
    ``log``: a folder that keeps tiles and numbers every ``infer.LOGGED`` steps, from which a run that broke off goes on.
    """
    from . import infer

    zero = F.lit(0.0)
    s = Steps(walkers, bins.select("i", "j", "a", "b", "target", "cpl", zero.alias("dj"), zero.alias("f")), length, q, beta)
    try:
        spark, done = walkers.sparkSession, infer.last_logged(walkers.sparkSession, log, steps)
        if done:
            s.state = kept(spark.read.parquet(f"{log}/step_{done}").select(*s.state.columns), "tiles")
            total, squares, low, size0 = spark.read.parquet(f"{log}/numbers_{done}").first()
        else:
            w, total, squares, low = s.weights(0.0)
            if beta is not None:
                w, total, squares, low = s.weights(low)
            s.marginals(w)
            size0 = total * total / squares
        size = total * total / squares
        while done < steps and (not done or size >= keep_size * size0):
            s.update(gamma, pc, regularised, lam)
            done += 1
            ref = low if isfinite(low) else 0.0
            w, total, squares, low = s.weights(ref)
            if not isfinite(total) or total == 0:
                w, total, squares, low = s.weights(low)
            s.marginals(w)
            size = total * total / squares
            if log and done % infer.LOGGED == 0:
                stored(spark.createDataFrame([(total, squares, low, size0)], "total double, squares double, low double, size0 double"), f"{log}/numbers_{done}")
                stored(s.state, f"{log}/step_{done}")
        return s.table(F.col("cpl") + F.col("dj"), "cpl"), s.table(F.col("f"), "f"), {"steps": done, "size": size, "size0": size0}
    finally:
        s.close()
