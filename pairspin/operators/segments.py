"""Near pairs of sequences by a pigeonhole index of segments.

Two sequences of distance below c differ at c - 1 positions at most, so of c segments they share one whole.  Each distinct sequence is listed once a
segment under the hash of its letters there; rows of one listing are compared, and a pair counts in the first segment that it
really shares, so in one place only.  Positions are dealt to segments by how well their letters tell rows apart, so that conserved columns don't gather in one.

A listing of very many rows is cut into blocks, and the blocks are compared two at a time in tasks of their own.  With no segments all rows are in one
listing, which is the plain grid of blocks: better where the cutoff is so large that segments tell little.  Which of the two it is follows from the counted
candidates and never changes a result.  No row is made for a pair: tasks send sums, and least orders, for each sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .filters import runs

#: Rows of a block, and rows of a listing up to which its pairs are compared as they are, not as matrices.
BLOCK, FEW = 2048, 48
#: Pairs whose letters a task compares at once.
PAIRS = 400_000
#: Large listings whose sizes are broadcast at most (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_LISTINGS = 100_000
OUT = "code string, near double, o1 long, o2 long"


def code(seq: Column | str = "seq") -> Column:
    """Letters as a string of one sign each, from '!' on; for alphabets of 200 letters at most."""
    return F.array_join(F.transform(seq, lambda x: F.char(x.cast("long") + 33)), "")


def distinct(rows: DataFrame, weight: str = "w") -> DataFrame:
    """(code, w, o1, o2): each distinct sequence of ``rows`` (seq, weight) with its summed weight; no order."""
    return rows.groupBy(code().alias("code")).agg(F.sum(weight).cast("double").alias("w")).withColumns({"o1": F.lit(None).cast("long"), "o2": F.lit(None).cast("long")})


def dealt(d: DataFrame, length: int, parts: int) -> list[list[int]]:
    """Positions of each segment: the best told ones first, each to the segment that tells least so far."""
    letters = d.select(F.posexplode(F.split("code", "")).alias("pos", "x")).where("x <> ''")
    square = letters.groupBy("pos", "x").agg(F.count("*").alias("n")).groupBy("pos").agg(F.sum(F.col("n") * F.col("n").cast("double")).alias("s"), F.sum("n").alias("n"))
    told = {r.pos: -np.log(r.s / r.n / r.n) for r in square.collect()}
    out: list[list[int]] = [[] for _ in range(parts)]
    sums = [0.0] * parts
    for p in sorted(range(length), key=lambda p: (-told.get(p, 0.0), p)):
        k = min(range(parts), key=lambda k: (sums[k], len(out[k]), k))
        out[k].append(p)
        sums[k] += told.get(p, 0.0)
    return [sorted(x) for x in out]


def listings(d: DataFrame, segments: list[list[int]]) -> DataFrame:
    """(segment, value, code, w, o1, o2): every row once a segment; without segments once in all."""
    if not segments:
        return d.select(F.lit(-1).alias("segment"), F.lit(0).cast("long").alias("value"), "code", "w", "o1", "o2")
    hashes = F.array(*(F.xxhash64(*(F.substring("code", p + 1, 1) for p in s)) for s in segments))
    return d.select(F.posexplode(hashes).alias("segment", "value"), "code", "w", "o1", "o2")


def plan(d: DataFrame, length: int, cutoff: int, how: str | None = None) -> tuple[list[list[int]], DataFrame]:
    """Segments ([] for the grid) and the sizes of their listings (segment, value, n).  ``how``: ``index``, ``grid``, or by counted candidates."""
    if how not in (None, "index", "grid"):
        raise ValueError(f"no way {how}")
    indexed = 0 < cutoff <= length and how != "grid"
    if how == "index" and not indexed:
        raise ValueError("an index takes a cutoff from 1 to the length")
    sizes = lambda segments: listings(d, segments).groupBy("segment", "value").agg(F.count("*").alias("n"))
    if indexed:
        segments = dealt(d, length, cutoff)
        found = sizes(segments)
        n, candidates = found.agg(F.coalesce(F.sum("n"), F.lit(0)) / cutoff, F.coalesce(F.sum(F.col("n") * (F.col("n") - 1.0)), F.lit(0.0))).first()
        if how or 2 * candidates < float(n) * float(n):
            return segments, found
    return [], sizes([])


def near_sums(d: DataFrame, length: int, q: int, cutoff: int, how: str | None = None) -> DataFrame:
    """(code, near, o1, o2) of each distinct sequence of ``d`` (code, w, o1, o2).

    ``near`` is the weight of all sequences at a distance below ``cutoff``, itself included; (o1, o2) the least order among the other near ones that have an
    order (o1 not null), null where there is none.  ``d`` is read more than once, so it should be stored.
    """
    ship(d.sparkSession)
    segments, sizes = plan(d, length, cutoff, how)
    large = sizes.where(F.col("n") > BLOCK).select("segment", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    if large.limit(BROADCAST_LISTINGS + 1).count() <= BROADCAST_LISTINGS:
        large = F.broadcast(large)
    cells = listings(d, segments).join(large, ["segment", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("code", F.lit(7)), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("segment", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "code", "w", "o1", "o2")
    cells = cells.repartition("segment", "value", "x", "y").sortWithinPartitions("segment", "value", "x", "y", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 4):
            sizes = np.diff(bounds)
            t = t.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if len(t):
                yield _near(t, sizes[sizes > 1], length, q, cutoff, segments)

    found = cells.mapInArrow(run, OUT).unionByName(d.select("code", F.col("w").alias("near"), F.lit(None).cast("long").alias("o1"), F.lit(None).cast("long").alias("o2")))
    least = F.min(F.when(F.col("o1").isNotNull(), F.struct("o1", "o2"))).alias("o")
    return found.groupBy("code").agg(F.sum("near").alias("near"), least).select("code", "near", "o.o1", "o.o2")


def letters_of(codes: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """Letters (rows x positions) of codes."""
    return (np.frombuffer("".join(codes.to_pylist()).encode("latin-1"), np.uint8) - 33).reshape(-1, length)


def _near(t: pa.Table, sizes: np.ndarray, length: int, q: int, cutoff: int, segments: list[list[int]]) -> pa.RecordBatch:
    """Sums over the near pairs within each run of cells (segment, value, x, y, own, code, w, o1, o2)."""
    segment, x, y, own = (t.column(c).to_numpy() for c in (0, 2, 3, 4))
    seqs, w = letters_of(t.column(5), length), t.column(6).to_numpy()
    offered = t.column(7).is_valid().to_numpy()
    o1, o2 = (t.column(c).fill_null(0).to_numpy() for c in (7, 8))
    order = np.lexsort((o2, o1, ~offered))
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t))
    none = len(t)
    rank[~offered] = none
    near, best, hit = np.zeros(len(t)), np.full(len(t), none), np.zeros(len(t), bool)

    def settle(left: np.ndarray, right: np.ndarray) -> None:
        """Add the pairs that are near, and first met here."""
        same = seqs[left] == seqs[right]
        ok = length - same.sum(1) < cutoff
        left, right, same = left[ok], right[ok], same[ok]
        if segments and len(left):
            shared = np.stack([same[:, s].all(1) for s in segments], 1)
            ok = shared.any(1) & (shared.argmax(1) == segment[left])
            left, right = left[ok], right[ok]
        for a, b in ((left, right), (right, left)):
            near[:] += np.bincount(a, w[b], len(near))
            np.minimum.at(best, a, rank[b])
            hit[a] = True

    ends = np.cumsum(sizes)
    few = sizes <= FEW
    rows = np.flatnonzero(np.repeat(few, sizes))
    after = np.repeat(ends, sizes)[rows] - rows - 1
    for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(after) // PAIRS)) + 1):
        count = np.repeat(ends, sizes)[part] - part - 1
        left = np.repeat(part, count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        ok = (x[left] == y[left]) | (own[left] != own[right])
        settle(left[ok], right[ok])
    for end, size in zip(ends[~few].tolist(), sizes[~few].tolist(), strict=True):
        at = np.arange(end - size, end)
        a, b = at[own[at] == x[at]], at[own[at] == y[at]]
        if not len(a) or not len(b):
            continue
        alike = x[at[0]] == y[at[0]]
        hot = _one_hot(seqs[b], q).T
        for k in range(0, len(a), max(1, PAIRS // len(b))):
            some = a[k : k + max(1, PAIRS // len(b))]
            i, j = np.nonzero(length - _one_hot(seqs[some], q) @ hot < cutoff - 0.5)
            left, right = some[i], b[j]
            ok = left < right if alike else np.ones(len(left), bool)
            settle(left[ok], right[ok])
    at = np.flatnonzero(hit)
    first = order[np.minimum(best[at], none - 1)]
    known = pa.array(best[at] == none)
    return pa.RecordBatch.from_arrays(
        [t.column(5).take(pa.array(at)).combine_chunks(), pa.array(near[at]), *(pc.if_else(known, pa.scalar(None, pa.int64()), pa.array(o[first])) for o in (o1, o2))],
        names=["code", "near", "o1", "o2"],
    )


def _one_hot(seqs: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((len(seqs), seqs.shape[1] * q), np.float32)
    np.put_along_axis(out, seqs.astype(np.int64) + np.arange(seqs.shape[1]) * q, 1, axis=1)
    return out
