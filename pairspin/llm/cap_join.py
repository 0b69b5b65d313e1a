"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector belongs to it if their inner product exceeds a height.  Directions are the
words of random product codes: after a rotation, coordinates fall into blocks, each block has m random
unit vectors, and a filter is one choice in each block (m^blocks filters).  A vector is listed in every filter above
one height; where fewer than a stated number are above it, the height comes down to that many.  Decoding goes through the
blocks and leaves what the best of the blocks to come can't lift over the height.  Vectors that share a filter are compared exactly.

Height and m follow from the coordinates and the number of distinct vectors.  A filter has about ``SHARE`` unrelated vectors, or more where few coordinates
would let near vectors share less than ``LEAST_SHARED`` of their filters; lists are as long as it takes for ``SHARED`` common
filters to be expected at the threshold, so that about one pair in a thousand, or fewer, has none (a test measures it at several sizes),
and far fewer at higher cosines.

Equal vectors are one vector with a multiplicity.  A filter's vectors meet in one task; filters of more than
``CELL_ROWS`` vectors are cut in chunks, and pairs of chunks are tasks of their own.  A link is counted
in the smallest filter that both ends share, so counts need no pairs: a task sends a count for
each vector and edges that span its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import components, materialize, runs, ship, table

#: Codes, unrelated vectors of a filter, filters expected in common at the threshold, and the least share of a list that is.
CODES, SHARE, SHARED, LEAST_SHARED = 2, 12, 11, 0.35
CELL_ROWS = 16_384
#: Cost of a comparison of filter numbers, against one multiplication in a matrix product.
COMPARISON = 20


def valid(v: Column) -> Column:
    """Vectors that can have a cosine: not null, not empty, all components finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8)
def heights(dim: int, n: int, cosine: float) -> tuple[float, float, int]:
    """(share of all filters above the height, height, filters of a vector under a code) for ``n`` distinct vectors."""
    dim = max(dim, 3)
    t = np.linspace(-1, 1, 20001)[1:-1]
    # a coordinate of a random direction; and, given it, one across
    along = np.exp((dim - 3) / 2 * np.log1p(-t * t))
    across = np.exp((dim - 4) / 2 * np.log1p(-t * t))
    above, beyond = 1 - np.cumsum(along) / along.sum(), 1 - np.cumsum(across) / across.sum()
    unrelated = SHARE / max(n, 1024)
    for p in sorted({unrelated, *(q for q in np.geomspace(1e-9, 0.1, 81) if q > unrelated)}):
        k = min(int(np.searchsorted(-above, -p)), len(t) - 1)
        need = (t[k] - cosine * t[k:]) / np.sqrt((1 - cosine**2) * (1 - t[k:] ** 2))
        common = float((along[k:] * np.interp(need, t, beyond, left=1, right=0)).sum() / along[k:].sum())
        if common >= LEAST_SHARED:
            break
    return float(p), float(t[k]), int(np.ceil(SHARED / CODES / max(common, LEAST_SHARED)))


class ProductCode:
    """The filters for ``dim`` coordinates and ``n`` distinct vectors; the same in every process."""

    def __init__(self, dim: int, n: int, cosine: float, seed: int):
        share, self.height, self.least = heights(dim, n, cosine)
        filters = self.least / share if dim > 1 else 2
        # blocks of four coordinates at least: words of fewer lie too unevenly
        blocks = next(b for b in range(1, 9) if filters ** (1 / b) <= 2000 or b >= dim // 4)
        # filters of three blocks or more have many words in common, so it takes more of them
        self.least *= max(1, blocks - 1)
        self.m = max(2, int(np.ceil(filters ** (1 / blocks))))
        rng = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [round(dim * b / blocks) for b in range(blocks + 1)]
        self.words = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            w = rng.standard_normal((self.m, b - a))
            # a block's share of the direction's length is its share of the coordinates
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * sqrt((b - a) / dim))

    def _own_height(self, scores: list[np.ndarray]) -> np.ndarray:
        """The height, or where fewer than ``least`` filters are above it, the score of the last of so many best."""
        total = np.zeros((len(scores[0]), 1))
        for s in scores:
            # the best sums are made of the best of each block
            best = -np.partition(-s, min(self.least, self.m) - 1, axis=1)[:, : self.least]
            sums = (total[:, :, None] + best[:, None, :]).reshape(len(s), -1)
            total = -np.partition(-sums, min(self.least, sums.shape[1]) - 1, axis=1)[:, : self.least]
        return np.minimum(self.height, total.min(1))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter above the height of each row of ``unit`` (rows of length one)."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ w.T for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.words, strict=True)]
        height = self._own_height(scores) - 1e-12
        tops = np.stack([s.max(1) for s in scores])
        row, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            sums = total[:, None] + s[row]
            i, j = np.nonzero(sums >= (height - tops[k + 1 :].sum(0))[row, None])
            row, number, total = row[i], number[i] * self.m + j, sums[i, j]
        return row, number


@lru_cache(maxsize=8)
def product_codes(dim: int, n: int, cosine: float) -> list[ProductCode]:
    return [ProductCode(dim, n, cosine, seed) for seed in range(CODES)]


def filter_lists(unit: np.ndarray, n: int, cosine: float) -> pa.ListArray:
    """Filters of each row under all codes, ascending; numbers of different codes differ."""
    found = [(row, (k << 58) + number) for k, code in enumerate(product_codes(unit.shape[1], n, cosine)) for row, number in [code.decode(unit)]]
    row, number = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((number, row))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(unit)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(number[order]))


def padded(lists: pa.ListArray) -> np.ndarray:
    """A row for each list, filled up with -1."""
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.full((len(lists), sizes.max(initial=0)), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _filters(classes: DataFrame, n: int, least: float) -> DataFrame:
    """A row (dim, node, mult, list, vec) for each vector; ``list`` has its filters, ``vec`` is raw bytes of the given precision."""
    schema = pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("mult", pa.int64()), ("list", pa.list_(pa.int64())), ("vec", pa.binary())])
    kind = _kind(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, mults = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            column = batch.column(2)
            sizes = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten(), np.float64)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for part in np.array_split(rows, -(-len(rows) // 500)):
                    x = np.stack([flat[ends[k] - dim : ends[k]] for k in part])
                    # scaled first, so that no square overflows or vanishes
                    unit = x / np.abs(x).max(1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), dim, np.int32)), pa.array([nodes[k] for k in part]), pa.array([mults[k] for k in part]), filter_lists(unit, n, least), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())],
                        schema=schema,
                    )

    return classes.select("node", "mult", "vec").mapInArrow(run, "dim int, node long, mult long, list array<long>, vec binary")


def _kind(classes: DataFrame) -> type:
    """The type that holds the vectors' components without loss."""
    return np.float32 if classes.schema["vec"].dataType.simpleString() == "array<float>" else np.float64


def _parted(linked: np.ndarray, at: int, lists: np.ndarray, number: int) -> None:
    """Strike out pairs (row at.., column) of ``linked`` whose ``padded`` lists share a filter before ``number``, in bounded memory."""
    i, j = np.nonzero(linked)
    rows = np.unique(np.concatenate([at + i, j]))
    names, column, times = np.unique(np.where(lists[rows] < number, lists[rows], -1), return_inverse=True, return_counts=True)
    common = np.flatnonzero((times > 1) & (names >= 0))
    if not len(common):
        return
    # only filters that two of these rows have, numbered from 0, in front
    place = np.full(len(names), -1)
    place[common] = np.arange(len(common))
    of = -np.sort(-place[column.reshape(len(rows), -1)], axis=1)
    of = of[:, : int((of >= 0).sum(1).max())]
    left, right = np.searchsorted(rows, at + i), np.searchsorted(rows, j)
    who = np.unique(i)
    if len(i) * of.shape[1] ** 2 * COMPARISON <= len(who) * len(rows) * len(common):
        some = max(1, 12_000_000 // of.shape[1] ** 2)
        for a in range(0, len(i), some):
            x, y = of[left[a : a + some]], of[right[a : a + some]]
            met = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2))
            linked[i[a : a + some][met], j[a : a + some][met]] = False
        return
    # many links: columns of a membership matrix, some hundred filters at a time
    row, flat = np.repeat(np.arange(len(rows)), of.shape[1]), of.ravel()
    width = max(64, 8_000_000 // len(rows))
    for a in range(0, len(common), width):
        member = np.zeros((len(rows), min(width, len(common) - a)), np.float32)
        here = (flat >= a) & (flat < a + width)
        member[row[here], flat[here] - a] = 1
        linked[np.ix_(who, rows)] &= (member[np.searchsorted(rows, at + who)] @ member.T) == 0


def _compare(number: int, left: int, right: int, nodes: np.ndarray, mults: np.ndarray, chunks: np.ndarray, lists: pa.ListArray, vecs: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Counts and spanning edges of one filter's cell (chunk ``left`` against ``right``)."""
    n = len(nodes)
    if n < 2:
        return
    x = vecs / np.abs(vecs).max(1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    count = np.zeros(n, np.int64)
    root = np.arange(n)
    edges: list[tuple[int, int]] = []
    step = max(1, 4_000_000 // n)
    wide = None
    for a in range(0, n, step):
        linked = unit[a : a + step] @ unit.T >= least
        linked[np.arange(len(linked)), np.arange(a, a + len(linked))] = False
        if left != right:
            linked &= chunks[a : a + step, None] != chunks[None, :]
        if not linked.any():
            continue
        wide = padded(lists) if wide is None else wide
        _parted(linked, a, wide, number)
        count[a : a + step] = linked @ mults
        for k in np.flatnonzero(linked.any(1)).tolist():
            met = np.unique(root[np.flatnonzero(linked[k])])
            for r in met[met != root[a + k]].tolist():
                edges.append((int(nodes[r]), int(nodes[a + k])))
                root[root == r] = root[a + k]
    hit = np.flatnonzero(count)
    yield nodes[hit], np.full(len(hit), -1, np.int64), count[hit]
    if edges:
        u, v = np.array(edges, np.int64).T
        yield u, v, np.zeros(len(u), np.int64)


def links(classes: DataFrame, n: int, least: float) -> DataFrame:
    """Rows (u, -1, links) with parts of a vector's count, and (u, v, 0) edges, of vectors (node, mult, vec)."""
    rows = materialize(_filters(classes, n, least), "cap-filters").withColumn("filter", F.explode("list"))
    kind = _kind(classes)
    sizes = rows.groupBy("dim", "filter").agg(F.count("*").alias("size")).where(F.col("size") > CELL_ROWS)
    if sizes.limit(1).count():
        rows = rows.join(sizes, ["dim", "filter"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("size") / CELL_ROWS), F.lit(1)).cast("int"))
        rows = rows.withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
    else:
        zero = F.lit(0)
        rows = rows.withColumn("chunk", zero).withColumn("a", zero).withColumn("b", zero)
    cells = rows.select("filter", "a", "b", "dim", "node", "mult", "chunk", "list", "vec").repartition("filter", "a", "b", "dim").sortWithinPartitions("filter", "a", "b", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, 4):
            number, left, right = (t.column(c).to_pylist() for c in range(3))
            node, mult, chunk = (t.column(c).to_numpy() for c in (4, 5, 6))
            packed, raw = t.column(7), t.column(8)

            def cell(s: int, e: int) -> Iterator[tuple[np.ndarray, ...]]:
                lists = packed.slice(s, e - s).combine_chunks()
                vecs = np.frombuffer(b"".join(raw.slice(s, e - s).to_pylist()), kind).reshape(e - s, -1).astype(np.float64)
                return _compare(number[s], left[s], right[s], node[s:e], mult[s:e], chunk[s:e], lists, vecs, least)

            found = [x for s, e in zip(cut[:-1], cut[1:], strict=True) if e - s > 1 for x in cell(s, e)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["u", "v", "links"])

    return cells.mapInArrow(run, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of each row of ``vectors``.

    Links hold between vectors of one size at cosine ``least`` or more, in double precision.  Null vectors, and ones that
    are empty, zero or hold null or non-finite components, link with nothing.  Rows that repeat a
    vector link with each other and count one by one.  A row without a key takes no part: 0 links, a null component, kept.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("vec"), (valid(v) & F.col(key).isNotNull()).alias("ok"))
    rows = rows.select("id", "ok", "vec", F.xxhash64("vec").alias("d1"), F.xxhash64(F.lit(1), "vec").alias("d2"))
    good = rows.where("ok").groupBy("d1", "d2").agg(F.min("id").alias("node"), F.count("*").alias("mult"), F.any_value("vec").alias("vec"))
    classes = materialize(good, "cap-classes")
    found = materialize(links(classes, classes.count(), least), "cap-links")
    counts = found.where("v = -1").groupBy("u").agg(F.sum("links").alias("n"))
    groups = components(found.where("v <> -1").select("u", "v"), "cap")
    told = (
        classes.select("d1", "d2", "node", "mult")
        .join(counts, F.col("node") == F.col("u"), "left")
        .join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
        .select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = rows.where("ok").select("id", "d1", "d2").join(told, ["d1", "d2"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_cap_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


QUERIES = {"op3_cap_near_dedup": op3_cap_near_dedup}
