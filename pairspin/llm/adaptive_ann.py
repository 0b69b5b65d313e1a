"""Approximate nearest neighbours by largest inner product, with an adaptive scan of dimensions.

Vectors are rotated at random and dealt to lists by their nearest centroid.  A query probes its best
lists; within a list the rotated coordinates are read in column blocks.  After d of D coordinates the
partial squared distance, times D/d, estimates the whole; a candidate is abandoned when a hypothesis test says that
it can't come under the distance which the query's present k-th best inner product would need from
a vector of its length: partial * D/d > bound * (1 + ``EPSILON``/sqrt(d))^2.  What is left at the end
is scored in double precision on the original vectors.

A query first visits its best list alone; the k-th score found there goes with it to the other lists, so the
tests have a bound from the start.

Centroids, and how many lists to probe, are fitted on a bounded sample (``SAMPLE`` vectors by hash): one half gives the centroids, and the
probes are such that ``AIM`` of the other half's true neighbours lie in probed lists.  Every vector is indexed.  Lists are cut into units of
``UNIT`` vectors by hash, units are dealt to cells, and a query goes once to each cell that holds
probed units.  A cell's own queries are cut in blocks of ``QUERY_BLOCK``, and only so often are its vectors copied; so no list, however
hot, and no query set is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, ship, table
from .cap_join import valid

SAMPLE, AIM, EPSILON, ROUNDING = 40_000, 0.985, 3.0, 1e-6
UNIT, QUERY_BLOCK = 8192, 4096
LISTS_AT_MOST = 4096


class Index:
    """Rotation, centroids and number of probes, fitted on sample rows of ``dim`` coordinates.

    All that is compared here is divided by ``scale`` first, a power of two near the largest coordinate of the table.
    """

    def __init__(self, sample: np.ndarray, n: int, k: int, scale: float = 1.0, seed: int = 5):
        rng = np.random.default_rng([seed, sample.shape[1]])
        dim = sample.shape[1]
        self.scale = scale
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        x = sample / scale @ self.rotation
        x, held_out = (x, x) if len(x) < 2000 else (x[::2], x[1::2])
        lists = int(min(LISTS_AT_MOST, max(1, round(n**0.5 / 4)), max(1, len(x) // 16)))
        # distinct starts, or equal vectors would make empty lists
        starts = np.unique(x, axis=0)
        centroids = starts[rng.permutation(len(starts))[:lists]]
        for _ in range(12):
            to = self._nearest(x, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, to, x)
            sizes = np.bincount(to, minlength=len(centroids))
            centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        self.centroids = centroids
        self.probes = self._fit_probes(held_out, k, rng)

    @staticmethod
    def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return ((centroids**2).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)

    def _fit_probes(self, x: np.ndarray, k: int, rng: np.random.Generator) -> int:
        own = rng.permutation(len(x))[:300]
        q = x[own]
        scores = q @ x.T
        scores[np.arange(len(q)), own] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        place = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1)
        ranks = place[np.arange(len(q))[:, None], self._nearest(x, self.centroids)[near]]
        return int(np.ceil(np.quantile(ranks, AIM))) + 1 if ranks.size else len(self.centroids)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x / self.scale @ self.rotation, self.centroids)

    def probed(self, q: np.ndarray) -> np.ndarray:
        scores = (q / self.scale @ self.rotation) @ self.centroids.T
        return np.argsort(-scores, axis=1, kind="stable")[:, : self.probes]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def top_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query: by score, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def scan(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, query_ids: np.ndarray, q: np.ndarray, probed: np.ndarray, rotation: np.ndarray, k: int, known: np.ndarray | None = None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best found in the probed lists among these vectors, for each query.

    ``known``: a score that the k-th best is known to reach, -inf for none.  Negative numbers in ``probed`` stand for no list.
    Scores are of the vectors as they are; the tests compare vectors divided by ``scale``, so that their squares are in range.
    """
    dim = x.shape[1]
    turned_q, order = (q / scale @ rotation).astype(np.float32), np.argsort(lists, kind="stable")
    ids, x, lists = ids[order], x[order], lists[order]
    columns = np.ascontiguousarray((x / scale @ rotation).T.astype(np.float32))  # coordinate-major
    q_norm, x_norm = ((q / scale) ** 2).sum(1), ((x / scale) ** 2).sum(1)
    cuts = sorted({min(dim, c) for c in (16, 32, dim // 2, 3 * dim // 4) if c} | {dim})
    known = np.full(len(q), -np.inf) if known is None else known
    bound = known  # the present k-th best score
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    names, begin = np.unique(lists, return_index=True)
    end = np.append(begin[1:], len(lists))
    # the lists in which the best are likeliest come first, for a bound early on
    for place in range(probed.shape[1]):
        for name in np.unique(probed[:, place]).tolist():
            at = int(np.searchsorted(names, name))
            if at == len(names) or names[at] != name:
                continue
            who = np.flatnonzero(probed[:, place] == name)
            a, b = int(begin[at]), int(end[at])
            for w in np.array_split(who, -(-len(who) * (b - a) // 4_000_000)):
                qi, xi = _survivors(turned_q[w], columns[:, a:b], q_norm[w], x_norm[a:b], bound[w] / scale / scale, cuts)
                qi, xi = w[qi], xi + a
                keep = ids[xi] != query_ids[qi]
                qi, xi = qi[keep], xi[keep]
                if not len(qi):
                    continue
                score = np.concatenate([np.einsum("ij,ij->i", q[qi[c : c + 100_000]], x[xi[c : c + 100_000]]) for c in range(0, len(qi), 100_000)])
                merged = tuple(np.concatenate(p) for p in zip(best, (qi, ids[xi], score), strict=True))
                top = top_k(*merged, k)
                best = tuple(m[top] for m in merged)
                n = np.bincount(best[0], minlength=len(q))
                lowest = np.full(len(q), np.inf)
                np.minimum.at(lowest, best[0], best[2])
                bound = np.maximum(known, np.where(n >= k, lowest, -np.inf))
    return best


def _survivors(q: np.ndarray, columns: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray, bound: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test abandons."""
    dim = len(columns)
    with np.errstate(invalid="ignore"):
        # the squared distance at which a vector of this length just has the score ``bound``
        whole = q_norm[:, None] + x_norm[None, :]
        need = whole - 2 * bound[:, None]
        # what single precision may be off by, which is in proportion to both lengths
        slack = ROUNDING * whole
    partial = np.zeros((len(q), columns.shape[1]), np.float32)
    qi = xi = None
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        if qi is None:
            partial += (q[:, a:b] ** 2).sum(1)[:, None] + (columns[a:b] ** 2).sum(0)[None, :] - 2 * q[:, a:b] @ columns[a:b]
            alive = partial * (dim / b) <= need * (1 + (EPSILON / b**0.5 if b < dim else 1e-3)) ** 2 + slack
            if b == dim or np.count_nonzero(alive) < 0.25 * alive.size:
                qi, xi = np.nonzero(alive)
                rest, need, slack = partial[qi, xi], need[qi, xi], slack[qi, xi]
        elif len(qi):
            rest = rest + ((q[qi, a:b] - columns[a:b, xi].T) ** 2).sum(1)
            alive = rest * (dim / b) <= need * (1 + (EPSILON / b**0.5 if b < dim else 1e-3)) ** 2 + slack
            qi, xi, rest, need, slack = qi[alive], xi[alive], rest[alive], need[alive], slack[alive]
    return qi, xi


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k found with the largest inner product for each query, nearest first.

    A query's own key is no candidate of its.  Null vectors, and ones that are empty, zero or hold null or non-finite
    components, take no part, nor do rows without a key.  Vectors of each size are searched among themselves, one size after another.
    Rows that repeat a key are one candidate each; ties go to the smaller key.  Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)

    def clean(df: DataFrame) -> DataFrame:
        return df.where(valid(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))

    rows, asked = clean(vectors), clean(queries)
    largest = F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy("dim").collect()
    wanted = {r.dim for r in asked.select(F.size("vec").alias("dim")).distinct().collect()}
    found = [_search(rows.where(F.size("vec") == dim), asked.where(F.size("vec") == dim), dim, n, k, 2.0 ** floor(log2(largest))) for dim, n, largest in sizes if dim in wanted]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int, scale: float) -> DataFrame:
    """``search`` among n ``rows`` (id, vec) of ``dim`` coordinates."""
    spark = rows.sparkSession
    # bounded: the SAMPLE least hashes are found first, then their vectors
    least = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = rows.where(F.xxhash64("id") <= least).orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow()
    index = Index(_matrix(sample.column(0).combine_chunks(), dim), n, k, scale)
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.lists(_matrix(b.column(1), dim)).astype(np.int32))], names=["id", "vec", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = shared.value.probed(_matrix(b.column(1), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(found), pa.list_(pa.int32()))], names=["id", "vec", "probed"])

    listed = materialize(rows.mapInArrow(deal, "id long, vec array<double>, list int"), "ann-lists")
    cells = max(1, -(-n // UNIT))
    counts = listed.groupBy("list").agg(F.count("*").alias("size")).withColumn("units", F.ceil(F.col("size") / UNIT).cast("int"))
    place = F.expr(f"cast(pmod(xxhash64(list, unit), {cells}) as int)")
    unit = F.expr("cast(pmod(xxhash64(id, 3L), units) as int)")
    stored = listed.join(F.broadcast(counts.select("list", "units")), "list").withColumn("unit", unit).withColumn("cell", place)  # LISTS_AT_MOST rows
    homes = counts.select("list", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit")).select("list", place.alias("cell")).distinct()
    sought = materialize(asked.mapInArrow(probe, "id long, vec array<double>, probed array<int>"), "ann-queries")

    def compare(queries_: pd.DataFrame, vectors_: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_) or not len(vectors_):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q_ids = queries_["id"].to_numpy()
        q, ids, score = scan(vectors_["id"].to_numpy(), np.stack(vectors_["vec"].to_numpy()), vectors_["list"].to_numpy(), q_ids, np.stack(queries_["vec"].to_numpy()), np.stack(queries_["probed"].to_numpy()), shared.value.rotation, k, queries_["bound"].to_numpy(), scale)
        return pd.DataFrame({"query_id": q_ids[q], "vec_id": ids, "score": score})

    def visited(who: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the best of each query of ``who`` (id, vec, probed, bound) in each cell that it must see."""
        goes = who.select("id", F.explode("probed").alias("list")).join(homes, "list").select("id", "cell").distinct()
        blocks = goes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        block = F.expr("cast(pmod(xxhash64(id, 7L), blocks) as int)")
        left = goes.join(blocks, "cell").join(who, "id").select("cell", block.alias("block"), "id", "vec", "probed", "bound")
        right = stored.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vec", "list")
        return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(compare, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    first = materialize(best(visited(sought.select("id", "vec", F.slice("probed", 1, 1).alias("probed"), none.alias("bound")))).drop("rank"), "ann-first")
    if index.probes > 1:
        bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        rest = sought.join(bounds, F.col("id") == F.col("query_id"), "left").select("id", "vec", F.slice("probed", 2, index.probes).alias("probed"), F.coalesce("bound", none).alias("bound"))
        first = first.unionByName(visited(materialize(rest, "ann-rest")))
    return best(first).select("query_id", "rank", "vec_id", "score")


def op5_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)


QUERIES = {"op5_adaptive_ann": op5_adaptive_ann}
