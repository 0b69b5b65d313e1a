"""N-gram Jaccard join with prefix trees: which documents' shingle sets are linked, and their components.

1. One pass over the texts makes a small row a document (key, set size, set digest), and counts
   the shingles that are frequent within a task's share; the ``COMMON`` most frequent of all are kept.
2. A second pass sends signatures to the shuffle.  Linked sets of up to so many elements differ in at most d of them; with the
   universe of shingles split by hash into d + 1 + e parts, they have e + 1 parts in common, whole.  A signature is the hash
   of all of a set's elements in a part, half a dozen as a rule, so texts that just share a passage rarely meet.  Parts that
   are empty, or hold common shingles only, say little; they are left out where a set has e of them at most, which
   leaves a common part to any linked pair.  Sets of one content leave a task once, and of a signature that ``CROWD`` sets of a task
   share, one row with the range of their sizes does: a signature of very many near copies has a few rows a task.
   Sizes fall into intervals by the threshold; a set uses the parts of its own interval and of the next one.
3. In each signature's run, ordered by size, neighbours of which the smaller has less than t of
   the larger's size are parted, since no pair across can link.  Everybody else gets an edge to the first member.
   A run of two is a pair, and is dropped if the sets' counts by hash bucket (``sketch``) differ by more than links can.
   Components of these edges are the blocks; linked sets are always in one block.  Only documents in blocks are read a third time.
4. Each block's sets, in one global order (common shingles by falling frequency in all texts, then the rest by hash), are joined with a prefix tree (``prefix_tree``).  A block of more than ``BLOCK_SETS`` is cut in chunks
   by hash, each joined with itself and with ``PIVOTS`` sets of the block, which connects most of a large group
   of near copies.  Sets of the block that are still apart meet where they share one of their rarest shingles
   (linked sets do: prefix filtering), if sizes, places and sketches allow a link: first each with one of a few sets of the shingle,
   which connects near copies of different chunks, then in cells of those that are apart even so, each cell joined with a prefix tree.
   So no group is larger than two chunks, no pair is left out, and no step lists pairs: a set has a row for a rare shingle, at most one a cell.
5. Components of the links and of equal sets give the classes.  Equal sets are found within each task first, so that
   a content with very many copies has one row a task in the join by digests.

Exact but for chance clashes of 64-bit hashes within two compared sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import components, discard, materialize, quoted, release, runs, ship, table, tidy
from .prefix_tree import join_sets
from .pretokens import slices
from .shingles import _mixed, shingle_sets

#: Shingles that are known to be common, at most; they are broadcast (8 bytes each).
COMMON = 1 << 18
#: A shingle counts as frequent in a task's share of the texts from this many sets on.
FREQUENT = 2
#: Sets of a chunk, and sets of a large block, and of a rare shingle, that all others there are compared with first.
BLOCK_SETS, PIVOTS = 1000, 8
#: Sets of a block of a shared rare shingle, pairs that a task looks at at once, and buckets of the sketches there.
GROUP, PAIRS, SMALL = 500, 40_000, 256
#: Keys that are broadcast to pick documents, at most (four longs each, 64 MB in all); beyond that the documents are shuffled.
BROADCAST_KEYS = 2_000_000
#: Hashes that a task holds while it counts, and signatures that it holds to find those that many of its sets share: so many sets.
HELD, HELD_SIGNS, CROWD = 2_000_000, 1_000_000, 8


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> bytes:
    """Elements by hash bucket, one byte each (255 and more are 255); 64 to 4096 buckets, about 16 elements in each.

    The summed differences of two sketches are at most the number of elements that only one set has.
    """
    size = 64
    while size < 4096 and size * 16 < len(s):
        size *= 2
    return np.minimum(np.bincount(_bucket(s, size), minlength=size), 255).astype(np.uint8).tobytes()


def _bucket(s: np.ndarray, size: int) -> np.ndarray:
    return ((((s.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def may_link(x: bytes, y: bytes, most: int) -> bool:
    """Whether sets of these sketches can differ in ``most`` elements or fewer."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    while len(a) > len(b):
        a = a[::2] + a[1::2]
    while len(b) > len(a):
        b = b[::2] + b[1::2]
    return int(np.abs(a - b).sum()) <= most


def heads(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """Rows (key, n, digest, sketch, twin) of documents and rows (shingle, times) of frequent shingles.

    ``twin``: the key of the first document with the same digest in the task, if that is another row.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("twin", pa.int64()), ("shingle", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: dict[bytes, int | None] = {}

        def frequent() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found, times = found[times >= FREQUENT], times[times >= FREQUENT]
            none = [pa.nulls(len(found), f.type) for f in schema]
            return pa.RecordBatch.from_arrays([*none[:5], pa.array(found), pa.array(times, pa.int64())], schema=schema)

        for batch in slices(batches):
            n, digests, sketches, twins = [], [], [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                n.append(len(s))
                digests.append(digest := _digest(s))
                sketches.append(sketch(s))
                twins.append(seen.get(digest) if len(s) and doc is not None else None)
                if digest not in seen:
                    held.append(s)
                    size += len(s)
                if seen.get(digest) is None:
                    seen[digest] = doc
                if size > HELD:
                    yield frequent()
                    held, size = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(twins, pa.int64()), none, none], schema=schema)
        if held:
            yield frequent()
            held.clear()
        tidy()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, n long, digest binary, sketch binary, twin long, shingle long, times long")


def common_shingles(head: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``COMMON`` most frequent shingles, ascending, and the place of each by falling frequency.

    Eighth-powers of two of the counts make a few hundred steps; the highest ones that hold few enough are taken, so only they reach the driver.
    """
    total = head.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    total = materialize(total.withColumn("step", F.floor(F.log2("times") * 8).cast("int")), "shingle-counts")
    cut, room = None, COMMON
    for r in total.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        cut = r.step
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    found = total.where(F.col("step") >= cut).select("shingle", "times").toArrow()
    discard(total)
    shingle, times = (c.to_numpy() for c in found.columns)
    order = np.argsort(shingle)
    place = np.empty(len(shingle), np.int32)
    place[np.lexsort((shingle[order], -times[order]))] = np.arange(len(shingle))
    return shingle[order], place


class Parts:
    """The size intervals for threshold num/den, and for each its number of parts and how many may be left out."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]

    def interval(self, n: int) -> int:
        """The interval that holds size n; a linked partner is in it or a neighbour."""
        while self.bounds[-1] <= n:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, (b - 1) * self.den // self.num + 1))
        return bisect_right(self.bounds, n) - 1

    def scheme(self, interval: int) -> tuple[int, int, int]:
        """(most differing elements d, spare parts e, parts) for sets up to the interval's largest size."""
        while len(self.bounds) <= interval + 1:
            self.interval(self.bounds[-1])
        d = (self.den - self.num) * 2 * (self.bounds[interval + 1] - 1) // (self.den + self.num)
        e = 0 if d == 0 else 1 if d <= 5 else 1 + -(-d // 8)
        return d, e, d + 1 + e


def part_signatures(s: np.ndarray, common: np.ndarray, parts: Parts) -> np.ndarray:
    """Signatures (int64) of a non-empty set.  ``common``: for each element whether it is a common shingle."""
    own = parts.interval(len(s))
    unsigned = (s.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    value = _mixed(s.view(np.uint64))
    out = []
    for interval in (own, own + 1):
        d, spare, k = parts.scheme(interval)
        if interval > own and d == 0:
            continue
        part = (unsigned * np.uint64(k)) >> np.uint64(32)  # ascending, as s is
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(begin, len(s)))
        salt = np.uint64((interval * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        total = np.add.reduceat(value, begin) + (part[begin] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        sign = _mixed((total + size.astype(np.uint64)) ^ salt)
        weak = np.add.reduceat(common.astype(np.int64), begin) == size
        empty = k - len(begin)
        if empty + np.count_nonzero(weak) <= spare:
            sign = sign[~weak]
        elif empty:
            gone = np.setdiff1d(np.arange(k, dtype=np.uint64), part[begin], assume_unique=True)
            sign = np.concatenate([sign, _mixed(((gone + np.uint64(1)) * np.uint64(0x165667B19E3779F9)) ^ salt)])
        out.append(sign)
    return np.concatenate(out).view(np.int64)


def crowds(sign: np.ndarray, key: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (sign, key, span) of signatures, and rows (centre, key, -1) that link a set to another one in place of a signature that many share.

    The span of one set is its size, that of many the range of theirs as ``1 << 62 | hi << 31 | lo``: small numbers pack well in the shuffle.
    """
    order = np.argsort(sign)
    ordered = sign[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(sign)))
    many = order[np.repeat(size >= CROWD, size)]
    # the rest in the order of sets, in which it packs well
    crowded = np.zeros(len(sign), bool)
    crowded[many] = True
    few = np.flatnonzero(~crowded)
    own = [(sign[few], key[few], n[few])]
    if len(many):
        many = many[np.lexsort((key[many], n[many], sign[many]))]
        s, k, m = sign[many], key[many], n[many]
        # parted where no pair across can link
        start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (m[:-1] * den < m[1:] * num)]))
        size = np.diff(np.append(start, len(s)))
        own.append((s[start], k[start], np.where(size > 1, 1 << 62 | m[start + size - 1] << 31, 0) | m[start]))
        to = np.repeat(k[start], size)
        edges = np.unique(np.stack([to, k])[:, to != k], axis=1)
        own.append((edges[0], edges[1], np.full(edges.shape[1], -1)))
    return tuple(np.concatenate(c) for c in zip(*own, strict=True))


def signatures(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray, key: str, text: str) -> DataFrame:
    """Rows (sign, key, span) of all sets; see ``crowds``.  ``common``: the common shingles, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = shared.value, Parts(num, den)
        seen: set[bytes] = set()
        signs: list[np.ndarray] = []
        sizes: list[int] = []
        full: list[int] = []

        def rows() -> pa.RecordBatch:
            reach = [len(x) for x in signs]
            found = crowds(np.concatenate(signs), np.repeat(np.array(full, np.int64), reach), np.repeat(np.array(sizes, np.int64), reach), num, den)
            for held in (signs, sizes, full):
                held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["sign", "key", "span"])

        held = 0
        for batch in slices(batches):
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                if doc is None or not len(s) or (digest := _digest(s)) in seen:
                    continue
                seen.add(digest)
                hit = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
                signs.append(part_signatures(s, hit, parts))
                sizes.append(len(s))
                full.append(doc)
                held += len(signs[-1])
                if held > HELD_SIGNS:
                    yield rows()
                    held = 0
        if signs:
            yield rows()
        tidy()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "sign long, key long, span long")


def likely_pairs(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs``(u, v) whose sketches don't rule out a link; ``rows`` has key, n and sketch."""
    ends = rows.where("key is not null and n > 0").select("key", "n", "sketch")
    x = pairs.join(ends.toDF("u", "nu", "su"), "u").join(ends.toDF("v", "nv", "sv"), "v").select("u", "v", "nu", "nv", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, nu, nv, su, sv = (c.to_pylist() for c in b.columns)
            keep = [may_link(p, q, (den - num) * (m + n) // (den + num)) for m, n, p, q in zip(nu, nv, su, sv, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return x.mapInArrow(run, "u long, v long")


def blocks(signed: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component): blocks of the documents that may be linked with others.  ``signed``: see ``signatures``."""
    most = F.lit((1 << 31) - 1)
    many, low = F.col("span") >= 1 << 62, F.col("span").bitwiseAND(most)
    high = F.when(many, F.shiftright("span", 31).bitwiseAND(most)).otherwise(low)
    # dealt before the range is unpacked, so that three numbers a row are shuffled
    signed = signed.repartition("sign").withColumn("low", low)
    order = Window.partitionBy("sign").orderBy("low", "key")
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    centre = F.last(F.when(before.isNull() | (before * den < low * num), F.col("key")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    alone = F.sum(F.when(many, 3).otherwise(1)).over(Window.partitionBy("sign")) == 2
    is_edge = F.col("span") == -1
    edges = signed.select(F.col("key").alias("u"), F.when(is_edge, F.col("sign")).otherwise(centre).alias("v"), (alone & ~is_edge).alias("pair"))
    edges = materialize(edges.where("u <> v").distinct(), "block-edges")
    release(signed.sparkSession)
    several = edges.where("not pair").select("u", "v")
    pairs = edges.where("pair").select("u", "v")
    return components(several.unionByName(likely_pairs(pairs, rows, num, den)), "blocks")


def chosen_sets(docs: DataFrame, placed: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(component, chunk, node, part, shingles) of the documents in ``placed``, which has the first columns."""
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    # broadcast by the number of rows that are there, not by an estimate
    small = placed.count() <= BROADCAST_KEYS
    picked = rows.join(F.broadcast(placed) if small else placed.hint("merge"), "node").select("component", "chunk", "node", "part", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # as bytes: no list of numbers is ever built
            sets = [s.tobytes() for s in shingle_sets(batch.column(4).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["component", "chunk", "node", "part", "shingles"])
        tidy()

    return picked.mapInArrow(run, "component long, chunk long, node long, part long, shingles binary")


def tree_links(sets: DataFrame, num: int, den: int, common: Broadcast, parts: bool = False) -> DataFrame:
    """(u, v): links within each (component, chunk), enough to connect all that is linked.

    ``common``: broadcast shingles and places that tell the global order.  ``parts``: rows with one ``part`` are connected already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = common.value

        def order(flat: np.ndarray) -> np.ndarray:
            """The elements' numbers by the global order."""
            if not len(known):
                return np.argsort(flat)
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            return np.lexsort((flat, np.where(known[at] == flat, place[at], len(known))))

        for rows, bounds in runs(batches, 2):
            found: list[tuple[int, int]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    run_ = rows.slice(a, b - a)
                    node, part = run_.column(2).to_pylist(), run_.column(3).to_pylist()
                    group = [np.frombuffer(x, np.int64) for x in run_.column(4).to_pylist()]
                    found += [(node[x], node[y]) for x, y in join_sets(group, num, den, True, part if parts else None, order)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])
        tidy()

    return sets.repartition("component", "chunk").sortWithinPartitions("component", "chunk").mapInArrow(run, "u long, v long")


def block_links(docs: DataFrame, labels: DataFrame, k: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray], key: str, text: str) -> DataFrame:
    """(u, v): links of all blocks (``labels``: node, component)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    sizes = materialize(labels.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_SETS), "large-sizes")
    n_large = sizes.count()
    # only large blocks are told, by broadcast if they are few, so that a block's rows stay where they are
    of_large = F.broadcast if n_large <= BROADCAST_KEYS else lambda t: t.hint("merge")
    placed = labels.join(of_large(sizes), "component", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("m") / BLOCK_SETS), F.lit(1).cast("long")))
    placed = materialize(placed.select("component", F.expr("pmod(xxhash64(node, 17L), chunks)").alias("chunk"), "node", F.col("node").alias("part"), "chunks"), "block-chunks")
    own = placed.drop("chunks")
    large = placed.where("chunks > 1")
    if not n_large:
        return materialize(tree_links(chosen_sets(docs, own, k, key, text), num, den, shared), "links-own")

    # some sets of a large block go to all its chunks
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("node"), "node"))
    pivots = large.withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    pivots = pivots.select("component", "chunk", "node", every.alias("other"), "part").where("other <> chunk").select("component", F.col("other").alias("chunk"), "node", "part")
    first = materialize(tree_links(chosen_sets(docs, materialize(own.unionByName(pivots), "block-places"), k, key, text), num, den, shared), "links-own")

    # sets of a block that are still apart are compared where they share a rare shingle
    found = components(first, "links-own-cc")
    large = large.drop("part").join(found.select("node", F.col("component").alias("part")).hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    large = materialize(large.select("component", F.lit(0).cast("long").alias("chunk"), "node", "part"), "large-blocks")
    rest = of_large(large.groupBy("component").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("component"))
    sets = materialize(chosen_sets(docs, large.join(rest, "component"), k, key, text).select("node", "part", "shingles"), "large-sets")
    rare = materialize(rare_shingles(sets, num, den, shared), "rare-shingles")
    near = materialize(verified(pivot_pairs(rare, num, den).distinct(), sets, num, den), "links-pivots")
    parts = materialize(merged(sets.select("node", "part").distinct(), near), "stray-parts")
    of_nodes = F.broadcast(parts) if parts.count() <= BROADCAST_KEYS else parts.hint("merge")
    cells = crossing(rare.drop("part").join(of_nodes, "node"), num, den)
    cells = materialize(cells.join(sets.select("node", "shingles"), "node").select("component", "chunk", "node", "part", "shingles"), "stray-cells")
    return first.unionByName(near).unionByName(materialize(tree_links(cells, num, den, shared, parts=True), "links-strays"))


def rare_shingles(sets: DataFrame, num: int, den: int, common: Broadcast) -> DataFrame:
    """Rows (shingle, node, part, n, pos, sketch) of each set's rarest shingles, so many that linked sets have one of these in common.

    ``sets``: node, part, shingles.  Of n elements in one global order, rare ones first, linked sets share one of the first n - ceil(n num/den) + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = common.value
        for batch in slices(batches):
            nodes, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, n, counts, sketches = [], [], [], []
            for x in batch.column(2).to_pylist():
                s = np.frombuffer(x, np.int64)
                at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                rank = np.where(known[at] == s, len(known) - place[at], 0) if len(known) else np.zeros(len(s), np.int64)
                found.append(s[np.lexsort((s, rank))[: len(s) - -(-len(s) * num // den) + 1]])
                n.append(len(s))
                counts.append(len(found[-1]))
                sketches.append(np.minimum(np.bincount(_bucket(s, SMALL), minlength=SMALL), 255).astype(np.uint8).tobytes())
            where = np.repeat(np.arange(len(n)), counts)
            pos = np.arange(len(where)) - np.repeat(np.cumsum(counts) - counts, counts)
            own = pa.array(where)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), *(pa.array(c, pa.int64()).take(own) for c in (nodes, parts, n)), pa.array(pos, pa.int64()), pa.array(sketches, pa.binary()).take(own)],
                names=["shingle", "node", "part", "n", "pos", "sketch"],
            )
        tidy()

    return sets.where(F.length("shingles") > 0).mapInArrow(run, "shingle long, node long, part long, n long, pos long, sketch binary")


def may_share(n: np.ndarray, pos: np.ndarray, part: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (left, right) of rows of one shingle (see ``rare_shingles``) are of different parts and may link, by sizes, places in the order and sketches."""
    total = n[left] + n[right]
    least = -(-num * total // (num + den))
    reach = np.minimum(n[left] - pos[left], n[right] - pos[right])  # elements from here on
    ok = (part[left] != part[right]) & (reach >= least) & (np.minimum(n[left], n[right]) >= least)
    at = np.flatnonzero(ok)
    ok[at] = np.abs(sketch[left[at]] - sketch[right[at]]).sum(1) <= (total - 2 * least)[at]
    return ok


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SMALL).astype(np.int16)


def pivot_pairs(rare: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): for each set and each of its rare shingles the first of the shingle's ``PIVOTS`` smallest nodes that it may link with: a row at most.

    Near copies share most of their rare shingles, so nearly all of them meet the same few nodes.
    """
    groups = rare.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the first rows of the shingle that the last batch ended in
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            old = 0 if held is None else len(held)
            t = t if held is None else pa.concat_tables([held, t])
            shingle, node, part, n, pos = (t.column(c).to_numpy() for c in range(5))
            sketch = _sketches(t.column(5))
            begin = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            start = np.repeat(begin, np.diff(np.append(begin, len(t))))
            pivot = np.full(len(t), -1)
            for j in range(PIVOTS):
                at = np.flatnonzero((start + j < np.arange(len(t))) & (pivot < 0))
                at = at[at >= old]
                at = at[may_share(n, pos, part, sketch, at, start[at] + j, num, den)]
                pivot[at] = start[at] + j
            at = np.flatnonzero(pivot >= 0)
            pair = np.unique(np.stack([node[at], node[pivot[at]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])
            # copied, so that the batch itself goes
            held = t.slice(begin[-1], min(PIVOTS, len(t) - begin[-1])).take(pa.array(np.arange(min(PIVOTS, len(t) - begin[-1]))))
        tidy()

    rows = rare.join(groups.select("shingle"), "shingle").select("shingle", "node", "part", "n", "pos", "sketch")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(run, "u long, v long")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part): ``parts``(node, part) after each part took the smallest number among the parts it is linked with, and the number which that one took."""
    ends = links.join(parts.toDF("u", "a"), "u").join(parts.toDF("v", "b"), "v").where("a <> b").select("a", "b").distinct()
    both = ends.union(ends.select("b", "a"))
    low = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")), "part-hubs")
    hubs = low.join(low.toDF("b", "c"), "b").select(F.col("a").alias("part"), F.col("c").alias("hub"))
    return parts.join(hubs, "part", "left").select("node", F.coalesce("hub", "part").alias("part"))


def crossing(rare: DataFrame, num: int, den: int) -> DataFrame:
    """(component, chunk, node, part): for each rare shingle, in cells of up to two blocks, the sets that may link with a set of another part there: a row a set, not a pair.

    Of a shingle's sets those of its largest part needn't meet each other.  They are cut into blocks of ``GROUP``, all others into blocks too,
    and only pairs of blocks with one of the others make a cell (component: the shingle, chunk: the two blocks).
    """
    counts = rare.groupBy("shingle", "part").agg(F.count("*").alias("m"))
    groups = counts.groupBy("shingle").agg(F.sum("m").alias("m"), F.max(F.struct("m", "part")).alias("top")).where("m > top.m")
    groups = groups.select("shingle", F.col("top.part").alias("home"), F.ceil(F.col("top.m") / GROUP).alias("inner"), F.ceil((F.col("m") - F.col("top.m")) / GROUP).alias("outer"))
    cells = rare.join(groups, "shingle")
    at_home = F.col("part") == F.col("home")
    own = F.when(at_home, F.expr("pmod(xxhash64(node, 31L), inner)")).otherwise(F.expr("inner + pmod(xxhash64(node, 31L), outer)"))
    other = F.explode(F.sequence(F.when(at_home, F.col("inner")).otherwise(F.lit(0).cast("long")), F.col("inner") + F.col("outer") - 1))
    cells = cells.withColumn("own", own).withColumn("other", other)
    chunk = F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other")
    cells = cells.select("shingle", chunk.alias("chunk"), "part", "node", "own", "n", "pos", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 2):
            part, own, n, pos = (t.column(c).to_numpy() for c in (2, 4, 5, 6))
            sketch = _sketches(t.column(7))
            chunk = t.column(1).to_numpy()
            within = chunk >> 31 == chunk & (1 << 31) - 1
            cell = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            change = np.flatnonzero((part[1:] != part[:-1]) | (cell[1:] != cell[:-1])) + 1
            begin = np.concatenate([[0], change, [len(t)]])
            past = np.repeat(begin[1:], np.diff(begin))  # the first row after those of this part in this cell
            after = np.repeat(bounds[1:], np.diff(bounds)) - past
            hit = np.zeros(len(t), bool)
            for some in np.split(np.arange(len(t)), np.flatnonzero(np.diff(np.cumsum(after) // PAIRS)) + 1):
                count = after[some]
                left = np.repeat(some, count)
                right = np.repeat(past[some], count) + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
                ok = within[left] | (own[left] != own[right])  # two sets of one block meet in its own cell
                left, right = left[ok], right[ok]
                ok = may_share(n, pos, part, sketch, left, right, num, den)
                hit[left[ok]] = hit[right[ok]] = True
            rows = t.select(["shingle", "chunk", "node", "part"]).filter(pa.array(hit)).rename_columns(["component", "chunk", "node", "part"])
            yield from rows.to_batches()
        tidy()

    cells = cells.repartition("shingle", "chunk").sortWithinPartitions("shingle", "chunk", "part")
    return cells.mapInArrow(run, "component long, chunk long, node long, part long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs``(u, v) whose sets (node, shingles) are linked."""
    x = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v").select("u", "v", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common * den >= num * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return x.mapInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row; sets link at Jaccard similarity ``num/den`` or more.

    ``component_id`` is the smallest key reachable by links, the row's own included.  Null and empty texts
    (no words) have an empty set and link with nothing.  Rows with one key are one document: they share a
    component.  A row without a key keeps its set size and gets a null component.  An empty table gives an empty one, and columns
    other than ``key`` and ``text`` aren't read.
    """
    ship(docs.sparkSession)
    head = materialize(heads(docs, k, key, text), "shingle-heads")
    common = common_shingles(head)

    rows = head.where("digest is not null").select("key", "n", "digest", "sketch", "twin")
    labels = materialize(blocks(signatures(docs, k, num, den, common[0], key, text), rows, num, den), "block-labels")
    # of equal sets a block has one
    labels = labels.join(rows.select(F.col("key").alias("node"), "digest"), "node").groupBy("component", "digest").agg(F.min("node").alias("node"))
    labels = materialize(labels.select("node", "component").distinct(), "block-firsts")
    release(docs.sparkSession)
    links = block_links(docs, labels, k, num, den, common, key, text)
    # of one content each task has one row without a twin
    firsts = rows.where("n > 0 and key is not null and twin is null").select("key", "digest")
    same = firsts.groupBy("digest").agg(F.min("key").alias("v"), F.max("key").alias("w")).where("v <> w")
    equal = firsts.join(same.select("digest", "v"), "digest").select(F.col("key").alias("u"), "v")
    equal = equal.unionByName(rows.where("twin is not null").select(F.col("key").alias("u"), F.col("twin").alias("v"))).where("u <> v")
    classes = components(links.select("u", "v").unionByName(equal), "jaccard")
    found = rows.join(classes, rows["key"] == classes["node"], "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another stands for: of each component the document with the smallest key stays.

    Rows without a key or without words all stay.  Where keys repeat, rows count as documents of their own (numbered in a written
    copy of the table), so different texts of one key are judged one by one and of equal ones a single row stays.  Columns may have any name.
    """
    if docs.where(F.col(quoted(key)).isNotNull()).groupBy(quoted(key)).count().where("count > 1").limit(1).count():
        number = F.when(F.col(quoted(key)).isNotNull(), F.monotonically_increasing_id())
        rows = materialize(docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"), number.alias("number")), "numbered-documents")
        found = materialize(jaccard_components(rows, k, num, den, "number", "text"), "jaccard-classes").where("number is not null")
        keyed = found.join(rows.where("number is not null").select("number", "key"), "number")
        stays = keyed.groupBy("component_id").agg(F.min(F.struct("key", "number")).getField("number").alias("number"))
        return _without(rows, found.join(stays, "number", "left_anti").select("number"), "number").select("row.*")
    found = materialize(jaccard_components(docs, k, num, den, key, text), "jaccard-classes")
    gone = found.where(F.col(quoted(key)) != F.col("component_id")).select(quoted(key))
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(key)).alias("key"))
    return _without(packed, gone.toDF("key"), "key").select("row.*")


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` but those with a key in ``gone``, which is broadcast if its rows, counted, are few."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone.hint("merge"), key, "left_anti")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
