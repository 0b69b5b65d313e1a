"""Alignment of two tokenizers' tokens on the same bytes, and how often their ids are linked over a corpus.

A byte-level BPE (A) encodes a blank and the text, a SentencePiece model (B) the text, which it marks with that blank itself.  All documents of a
block stand one after another in one run of bytes: the ends of A's tokens and of B's are counted for each byte once, and where
both are, the run is cut into groups.  Running sums over tokens and groups, differenced at the documents' ends, give each document's own figures.
Tokens of one group are linked, each of A's with each of B's.

Plan: texts are read once.  A task makes, for each chunk of documents, the distinct linked id pairs with the number of documents that hold
them, and for each document the places of its own pairs among these; that is written.  Pairs are summed over chunks, the highest count of each A id is
found among its pairs, and each chunk gets the counts of its pairs by a join on both ids, in which a pair has one row a chunk however
many documents hold it.  Documents take their sums from their chunk's row.  What a document holds of its chunk's pairs, the most of the data, goes through
Spark as packed bytes, which Python opens one chunk at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, quoted, table, tidy
from .piece_codec import keyed, piece_encoder, ranges
from .pretokens import byte_signs, library_encoder

#: Signs of a chunk; its documents are encoded together.  A longer text is a chunk of its own.
CHUNK_SIGNS = 1_000_000
#: Documents of a chunk at most, and products of a group's numbers of tokens from which its ids are counted before they are paired.
CHUNK_ROWS, WIDE_GROUP = 4_000, 64
#: Ids are below 2^20, so that a document of a chunk and a pair are one long.
SHIFT = 20
STORE = "chunk long, rows array<struct<{key}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, pairs array<long>, held array<int>, ends binary, which binary, times binary"
#: Chunks of a file, so that a reader holds few of them at a time.
FILE_CHUNKS = 32


@lru_cache(maxsize=2)
def _tools(path_a: str, path_b: str):
    """Encoder, and bytes of all ids one after another with sizes and offsets, of either side."""
    import json

    with open(path_a, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {s: b for b, s in byte_signs().items()}
    words = [b""] * (max(vocab.values()) + 1)
    for word, k in vocab.items():
        words[k] = bytes(back[c] for c in word) if all(c in back for c in word) else b""
    sizes = np.array([*map(len, words)], np.int64)
    side_a = (np.frombuffer(b"".join(words), np.uint8), sizes, np.cumsum(sizes) - sizes)
    b = piece_encoder(path_b)
    return library_encoder(path_a, special=False), side_a, b, (b.model.flat, b.model.sizes, b.model.offset)


@lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimals of 0..n-1, each with room for one sign after it: all bytes, sizes, offsets."""
    texts = [f"{k} " for k in range(n)]
    sizes = np.array([*map(len, texts)], np.int64)
    return np.frombuffer("".join(texts).encode(), np.uint8), sizes, np.cumsum(sizes) - sizes


def _spell(ids: np.ndarray, side: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, sizes, offset = side
    return flat[ranges(offset[ids], sizes[ids])]


def agreeing(texts: Sequence[str], ids: list[np.ndarray], side: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text's."""
    wanted = [t.encode() for t in texts]
    size = np.array([*map(len, wanted)], np.int64)
    sums = np.array([side[1][x].sum() for x in ids], np.int64)
    same = size == sums
    for k in np.flatnonzero(same).tolist():
        same[k] = _spell(ids[k], side).tobytes() == wanted[k]
    return same


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
    """Groups of documents whose A and B tokens have the same bytes.

    (a, b: ids of all documents; group of each token; groups before each document and after the last; tokens of A and of B before each).
    """
    a, b = (np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int64) for x in (ids_a, ids_b))
    end_a, end_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    n = int(end_a[-1]) if len(a) else 0
    cut = (np.bincount(end_a, minlength=n + 1) > 0) & (np.bincount(end_b, minlength=n + 1) > 0)
    before = np.cumsum(cut) - cut  # cuts before each byte
    bounds_a, bounds_b = (np.cumsum([0, *map(len, x)]) for x in (ids_a, ids_b))
    document = np.append(0, end_a)[bounds_a]  # first byte of each document, and the end
    groups = np.cumsum(cut)[document]
    return a, b, before[end_a], before[end_b], groups, bounds_a, bounds_b


def link_counts(a, b, group_a, group_b, groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) that are linked and their number of links: (document, a, b, times), sorted.

    A group with many tokens on both sides pairs its distinct ids, with the product of their counts.
    """
    count = int(groups[-1])
    document = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
    in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
    times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    wide = in_a * in_b > WIDE_GROUP
    if wide.any():
        a, group_a, times_a = _counted(a, group_a, wide)
        b, group_b, times_b = _counted(b, group_b, wide)
        in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
    first_b = np.cumsum(in_b) - in_b
    times = in_b[group_a]
    left, right = np.repeat(np.arange(len(a)), times), ranges(first_b[group_a], times)
    key = (document[group_a[left]] << 2 * SHIFT) | (a[left] << SHIFT) | b[right]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], (times_a[left] * times_b[right])[order]
    start = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, start) if len(start) else weight
    key = key[start]
    return key >> 2 * SHIFT, (key >> SHIFT) & ((1 << SHIFT) - 1), key & ((1 << SHIFT) - 1), weight


def _counted(ids: np.ndarray, group: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, groups, times), sorted by group, with equal ids of a wide group as one."""
    at = wide[group]
    key, times = np.unique((group[at] << SHIFT) | ids[at], return_counts=True)
    group = np.concatenate([group[~at], key >> SHIFT])
    order = np.argsort(group, kind="stable")
    return np.concatenate([ids[~at], key & ((1 << SHIFT) - 1)])[order], group[order], np.concatenate([np.ones((~at).sum(), np.int64), times])[order]


def group_digests(a, b, group_a, group_b, groups, bounds_a, bounds_b, n_ids: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document, '' for one without tokens."""
    count = int(groups[-1])
    in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
    before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
    ids, sign = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    for x, place, group, mark in ((a, np.arange(len(a)) + before_b[group_a], group_a, "|"), (b, np.arange(len(b)) + upto_a[group_b], group_b, ";")):
        ids[place] = x
        sign[place] = np.where(np.diff(group, append=-1) != 0, ord(mark), ord(","))
    flat, sizes, offset = _decimals(n_ids)
    ends = np.cumsum(sizes[ids])
    out = flat[ranges(offset[ids], sizes[ids])]
    out[ends - 1] = sign
    cuts = np.append(0, ends)[bounds_a + bounds_b]
    data = out.tobytes()
    return [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts of runs of rows, of ``CHUNK_SIGNS`` or one row."""
    keys: list[pa.Array] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        start = 0
        found = batch.column(1).to_pylist()
        for k, t in enumerate(found):
            n = len(t or "")
            if texts and (size + n > CHUNK_SIGNS or len(texts) >= CHUNK_ROWS):
                yield pa.concat_arrays([*keys, batch.column(0).slice(start, k - start)]), texts
                keys, texts, size, start = [], [], 0, k
            texts.append(t)
            size += n
        keys.append(batch.column(0).slice(start, len(found) - start))
    if texts:
        yield pa.concat_arrays(keys), texts


def align_chunk(path_a: str, path_b: str, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Figures of each text and linked pairs of all, see ``STORE``."""
    encode_a, side_a, encode_b, side_b = _tools(path_a, path_b)
    led = [f" {t}" if t else "" for t in texts]
    ids_a, ids_b = encode_a.encode(led), encode_b.pieces_of(texts)
    fits = agreeing(led, ids_a, side_a) & agreeing(led, ids_b, side_b)
    none = np.zeros(0, np.uint32)
    ids_a, ids_b = ([x if ok else none for x, ok in zip(found, fits.tolist(), strict=True)] for found in (ids_a, ids_b))
    a, b, group_a, group_b, groups, bounds_a, bounds_b = align(ids_a, ids_b, side_a[1], side_b[1])
    in_a, in_b = (np.bincount(g, minlength=int(groups[-1])) for g in (group_a, group_b))
    links = np.append(0, np.cumsum(in_a * in_b))[groups]
    n_ids = max(len(side_a[1]), len(side_b[1]))
    digests = group_digests(a, b, group_a, group_b, groups, bounds_a, bounds_b, n_ids)
    document, left, right, times = link_counts(a, b, group_a, group_b, groups)
    pairs, which, held = np.unique((left << SHIFT) | right, return_inverse=True, return_counts=True)
    ends = np.searchsorted(document, np.arange(len(texts)), side="right")
    return {"n_a": np.diff(bounds_a), "n_b": np.diff(bounds_b), "n_groups": np.diff(groups), "n_links": np.diff(links), "groups_sha256": digests, "pairs": pairs, "held": held, "ends": ends, "which": which, "times": times}


def _packed(x: np.ndarray, kind: type) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _opened(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def store_chunks(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() << 32 if context else 0
        for keys, texts in chunks(batches):
            x = align_chunk(path_a, path_b, texts)
            columns = [keys, *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x["groups_sha256"], pa.string())]
            rows = pa.StructArray.from_arrays(columns, names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            arrays = [rows, pa.array(x["pairs"].astype(np.int64)), pa.array(x["held"].astype(np.int32))]
            packed = [pa.array([_packed(x[c], t)], pa.binary()) for c, t in (("ends", np.int32), ("which", np.int32), ("times", np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays([0, len(v)], v) for v in arrays), *packed], names=["chunk", "rows", "pairs", "held", "ends", "which", "times"])
            number += 1
        encode_a, _, encode_b, _ = _tools(path_a, path_b)
        encode_a.forget()
        encode_b.forget()
        tidy()

    return keyed(docs, key, text).mapInArrow(run, STORE.format(key=f"key: {kind}"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A text that is null, empty or not spelled by both sides' tokens has zeros and ''.  Rows that repeat count as documents of their own,
    null keys stay, other columns aren't read; an empty table gives an empty one.  A tie for an A id's highest count is best on all its pairs.
    """
    kind = docs.schema[key].dataType.simpleString()
    store = materialize(store_chunks(docs, path_a, path_b, key, text), "aligned-chunks", maxRecordsPerFile=FILE_CHUNKS)
    held = store.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", SHIFT)), "link-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    # one row a pair at most, told in one long: twice the count, and one more where it is its A id's highest
    told = counts.join(most, "a").select("pair", (F.col("count") * 2 + (F.col("count") == F.col("most")).cast("long")).alias("told"))
    found = held.select("chunk", "place", "pair").join(told, "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "told"))).alias("found"))
    rest = store.select("chunk", "rows", "ends", "which", "times").join(found.select("chunk", F.col("found.told").alias("told")), "chunk", "left")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, told = batch.column(0)[k].values, batch.column(4)[k].values
                ends, which, times = (_opened(batch.column(c)[k].as_py(), t) for c, t in ((1, np.int32), (2, np.int32), (3, np.int64)))
                n = len(rows) if rows is not None else 0
                if not n:
                    continue
                value = told.to_numpy()[which] if told is not None else np.zeros(0, np.int64)
                cut = np.append(0, ends)
                best, total = (np.diff(np.append(0, np.cumsum(x))[cut]) for x in (times * (value & 1), times * (value >> 1)))
                parts = {f.name: rows.field(f.name) for f in rows.type}
                yield pa.RecordBatch.from_arrays(
                    [*(parts[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), parts["groups_sha256"]],
                    names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )
        tidy()

    out = f"{quoted(key)} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rest.select("rows", "ends", "which", "times", "told").mapInArrow(sums, out)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
