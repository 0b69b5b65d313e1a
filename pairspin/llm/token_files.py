"""Token-id files: a shared zstandard dictionary, one frame for each document, an offset index.

A data set is a folder in the shared store::

    dict-<sha256>.zdict      the dictionary (absent if nothing could be trained)
    shard-NNNNN.tok          header, one frame a document, index, footer

Header: magic (8 bytes), SHA-256 of the dictionary (32), bytes an id (1).  Frame: the document's
ids, little-endian, compressed alone with the dictionary.  Index: a row (doc_id, is_null, offset,
size, n_tokens) a document.  Footer: index offset, rows, CRC-32 of the index, magic.  One
document is read with two small ranged reads (footer with index, then its frame).

Documents are range-partitioned by id and sorted, so that shard order and place within a shard are ascending ids
and each task writes one shard as a stream.  A task writes under a name of its attempt
and moves the finished file, so lost executors leave no half-written shard that is listed.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, scratch, table
from .pretokens import BatchEncoder, library_encoder, slices

MAGIC = b"TOKSHRD1"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
FOOTER = "<QQI8s"
#: The dictionary's size, and the texts that it is trained on: a bounded sample, only of texts of at most so many signs.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_SIGNS = 64 << 10, 800, 20_000
LEVEL = 3


@lru_cache(maxsize=4)
def encoder(path: str) -> BatchEncoder:
    """Kept from task to task in a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return library_encoder(path)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, text: str = "text") -> bytes:
    """Dictionary from the ids of ``SAMPLE_DOCS`` texts, chosen by content hash.

    With too few samples to train on, their joined bytes serve as a raw dictionary; without any it is empty.
    """
    import zstandard

    # the least hashes first, then their texts: what tasks send to the driver is small
    fit = docs.where(F.length(text).between(1, SAMPLE_SIGNS)).select(text, F.xxhash64(text).alias("h"))
    least = fit.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = fit.where(F.col("h") <= least).orderBy("h", text).limit(SAMPLE_DOCS).select(text)
    ids = encoder(path).encode([r[0] for r in sample.collect()])
    samples = [np.append(x, end_id).astype(f"<u{width}").tobytes() for x in ids]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def _coder(dictionary: bytes, write: bool):
    import zstandard

    kind = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if len(dictionary) >= 8 else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **kind) if write else zstandard.ZstdDecompressor(**kind)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode, append ``end_id`` and write; returns the manifest (shard, path, n_docs, n_tokens, n_bytes) in shard order.

    Null texts count as empty (the end id alone); null keys come first, equal keys in order of their texts.
    """
    spark = docs.sparkSession
    width = 2 if max(_largest(path), end_id) < 1 << 16 else 4
    dictionary = train_dictionary(docs, path, end_id, width, text)
    name = hashlib.sha256(dictionary).hexdigest()
    place, root = _store(folder)
    place.create_dir(root, recursive=True)
    with place.open_output_stream(f"{root}/dict-{name}.zdict") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        task = TaskContext.get()
        shard = task.partitionId()
        final = f"{top}/shard-{shard:05d}.tok"
        own = f"{final}.{task.taskAttemptId()}"
        zstd, encode = _coder(shared.value, True), encoder(path)
        at, n_tokens, parts = len(MAGIC) + 33, 0, []
        out = None
        for batch in slices(batches):
            if out is None:
                out = store.open_output_stream(own)
                out.write(MAGIC + bytes.fromhex(name) + bytes([width]))
            keys = batch.column(0).to_pylist()
            index = np.zeros(len(keys), INDEX)
            for k, ids in enumerate(encode.encode(batch.column(1).to_pylist())):
                frame = zstd.compress(np.append(ids, end_id).astype(f"<u{width}").tobytes())
                out.write(frame)
                index[k] = (keys[k] or 0, keys[k] is None, at, len(frame), len(ids) + 1)
                at += len(frame)
                n_tokens += len(ids) + 1
            parts.append(index)
        if out is None:
            return
        rows = np.concatenate(parts)
        out.write(rows.tobytes() + struct.pack(FOOTER, at, len(rows), zlib.crc32(rows.tobytes()), MAGIC))
        out.close()
        store.move(own, final)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [final], "n_docs": [len(rows)], "n_tokens": [n_tokens], "n_bytes": [at + rows.nbytes + struct.calcsize(FOOTER)]},
            schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]),
        )

    rows = docs.select(key, text)
    rows = rows.repartitionByRange(shards, key) if shards else rows.repartitionByRange(key)
    done = rows.sortWithinPartitions(key, text).mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, n_bytes long")
    return materialize(done, "token-manifest")


def _largest(path: str) -> int:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


class ShardReader:
    """Reads documents of one shard; checks magic, dictionary hash and the index's checksum."""

    def __init__(self, folder: str, path: str):
        self.store, top = _store(folder)
        self.file = self.store.open_input_file(path)
        size = self.file.size()
        at, n, crc, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        content = self.file.read_at(n * INDEX.itemsize, at)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC or zlib.crc32(content) != crc:
            raise ValueError(f"{path} is damaged")
        self.index = np.frombuffer(content, INDEX)
        self.width = head[-1]
        with self.store.open_input_stream(f"{top}/dict-{head[len(MAGIC) : -1].hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[len(MAGIC) : -1]:
            raise ValueError(f"the dictionary of {path} is another one")
        self.zstd = _coder(dictionary, False)

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in index row ``row``."""
        entry = self.index[row]
        frame = self.file.read_at(int(entry["size"]), int(entry["offset"]))
        return np.frombuffer(self.zstd.decompress(frame), f"<u{self.width}")

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document by id, the first if several have it, or None."""
        found = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["is_null"] == 0))
        return self.ids(int(found[0])) if len(found) else None

    def all(self) -> Iterable[tuple[int | None, np.ndarray]]:
        for row, entry in enumerate(self.index):
            yield (None if entry["is_null"] else int(entry["doc_id"])), self.ids(row)


def read_shards(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone; one task can read each shard.

    ``start`` counts the ids of all documents before it: the shards' totals are summed in shard
    order (a row a shard), the rest within the shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc, ids in ShardReader(folder, path).all():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("start"))
    return placed.repartition("path").mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "token-files")
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(manifest, folder)


QUERIES = {"op1_token_files": op1_token_files}
