"""Token counts by way of a cache keyed by content digest and tokenizer version.

Counts of contents that were seen before, in this run or an earlier one, come out of the cache by a join on digests.
Of the rest, one text of each distinct content is encoded, and its count is appended.

Plan: two scans of the texts.  The first makes (key, size, digest) rows.  The second is for unknown digests only: a
task passes on one text of each digest it meets, so a content with very many copies is no hot group, the
shuffle brings those of one digest together, and the first is encoded.  With a cache that knows most, the texts to pass on are
picked by a broadcast of the unknown digests, if they are few; texts that hit are not shuffled then.
The last join, rows to counts, moves digests only; digests of more than 1/1024 of the rows get theirs by broadcast.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, scratch, table, tidy
from .pretokens import BatchEncoder, library_encoder, slices

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Unknown digests that are broadcast at most, if some are known (32 bytes each, 64 MB with their table); the counts are the same either way.
BROADCAST_DIGESTS = 500_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, with the name of the library that reads it."""
    with open(path, "rb") as f:
        return f"{'sentencepiece' if path.endswith('.model') else 'tokenizers'}:{hashlib.sha256(f.read()).hexdigest()}"


@lru_cache(maxsize=4)
def _fast(path: str) -> BatchEncoder | None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    try:
        return library_encoder(path)
    except (ValueError, KeyError, TypeError):
        return None


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def count_tokens(path: str, texts: list[str | None]) -> list[int]:
    """Counts as the library gives them, without begin, end or added special tokens."""
    texts = [x or "" for x in texts]
    if path.endswith(".json") and (fast := _fast(path)):
        return [len(x) for x in fast.encode(texts)]
    if path.endswith(".model"):
        return [len(x) for x in _library(path).encode(texts, num_threads=1)]
    return [len(x.ids) for x in _library(path).encode_batch_fast(texts, add_special_tokens=False)]


def cached_counts(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``docs``; ``cache`` is a folder of Parquet files, made if absent.

    A null text counts as an empty one (0 bytes, 0 tokens).  Null keys and repeated rows are kept; equal
    contents share one cache entry whatever their keys.  An entry that two writers appended twice is read once.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def entries() -> DataFrame:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    rows = materialize(docs.select(F.col(key), F.octet_length(content).cast("long").alias("n_bytes"), digest), "token-digests")
    distinct = materialize(rows.groupBy("digest").agg(F.count("*").alias("n")), "distinct-digests")
    total, n_distinct = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    missing = materialize(distinct.select("digest").join(entries(), "digest", "left_anti"), "unknown-digests")
    n_missing = missing.count()
    full = docs.select(digest, F.col(text).alias("t"))
    few = n_missing <= BROADCAST_DIGESTS
    if n_missing < n_distinct and few:
        full = full.join(F.broadcast(missing), "digest", "left_semi")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each digest the first row of a task."""
        seen: set[bytes] = set()
        for batch in slices(batches):
            new = []
            for d in batch.column(0).to_pylist():
                new.append(d not in seen)
                seen.add(d)
            yield batch.filter(pa.array(new, pa.bool_()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches):
            new = []
            for d in batch.column(0).to_pylist():
                new.append(d != last)
                last = d
            batch = batch.filter(pa.array(new, pa.bool_()))
            n = count_tokens(path, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])
        tidy()

    if n_missing:
        firsts = full.mapInArrow(once, "digest binary, t string")
        if n_missing < n_distinct and not few:
            firsts = firsts.join(missing.hint("merge"), "digest", "left_semi")
        firsts.repartition("digest").sortWithinPartitions("digest").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    hot = distinct.where(F.col("n") * 1024 > total).select("digest")  # 1,024 at most
    rest = rows.join(F.broadcast(hot), "digest", "left_anti").join(entries(), "digest")
    return rest.unionByName(rows.join(F.broadcast(entries().join(F.broadcast(hot), "digest", "left_semi")), "digest")).select(key, "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents against a new, empty cache (so that a run's figures show all its work)."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counts = cached_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op10_token_counts": op10_token_counts}
