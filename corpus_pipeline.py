"""A corpus pipeline over ``documents``, made of operators of ``pairspin.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read back as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairspin.llm import bpe_codec, language_id, mixing, ngram_join
from pairspin.llm._shared import materialize, ship, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents in no language that the labels know, or of doubtful language, go."""
    ship(spark)
    return language_id.judge_documents(docs).where("not rejected").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: five words, similarity 0.8 or more; the smallest id of each group stays."""
    ship(spark)
    return ngram_join.drop_near_duplicates(docs, 5, 80, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: partitions and rows come in the order of the schedule; all rows stay.

    Files don't keep that order when they are scanned, so ``encode`` places the rows anew.
    """
    return mixing.mixed_order(docs, mixing.SHARES)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: ids of each document, and whether they decode to its text, in the order of the schedule.

    A place in the schedule follows from ids and sources alone.  The columns mix_slot and mix_pos tell it, whatever reads the result.
    """
    import public_tokenizers

    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    placed = mixing.mixed_order(docs, mixing.SHARES, places=True)
    return bpe_codec.encode_checked(placed, path, bpe_codec.build_lexicon(docs, path), keep=("mix_slot", "mix_pos"))


STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode),
]

#: SQL can't express the stages on language and similarity; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
