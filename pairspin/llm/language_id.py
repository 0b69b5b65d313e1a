"""Language identification by fusing evidence.

Each document gets, from its whole text, the log likelihood under a byte-trigram model of each
language and of a background.  To that come, as Bayesian factors, what the markup
declares and where the document comes from:

* text: mean log likelihood times min(n, ``EFFECTIVE``) trigrams; neighbouring trigrams are far from independent,
  so long texts must not drown the rest completely;
* declared language: P(declared | language), from counts of (declared, language by text) over all documents, smoothed;
* address: P(language | host), smoothed towards P(language | suffix), which is smoothed towards P(language).

Counts are grouped sums over all documents.  Hosts, suffixes and declarations reach the documents as size-checked broadcasts, and beyond
that size by joins that keep hot hosts apart; the texts themselves are not shuffled unless the hosts' table is that large.  The likelihood models are
fitted on a bounded sample of distinct texts of each label (their first ``SAMPLE_SIGNS`` signs, by content hash); every label that has text takes
part.  Documents declared to be in a language short of training texts are not rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, quoted, table

SAMPLE_DOCS, SAMPLE_SIGNS = 4000, 20_000
#: Texts of a label in the sample, where it has so many: ``SAMPLE_DOCS`` over the labels, between these (Spark limits groups before a shuffle up to 1,000).
LEAST_TEXTS, MOST_TEXTS = 50, 1000
#: Count of a trigram not seen.
FLOOR = 0.02
BITS = 18
#: Trigrams of a text count as so many independent ones at most.
EFFECTIVE = 60
#: Weights of the coarser level: rows of the suffix for a host, of all for a suffix, of a flat share for declarations.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 10.0
#: A document is rejected where the background wins or the best language has less than this.
LEAST = 0.5
#: Log likelihood of a trigram in the background: one of about 30,000 likely ones.  Its prior is low, so short texts aren't lost to it.
BACKGROUND, BACKGROUND_PRIOR = -10.3, 1e-4
UNKNOWN = "und"
#: A table of priors is broadcast where its rows, counted, take so many bytes at most.
BROADCAST_BYTES = 32 << 20


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """Bytes: letters in lower case and bytes of other scripts as they are, all else a blank."""
    out = np.full(256, 32, np.int64)
    out[128:] = range(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Hashes (``BITS`` bits) of the byte trigrams that hold a letter."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
    b = _signs()[raw]
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code[code != 0x202020] * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)


@dataclass(frozen=True)
class Model:
    """Log likelihoods: ``base`` of each language, and what trigrams that it was seen with add; ``starts`` bounds a trigram's entries."""

    base: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    added: np.ndarray

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Log likelihood of a text's trigrams under each language."""
        seen, times = np.unique(hashes, return_counts=True)
        first, n = self.starts[seen], self.starts[seen + 1] - self.starts[seen]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.base * len(hashes) + np.bincount(self.language[at], self.added[at] * np.repeat(times, n), len(self.base))


def enough(texts: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> bool:
    """Whether each of a language's texts (trigrams, times) beats the background under a model of the others."""
    for seen, times in texts:
        n, left = times.sum(), counts.sum() - times.sum()
        mean = np.log((counts[seen] - times + FLOOR) / (left + FLOOR * len(counts))) @ times / max(1, n)
        if n and min(n, EFFECTIVE) * (mean - BACKGROUND) < log(BACKGROUND_PRIOR):
            return False
    return len(texts) > 1


def fit(labelled: DataFrame, labels: list[str], text: str = "text", lang: str = "lang") -> tuple[list[str], Model, list[str]]:
    """The labels that have text, their model, and those of them that have too few texts for a model to reject others by.

    The sample holds the distinct texts of least hash of each label, alike many of each.  A label is short of texts where all of them are in the
    sample, and some text of it would be lost to the background had it not been there.
    """
    per = min(MOST_TEXTS, max(LEAST_TEXTS, SAMPLE_DOCS // max(1, len(labels))))
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("label"), F.col(text).alias("x"), F.xxhash64(text).alias("h"), (F.length(text) > SAMPLE_SIGNS).alias("long"))
    # of labels with many texts only the hashes below a bound, about four times the sample, are ranked, however many tasks there are
    bounds = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("texts"))
    bounds = bounds.select(F.col("label").alias("of"), F.when(F.col("texts") > 4 * per, F.lit(-(2.0**63)) + F.lit(2.0**64 * 4 * per) / F.col("texts")).otherwise(F.lit(2.0**63)).alias("below"))
    near = rows.join(F.broadcast(bounds), F.col("label") == F.col("of")).where(F.col("h") < F.col("below"))  # a row a label
    # hashes first, then their texts: neither tasks nor the driver get more than the sample
    rank = F.row_number().over(Window.partitionBy("label").orderBy("long", "h"))
    chosen = near.groupBy("label", "long", "h").agg(F.lit(1)).select("label", "long", "h", rank.alias("rank")).where(F.col("rank") <= per).drop("rank")
    sample = rows.join(F.broadcast(chosen), ["label", "long", "h"]).groupBy("label", "h").agg(F.min(F.substring("x", 1, SAMPLE_SIGNS)).alias("x")).orderBy("label", "h")
    languages: list[str] = []
    short: list[str] = []
    base, found = [], []
    for name, group in groupby(sample.toLocalIterator(), key=lambda r: r.label):
        texts = [np.unique(trigrams(r.x), return_counts=True) for r in group]
        counts = np.zeros(1 << BITS)
        for seen, times in texts:
            counts[seen] += times
        if len(texts) < per and not enough(texts, counts):
            short.append(name)
        seen = np.flatnonzero(counts)
        base.append(log(FLOOR) - log(counts.sum() + FLOOR * len(counts)))
        found.append((seen, np.full(len(seen), len(languages), np.int32), np.log((counts[seen] + FLOOR) / FLOOR).astype(np.float32)))
        languages.append(name)
    seen, language, added = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    order = np.argsort(seen, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(seen, minlength=1 << BITS))])
    return languages, Model(np.array(base), starts, language[order], added[order]), short


def plain_text(html: str | None) -> str:
    """Text of a page: no scripts, styles, comments or tags.  What an unclosed comment, script or style begins has no text; linear in the length."""
    import html as entities
    import re

    return entities.unescape(re.sub(r"<[^<>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", " ", html or "")))


def text_evidence(spark: SparkSession, model: Model, column: Column, markup: bool = False) -> Column:
    """array(n trigrams, mean log likelihood of each language) of a text or page column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            hashes = trigrams(plain_text(x) if markup else x)
            out.append([float(len(hashes)), *np.round(shared.value.sums(hashes) / max(1, len(hashes)), 9)])
        return pd.Series(out)

    # or a filter on what follows from it would be pushed below, and have each text judged twice
    return evidence.asNondeterministic()(column)


@dataclass(frozen=True)
class Priors:
    """What grouped counts over all documents say: tables by host, suffix and declaration, and the share of each language."""

    share: list[float]
    of_host: DataFrame
    of_suffix: DataFrame
    of_declared: DataFrame


def _numbers(x: Sequence) -> Column:
    return F.array(*map(F.lit, x))


def _by_text(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` with scores, background (log likelihoods of the text, damped) and lang_text, in one struct ``by``."""
    weight = F.least(F.col("ev")[0], F.lit(float(EFFECTIVE)))
    scored = rows.withColumn("by", F.struct(F.transform(F.slice("ev", 2, len(languages)), lambda x: weight * x).alias("scores"), (weight * F.lit(BACKGROUND) + F.lit(log(BACKGROUND_PRIOR))).alias("background")))
    best = F.array_max("by.scores")
    named = F.element_at(_numbers(languages), F.array_position("by.scores", best).cast("int"))
    lang_text = F.when((F.col("ev")[0] == 0) | (F.col("by.background") > best), None).otherwise(named)
    return scored.withColumn("by", F.struct("by.scores", "by.background", lang_text.alias("lang_text")))


def priors(evidence: DataFrame, languages: list[str]) -> Priors:
    """The tables that ``evidence``(host, suffix, declared, ev) gives; one row a host and language leaves the tasks."""
    n = len(languages)
    names = _numbers(languages)
    known = _by_text(evidence.select("host", "suffix", "declared", "ev"), languages).select("host", "suffix", "declared", F.col("by.lang_text").alias("lang_text")).where("lang_text is not null")
    hits = materialize(known.groupBy("host", "suffix", "declared", "lang_text").agg(F.count("*").alias("n")), "language-counts")
    found = {r.lang_text: r.n for r in hits.groupBy("lang_text").agg(F.sum("n").alias("n")).collect()}
    whole = [found.get(name, 0) for name in languages]
    share = [(x + 1.0) / (sum(whole) + n) for x in whole]

    def counted(*keys: str) -> DataFrame:
        per = hits.groupBy(*keys, "lang_text").agg(F.sum("n").alias("n"))
        return per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lang_text", "n"))).alias("counts"), F.sum("n").alias("total"))

    count = lambda name: F.coalesce(F.try_element_at("counts", name), F.lit(0))

    def smoothed(coarse: Column, weight: float) -> Column:
        return F.zip_with(names, coarse, lambda name, x: (count(name) + F.lit(weight) * x) / (F.col("total") + F.lit(weight)))

    suffix = counted("suffix").select("suffix", "total", smoothed(_numbers(share), SUFFIX_WEIGHT).alias("p_suffix"))
    host = counted("host", "suffix")
    joined = host.join(suffix.drop("total"), host.suffix.eqNullSafe(suffix.suffix)).drop(suffix.suffix)
    of_host = joined.select("host", "suffix", "total", smoothed(F.col("p_suffix"), HOST_WEIGHT).alias("p_host"))
    said = counted("declared")
    said = said.select("declared", "total", F.zip_with(names, _numbers([float(x) for x in whole]), lambda name, x: (count(name) + F.lit(DECLARED_WEIGHT * (1.0 / (n + 1)))) / (x + F.lit(DECLARED_WEIGHT))).alias("p_said"))
    return Priors(share, *(materialize(t, "language-priors") for t in (of_host, suffix, said)))


def _looked_up(rows: DataFrame, found: DataFrame, keys: list[str], value: str, row_bytes: int) -> DataFrame:
    """``rows`` with column ``value`` of ``found``, which has one row for each of ``keys`` (nulls equal nulls) and its count ``total``.

    ``found`` is broadcast where its counted rows take ``BROADCAST_BYTES`` at most.  Beyond that only the keys of more than 1/1024 of
    all rows are (so 1,024 at most), which keeps hot keys out of the join by keys that brings the rest.
    """

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        renamed = right.select(*(F.col(k).alias(f"of {k}") for k in keys), *([value] if how != "left_anti" else []))
        match = [left[k].eqNullSafe(F.col(f"of {k}")) for k in keys]
        return left.join(F.broadcast(renamed) if right is not large else renamed.hint("merge"), match, how).drop(*(f"of {k}" for k in keys))

    large = None
    n, total = found.agg(F.count("*"), F.sum("total")).first()
    if n * row_bytes <= BROADCAST_BYTES:
        return joined(rows, found, "left")
    hot, large = found.where(F.col("total") * 1024 > total), found
    return joined(rows, hot, "inner").unionByName(joined(joined(rows, hot, "left_anti"), large, "left"))


def judge(evidence: DataFrame, found: Priors | None, languages: list[str], least: float = LEAST, short: Sequence[str] = ()) -> DataFrame:
    """``evidence``(other columns, host, suffix, declared, ev) with columns lang_text, lang_id, posterior and rejected.

    Null hosts, suffixes and declarations are values of their own.  Text that is declared to be in
    a language ``short`` of training texts is not rejected: neither the background nor a low posterior tells what it is.
    """
    if not languages:
        return evidence.select("*", F.lit(None).cast("string").alias("lang_text"), F.lit(UNKNOWN).alias("lang_id"), F.lit(1.0).alias("posterior"), F.lit(True).alias("rejected"))
    n = len(languages)
    own = evidence.columns
    j = _by_text(evidence, languages)
    j = _looked_up(j, found.of_host, ["host", "suffix"], "p_host", 100 + 8 * n)
    j = _looked_up(j, found.of_suffix, ["suffix"], "p_suffix", 60 + 8 * n)
    j = _looked_up(j, found.of_declared, ["declared"], "p_said", 60 + 8 * n)
    prior, says = F.coalesce(F.col("p_host"), F.col("p_suffix"), _numbers(found.share)), F.coalesce(F.col("p_said"), _numbers([1.0] * n))
    spared = F.coalesce(F.col("declared").isin(list(short)), F.lit(False)) if short else F.lit(False)
    logs = F.zip_with(F.zip_with("by.scores", prior, lambda x, p: x + F.log(p)), says, lambda x, p: x + F.log(p))
    # the background declares anything alike
    other = F.when(spared, F.lit(float("-inf"))).otherwise(F.col("by.background") + F.log(F.array_max(says)))
    j = j.select(*own, F.col("by.lang_text").alias("lang_text"), F.concat(logs, F.array(other)).alias("logs")).withColumn("top", F.array_max("logs"))
    best_k = F.array_position("logs", F.col("top")).cast("int")
    posterior = F.round(1.0 / F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top"))), 6)
    j = j.withColumn("lang_id", F.when(F.col("ev")[0] == 0, F.lit(UNKNOWN)).otherwise(F.element_at(_numbers([*languages, UNKNOWN]), best_k))).withColumn("posterior", posterior)
    return j.withColumn("rejected", (F.col("ev")[0] == 0) | ((F.col("lang_id") == UNKNOWN) | (F.col("posterior") < least)) & ~spared).drop("logs", "top")


def fuse(evidence: DataFrame, languages: list[str], least: float = LEAST, short: Sequence[str] = ()) -> DataFrame:
    """``judge`` with the priors of the same rows.  ``evidence`` is read several times, so it should be a written table."""
    return judge(evidence, priors(evidence, languages) if languages else None, languages, least, short)


def languages_of(labelled: DataFrame, lang: str = "lang") -> list[str]:
    """All labels."""
    return sorted(r[0] for r in labelled.where(F.col(lang).isNotNull()).select(lang).distinct().collect())


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Language of each page (page_id, url, html).

    Null or broken addresses have a null host and suffix, pages without text are rejected as ``und``,
    repeated rows are judged one by one, and an empty table gives an empty one.
    """
    spark = pages.sparkSession
    languages, model, short = fit(labelled, languages_of(labelled))
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"), declared.alias("declared"), text_evidence(spark, model, F.col("html"), markup=True).alias("ev"))
    return fuse(materialize(rows, "page-language-evidence"), languages, short=short)


def judge_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(row, lang_text, lang_id, posterior, rejected) of each row of ``docs``, which is the struct ``row``.

    The column lang is what a document declares, source its host.  Null and empty texts are rejected.  Two passes over the texts: the first
    writes small rows (host, declaration, evidence) for the priors, the second judges texts where they are.  So no text is
    shuffled or copied, and columns of ``docs`` may have any name.
    """
    spark = docs.sparkSession
    labelled = docs if labelled is None else labelled
    languages, model, short = fit(labelled, languages_of(labelled))
    small = [F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("lang").alias("declared"), text_evidence(spark, model, F.col("text")).alias("ev")]
    found = priors(materialize(docs.select(*small), "document-language-evidence"), languages) if languages else None
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), *small)
    return judge(packed, found, languages, short=short).select("row", "lang_text", "lang_id", "posterior", "rejected")


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with lang_text, lang_id, posterior and rejected, which replace columns of ``docs`` with these names; see ``judge_documents``."""
    new = ["lang_text", "lang_id", "posterior", "rejected"]
    kept = [c for c in docs.columns if c.lower() not in new]
    return judge_documents(docs, labelled).select(*(F.col("row").getField(c).alias(c) for c in kept), *new)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "host", "suffix", "declared", "lang_text", "lang_id", "posterior", "rejected")


QUERIES = {"op7_language_id": op7_language_id}
