"""Spelling variants of a corpus's words by anagram hashing.

A word's key is the sum of a power of each of its letters, so it doesn't depend on their order.  Two words that differ by one letter have
keys that differ by that letter's value, or by the difference of two letters' values where one is exchanged.  Each word is therefore listed under its own key and,
for each distinct letter, under the key without it: words that share a listed key are candidates, and the order of letters decides.

So that words with the same letters in any order don't crowd one key, a listing also carries a half of the word: of two near words,
without the letter in question, both halves are equal, so the half away from that letter is told by a hash.  Within a key and half, words
are told apart by what is left without the letter at its place, in one pass over them: no pairs are made, and a word leaves with how
many are near it there and the most frequent one.

Plan: runs are counted with partial sums in the scan, words are listed (twice a distinct letter at most), listings are sorted by key
and half, and the parts of each word are summed.  Chains of forms are followed by doubling: frequency grows tenfold with each form, so there are few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, materialize, quoted, table, tidy
from .pretokens import word_keys

#: First and last letters of the two ranges of letters; the first of the alphabet is numbered 1.
RANGES = ((0x61, 0x7A), (0xC0, 0xFF))
#: Letters are valued by this power of their number: the sum for a word of a thousand million letters is still a long.
POWER = 5
#: Letters of a word at least, occurrences of a word at least, and how many times as frequent a word's form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Letters of a word beyond which hashes stand for what is left of it, and their base.
LONG_WORD, _BASE = 100, 0x9E3779B97F4A7C15
#: Rows whose listings a task holds at once.
ROWS = 4_096
LISTED = "key long, half long, mark int, word string, n long"
NEAR = "word string, near long, best_n long, best string"


def _values() -> np.ndarray:
    out = np.zeros(256, np.int64)
    letters = np.concatenate([np.arange(a, b + 1) for a, b in RANGES])
    out[letters] = np.arange(1, len(letters) + 1) ** POWER
    return out


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    Words are runs of letters, of which A to Z are lower-cased.  Where 31 divides the CRC of ``<key>:<run>``, one letter is taken out of the run.  A null text has none, a null key counts as ''.
    """
    letters = "".join(f"{chr(a)}-{chr(b)}" for a, b in RANGES)
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate(F.col(quoted(text)), upper, upper.lower())
    # a run of letters that is long enough is matched as a whole
    runs = docs.select(
        F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[{letters}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.expr("cast(h % char_length(run) as int)")
    shorter = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    words = runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def listings(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, key, half, mark) of all listings of some words.

    Mark is 0 for the word itself and the letter for a key without it, times 2, plus 1 where the half before the letter is hidden, not the one after.
    """
    signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    begin = end - size
    value = _values()[signs]
    total = np.concatenate([[0], np.cumsum(value)])
    key = total[end] - total[begin]
    owner = np.repeat(np.arange(len(words)), size)
    # the half of what is left without one letter
    middle = (size - 1) // 2
    early = np.arange(len(signs)) - begin[owner] < middle[owner]
    found = np.unique((owner << 10) | (signs.astype(np.int64) << 1) | early)
    who, mark = found >> 10, found & 1023
    early = (mark & 1).astype(bool)
    half = word_keys(signs, np.where(early, begin[who] + middle[who] + 1, begin[who]), np.where(early, end[who], begin[who] + middle[who]))
    own = np.arange(len(words))
    cut = begin + size // 2
    return (
        np.concatenate([who, own, own]),
        np.concatenate([key[who] - _values()[mark >> 1], key, key]),
        np.concatenate([half, word_keys(signs, begin, cut), word_keys(signs, cut, end)]).view(np.int64),
        np.concatenate([mark, np.zeros(len(words), np.int64), np.ones(len(words), np.int64)]),
    )


def rest_hashes(word: str) -> tuple[np.ndarray, int]:
    """(hash of the word without the letter at each place, hash of the whole word), in time linear in its letters."""
    with np.errstate(over="ignore"):
        v = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        power = np.full(len(v), _BASE, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        here = np.concatenate([[np.uint64(0)], np.cumsum(v * power)])
        moved = np.append(np.uint64(0), np.cumsum(v[1:] * power[:-1]))  # the letters from 1 on, one place further left
        later = moved[-1] - moved
        return here[:-1] + later, int(here[-1])


def near_in_group(rows: list[tuple[int, str, int]], out: dict[str, list]) -> None:
    """Add to ``out`` the near words, and the best of them, of each word among the listings (mark, word, n) of a group.

    What is left of a long word is told by a hash first, and spelled out only where another word has the same.
    """
    left: dict[tuple, list[tuple[int, str, int]]] = {}
    whole: dict[tuple, list[tuple[int, str, int]]] = {}
    for mark, word, n in rows:
        if mark < 2:
            continue
        letter, early, middle = chr(mark >> 1), mark & 1, (len(word) - 1) // 2
        hashes = rest_hashes(word)[0].tolist() if len(word) - 1 > LONG_WORD else None
        at = word.find(letter, 0 if early else middle)
        while at >= 0 and (not early or at < middle):
            rest = hashes[at] if hashes else word[:at] + word[at + 1 :]
            left.setdefault((early, at, rest), []).append((-n, word, at))
            # of a letter that is doubled, the first one counts as the one left out
            if not at or word[at - 1] != letter:
                whole.setdefault((early, rest), []).append((-n, word, at))
            at = word.find(letter, at + 1)
    for (_, _, rest), found in left.items():
        if len(found) > 1:
            for exchanged in _spelled(found) if isinstance(rest, int) else [found]:
                best = sorted(exchanged)[:2]
                for _, word, _ in exchanged if len(exchanged) > 1 else ():
                    _add(out, word, len(exchanged) - 1, best[word == best[0][1]][:2])
    for mark, word, n in rows:
        if mark > 1:
            continue
        is_long = len(word) > LONG_WORD
        longer = whole.get((mark, rest_hashes(word)[1] if is_long else word), [])
        if is_long:
            longer = [x for x in longer if x[1][: x[2]] + x[1][x[2] + 1 :] == word]
        if longer:
            _add(out, word, len(longer), min(longer)[:2])
        for _, other, _ in longer:
            _add(out, other, 1, (-n, word))


def _spelled(found: list[tuple[int, str, int]]) -> list[list[tuple[int, str, int]]]:
    """Words of one hash by what is really left of them."""
    by: dict[str, list[tuple[int, str, int]]] = {}
    for x in found:
        by.setdefault(x[1][: x[2]] + x[1][x[2] + 1 :], []).append(x)
    return [*by.values()]


def _add(out: dict[str, list], word: str, near: int, best: tuple[int, str]) -> None:
    found = out.setdefault(word, [0, best])
    found[0] += near
    found[1] = min(found[1], best)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the most frequent, of ties the first in code-point order."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                who, key, half, mark = listings(part.column(0).to_pylist())
                own = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(half), pa.array(mark.astype(np.int32)), own.column(0), own.column(1)], names=["key", "half", "mark", "word", "n"])
        tidy()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                t = pa.Table.from_batches([batch])
                held = t if held is None else pa.concat_tables([held, t])
            if held is None or not len(held):
                continue
            key, half = (held.column(c).to_numpy() for c in (0, 1))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (half[1:] != half[:-1])) + 1
            whole = len(held) if batch is None else int(cut[-1]) if len(cut) else 0
            if not whole:
                continue
            sizes = np.diff(np.concatenate([[0], cut[cut < whole], [whole]]))
            shared = held.slice(0, whole).filter(pa.array(np.repeat(sizes > 1, sizes)))
            held = held.slice(whole)
            rows = [*zip(*(shared.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            out: dict[str, list] = {}
            ends = np.cumsum(sizes[sizes > 1]).tolist()
            for a, b in zip([0, *ends], ends, strict=False):
                near_in_group(rows[a:b], out)
            found = [*out.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*out], pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([-f[1][0] for f in found], pa.int64()), pa.array([f[1][1] for f in found], pa.string())],
                names=["word", "near", "best_n", "best"],
            )
        tidy()

    candidates = words.select("word", "n").mapInArrow(listed, LISTED).repartition("key", "half").sortWithinPartitions("key", "half")
    parts = candidates.mapInArrow(told, NEAR).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    return parts.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of each chain of forms.  Each round goes twice as far; chains must have no cycle."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step
        if not now.where("moved").take(1):
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``, see ``count_words``.

    A word's form is the most frequent word that differs from it by one inserted, deleted or replaced letter, if that is ten times as
    frequent, else null; its root is the last of the chain of forms, or itself.  Null texts have no words, rows that repeat count
    again, empty tables give an empty one, and columns other than ``key`` and ``text`` aren't read.
    """
    words = materialize(count_words(docs, key, text), "words")
    near = near_words(words)
    likely = F.col("best_n") >= F.col("n") * TIMES
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best")).alias("form"), F.when(likely, F.col("best_n")).alias("form_n")
    )
    known = materialize(known, "near-words")
    discard(words)
    found = roots(known.where("form is not null"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
