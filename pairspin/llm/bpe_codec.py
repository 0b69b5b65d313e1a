"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words (pre-tokens) that are frequent in the corpus are compiled, with their ids, into a minimal
acyclic automaton: equal suffixes share states, and each arc carries how many words come before
the words that it leads to, so that a walk sums up to the word's rank and the rank gives its ids.
The automaton is written as plain arrays, and each executor process maps the file into memory.
Every distinct word of a block is looked up there; words outside it are merged exactly, by the merge ranks.  Which words
the lexicon holds changes the speed only, never the ids.

Plan: one pass over the texts counts words (a grouped sum; only the ``lexicon_size`` most frequent
reach the driver), a second encodes and decodes; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, materialize, table, tidy
from .pretokens import BatchEncoder, byte_signs, pieces, slices

#: Words of the lexicon; it is broadcast, so this bounds its size (about 2 MB).
LEXICON_SIZE = 50_000
#: Distinct words that a task counts before it passes on what it has, and signs of a word of the lexicon at most; they change what the lexicon holds, never ids.
COUNTED, LONGEST = 400_000, 64
_NONE = 1 << 60


class Vocabulary:
    """Ids, merge ranks and byte strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        back = {s: b for b, s in signs.items()}
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.first = [vocab[signs[b]] for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in reversed([*enumerate(merges)])}
        self.merged = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if len(added) > 1:
            raise ValueError("more than one added token")
        self.special = next(iter(added.items()), None)
        self.pieces = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for word, k in {**vocab, **added}.items():
            self.pieces[k] = bytes(back[s] for s in word) if all(s in back for s in word) else word.encode()

    def merge(self, word: str) -> list[int]:
        """Ids of one word: of all neighbours that can merge, those of least rank first, from the left."""
        ids = [self.first[b] for b in word.encode()]
        if len(ids) > 100:
            return self._merge_long(ids)
        rank = self.rank.get
        ranks = [rank(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            k = ranks.index(least)
            new = ids[k] = self.merged[ids[k], ids[k + 1]]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], new), _NONE)
            if k < len(ranks):
                ranks[k] = rank((new, ids[k + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for words of any length."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.rank[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = self.merged[a, b], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in self.rank:
                    heapq.heappush(heap, (self.rank[ids[x], ids[y]], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special ones included; broken UTF-8 becomes replacement signs."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: dict[str, Sequence[int]]) -> bytes:
    """The minimal transducer of ``words`` -> ids, as the bytes of an .npz-like plain file.

    States are made in sorted word order; a state whose continuation is complete is replaced by an
    equal one if there is one (same finality, same arcs), so the automaton is minimal at every step.
    """
    entries = sorted((w.encode(), list(ids)) for w, ids in words.items())
    final: list[bool] = [False]
    arcs: list[dict[int, int]] = [{}]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, child) still open

    def close(depth: int) -> None:
        while len(path) > depth:
            state, byte, child = path.pop()
            arcs[state][byte] = known.setdefault((final[child], tuple(arcs[child].items())), child)

    last = b""
    for word, _ in entries:
        same = len(os.path.commonprefix([last, word]))
        close(same)
        state = path[-1][2] if path else 0
        for byte in word[same:]:
            final.append(False)
            arcs.append({})
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    close(0)
    order, number, stack = [0], {0: 0}, [0]
    while stack:
        for child in arcs[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        if state not in below:
            below[state] = final[state] + sum(count(c) for c in arcs[state].values())
        return below[state]

    rows = []
    for state in order:
        skip = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            rows.append((number[state] << 8 | byte, number[child], skip))
            skip += count(child)
    rows.sort()
    columns = [*zip(*rows, strict=True)] or [(), (), ()]
    offset = [0, *accumulate(len(ids) for _, ids in entries)]
    parts = [np.array(x, np.uint32) for x in (*columns, [final[s] for s in order], offset, [x for _, ids in entries for x in ids])]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A mapped transducer file; ``find`` walks it for many words at once."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint32, "r")
        cut = np.concatenate([[6], 6 + np.cumsum(data[:6], dtype=np.int64)])
        self.key, self.to, self.skip, self.final, self.offset, self.flat = (data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))

    @classmethod
    def of(cls, content: bytes) -> Lexicon:
        """Keep the bytes as a file of this process's temporary folder, one a machine, and map it."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(content).hexdigest()[:24]}.bin")
        if not os.path.exists(path):
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
                f.write(content)
            os.replace(f.name, path)
        return cls(path)

    def ranks(self, words: Sequence[str]) -> np.ndarray:
        """The place of each word among the lexicon's in order, -1 for words outside it."""
        if not len(self.key):
            return np.full(len(words), -1, np.int64)
        joined = "".join(words)
        coded = words if joined.isascii() else [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        begin = np.cumsum(size) - size
        text = np.frombuffer(joined.encode(), np.uint8).astype(np.uint32)
        state, rank, alive = np.zeros(len(coded), np.uint32), np.zeros(len(coded), np.int64), np.arange(len(coded))
        missing = np.zeros(len(coded), bool)
        step = 0
        while len(alive := alive[size[alive] > step]):
            want = state[alive] << np.uint32(8) | text[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            missing[alive[~hit]] = True
            alive, at = alive[hit], at[hit]
            state[alive] = self.to[at]
            rank[alive] += self.skip[at]
            step += 1
        return np.where(missing | (self.final[state] == 0), -1, rank)

    def find(self, words: Sequence[str]) -> list[list[int] | None]:
        """Ids of each word, None for words outside the lexicon."""
        return [None if r < 0 else self.flat[self.offset[r] : self.offset[r + 1]].tolist() for r in self.ranks(words).tolist()]


@lru_cache(maxsize=2)
def codec(path: str, lexicon: bytes) -> tuple[Vocabulary, BatchEncoder]:
    """The encoder of a worker process; kept from task to task."""
    v = vocabulary(path)
    return v, BatchEncoder(lambda words: [*map(v.merge, words)], v.special, lexicon=Lexicon.of(lexicon))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): counts of the words that stand twice or more in some task's share of the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = BatchEncoder(lambda words: [[] for _ in words])
        total: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            found = {w: n for w, n in total.items() if n > 1}
            return pa.RecordBatch.from_pydict({"word": [*found], "n": [*found.values()]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for batch in slices(batches):
            for text_block in blocks(batch.column(0).to_pylist()):
                words, which, _ = split.words(text_block)
                for word, times in zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True):
                    if len(word) <= LONGEST:
                        total[word] = total.get(word, 0) + times
                if len(total) > COUNTED:
                    yield rows()
                    total.clear()
        yield rows()
        total.clear()
        tidy()

    return docs.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def blocks(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` signs; long texts are cut where words start."""
    run, n = [], 0
    for text in texts:
        for part in pieces(text or ""):
            run.append(part)
            n += len(part)
            if n >= size:
                yield run
                run, n = [], 0
    if run:
        yield run


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_SIZE, text: str = "text") -> bytes:
    """Transducer of the most frequent words of all texts, ``size`` at most."""
    # eighth-powers of two of the counts: a few hundred steps, of which the highest that hold ``size`` words or fewer are taken
    counts = materialize(count_words(docs, text).withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    cut, room = None, size
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        cut = r.step
    top = counts.where(F.col("step") >= cut).select("word").collect() if cut is not None else []
    discard(counts)
    v = vocabulary(path)
    return compile_lexicon({r.word: v.merge(r.word) for r in top})


def encode_decode(docs: DataFrame, path: str, lexicon: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids (array of int) and decoded text of every row of ``docs``.

    Null and empty texts give no ids and an empty text; null and repeated keys are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encoder = codec(path, shared.value)
        for batch in slices(batches):
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([v.decode(x.tolist()) for x in ids], pa.string())],
                names=[key, "ids", "decoded"],
            )
        encoder.forget()
        tidy()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def codec_digests(docs: DataFrame, path: str, lexicon: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode_decode`` with counts and SHA-256 digests in place of ids and texts, made where they are.

    Null and empty texts have 0 tokens and the digests of nothing; null and repeated keys are kept as they are, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encoder = codec(path, shared.value)
        for batch in slices(batches):
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(v.decode(x.tolist()).encode()).hexdigest() for x in ids]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        encoder.forget()
        tidy()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str, lexicon: bytes, key: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, columns ``keep``, n_tokens, ids, ids_sha256, decoded_equal) of every row, in the order of the rows of ``docs``.

    Null and empty texts have no ids and decode to ''; null and repeated keys stay, and an empty table gives an empty one.
    """
    first = (key, source, *keep)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encoder = codec(path, shared.value)
        for batch in slices(batches):
            texts = batch.column(len(first)).to_pylist()
            ids = encoder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(first))),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32))),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([v.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]),
                ],
                names=[*first, "n_tokens", "ids", "ids_sha256", "decoded_equal"],
            )
        encoder.forget()
        tidy()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in first)
    return docs.select(*first, text).mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>, ids_sha256 string, decoded_equal boolean")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return codec_digests(docs, path, build_lexicon(docs, path))


QUERIES = {"op9_bpe_codec": op9_bpe_codec}
