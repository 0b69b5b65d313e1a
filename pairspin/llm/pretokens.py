"""Pre-tokens of a byte-level BPE, found for a block of texts at once with array operations.

The split is that of the usual pattern (contractions; letters, numbers or other signs with
one leading space; white space, its last sign left to what follows).  ``BatchEncoder`` maps each distinct
pre-token of a block once to its ids, by way of a lexicon, a bounded memory of known pre-tokens and a
function for unknown ones, and lays the ids out in text order.  Hashes only propose which pre-tokens of a block
are equal; spellings decide, so no clash of hashes can change an id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Signs of a block; the arrays of a block take about 80 bytes a sign.
BLOCK = 400_000
#: A blank between plain letters or digits and a letter starts a pre-token whatever stands around it, so long texts may be cut there.
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_RI = pow(_R, -1, 1 << 64)


@lru_cache(maxsize=1)
def sign_classes() -> np.ndarray:
    """Class of each code point, by the Unicode tables of the regex library."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for a in range(0, 0x110000, 0x800):
        if a != 0xD800:  # surrogates are in no text
            text = "".join(map(chr, range(a, a + 0x800)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, text):
                    out[a + m.start() : a + m.end()] = kind
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(r: int) -> np.ndarray:
        p = np.full(n, r, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return of(_R), of(_RI)


def starts(signs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets at which pre-tokens start.  ``first``: offsets of the texts' first signs (of texts with signs)."""
    n = len(signs)
    kind = sign_classes()[signs]
    at = np.ones(n, bool)
    at[1:] = kind[1:] != kind[:-1]
    new = np.zeros(n + 3, bool)
    new[first] = True
    new[n:] = True
    at |= new[:n]
    # white space before something else: its last sign stands alone, or leads what follows if it is a blank
    i = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~new[1:n]) + 1
    at[i - 1] = True
    at[i] = signs[i - 1] != 0x20
    # contractions, where an apostrophe starts a pre-token
    i = np.flatnonzero((signs == 0x27) & at & ~new[1 : n + 1])
    padded = np.append(signs, (0, 0, 0)).astype(np.uint32)
    a, b = padded[i + 1], padded[i + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ~new[i + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    at[i[one | two] + 1] = False
    for end in (i[one] + 2, i[two] + 3):
        at[end[end < n]] = True
    return np.flatnonzero(at)


def word_keys(signs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each sign range.  Different ranges may share one, some by construction."""
    p, q = _powers(1 << max(10, int(len(signs)).bit_length()))
    v = (signs.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    total = np.zeros(len(signs) + 1, np.uint64)
    np.cumsum(v * p[: len(v)], out=total[1:])
    h = (total[end] - total[begin]) * q[begin]
    h ^= (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xE7037ED1A0B428DB)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts and ids are held as Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of appearance, the place of each one's first, and each key's number; by hashing, which is faster than sorting."""
    which, distinct = pd.factorize(keys)
    where = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)) if len(which) else which
    return distinct, where, which


def distinct_words(whole: str, signs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct ranges of a text that the ranges cover without gaps, and the number of each range's."""
    if not len(begin):
        return [], np.zeros(0, np.int64)
    _, where, which = distinct_keys(word_keys(signs, begin, end))
    words = [whole[b:e] for b, e in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
    # each range is compared with the first one of its hash
    first, size = where[which], end - begin
    longer = size != size[first]
    first = np.where(longer, np.arange(len(begin)), first)
    differs = signs != signs[np.arange(len(signs)) + np.repeat(begin[first] - begin, size)]
    if longer.any() or differs.any():
        number = {w: k for k, w in enumerate(words)}
        for k in np.flatnonzero(longer | (np.add.reduceat(differs.astype(np.int64), begin) > 0)).tolist():
            which[k] = number.setdefault(whole[begin[k] : end[k]], len(number))
        words = [*number]
    return words, which


def pieces(text: str) -> Iterator[str]:
    """A text in parts of ``BLOCK`` signs or little more, cut where pre-tokens start; in one part where there is no such place."""
    at = 0
    while len(text) - at > 2 * BLOCK and (cut := _CUT.search(text, at + BLOCK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class BatchEncoder:
    """Texts to ids.  ``resolve``: list of distinct pre-tokens -> list of id lists.

    ``special``: a string taken as one id wherever it stands in a text, as ``(string, id)``, or None.
    ``lexicon``: has ``ranks`` of pre-tokens (-1 for ones it lacks), ``offset`` and ``flat`` for the ids of a rank; asked first.
    ``known``: other pre-tokens kept in memory at most; beyond that all but those of the present block are forgotten.
    """

    def __init__(self, resolve: Callable[[list[str]], Sequence[Sequence[int]]], special: tuple[str, int] | None = None, known: int = 500_000, lexicon=None):
        self.resolve, self.special, self.limit, self.lexicon = resolve, special, known, lexicon
        self._clear()

    def forget(self) -> None:
        """Drop all known pre-tokens."""
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.n_ids = 0

    def _keep(self, words: list[str]) -> None:
        """Forget all pre-tokens but these."""
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        begin, sizes = self.offset[slots], self.offset[slots + 1] - self.offset[slots]
        ids = self.ids[_ranges(begin, sizes)]
        self._clear()
        self._add(words, ids, sizes)

    def _learn(self, words: list[str]) -> None:
        found = self.resolve(words)
        self._add(words, np.array([*chain.from_iterable(found)], np.uint32), np.array([*map(len, found)], np.int64))

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        k = len(self.slot)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(words) + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.offset[k + 1 : k + 1 + len(words)] = self.n_ids + np.cumsum(sizes)
        self.n_ids += len(flat)
        self.slot.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; null counts as empty."""
        found: list[list[np.ndarray]] = []
        block: list[str] = []
        places: list[tuple[list[np.ndarray], int]] = []
        size = 0

        def settle() -> None:
            for (ids, k), x in zip(places, self._block(block), strict=True):
                ids[k] = x
            block.clear()
            places.clear()

        for text in texts:
            own: list[np.ndarray] = []
            found.append(own)
            for k, between in enumerate((text or "").split(self.special[0]) if self.special else [text or ""]):
                if k:
                    own.append(np.array([self.special[1]], np.uint32))
                for part in pieces(between):
                    if size and size + len(part) > BLOCK:
                        settle()
                        size = 0
                    block.append(part)
                    places.append((own, len(own)))
                    own.append(np.zeros(0, np.uint32))
                    size += len(part)
        settle()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct pre-tokens of all texts, the number of each pre-token's, first pre-token of each text and the number of all)."""
        whole = "".join(texts)
        signs = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(sizes)])
        begin = starts(signs, first[:-1][sizes > 0]) if len(signs) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(signs))[: len(begin)]
        return *distinct_words(whole, signs, begin, end), np.searchsorted(begin, first)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin and number of those of each word)."""
        begin, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        rest, outside = words, np.arange(len(words))
        flat = np.zeros(0, np.uint32)
        if self.lexicon is not None:
            rank = self.lexicon.ranks(words)
            flat = self.lexicon.flat
            hit = rank >= 0
            begin[hit] = self.lexicon.offset[rank[hit]]
            sizes[hit] = self.lexicon.offset[rank[hit] + 1] - begin[hit]
            outside = np.flatnonzero(~hit)
            rest = [words[k] for k in outside.tolist()]
        slots = np.array([*map(self.slot.get, rest, repeat(-1))], np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(self.slot) + len(missing) > self.limit:
            held = np.flatnonzero(slots >= 0)
            self._keep([rest[k] for k in held.tolist()])
            slots[held] = np.arange(len(held))
        for part in np.array_split(missing, -(-len(missing) // 10_000)) if len(missing) else ():
            slots[part] = len(self.slot) + np.arange(len(part))
            self._learn([rest[k] for k in part.tolist()])
        begin[outside] = len(flat) + self.offset[slots]
        sizes[outside] = self.offset[slots + 1] - self.offset[slots]
        return np.concatenate([flat, self.ids[: self.n_ids]]), begin, sizes

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        words, which, bounds = self.words(texts)
        flat, begin, sizes = self._ids_of(words)
        begin, sizes = begin[which], sizes[which]
        ids = flat[_ranges(begin, sizes)]
        cut = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin..begin + size - 1 of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def byte_signs() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def library_encoder(path: str, special: bool = True) -> BatchEncoder:
    """Encoder whose unknown pre-tokens go to the tokenizers library, for a byte-level BPE file."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec["added_tokens"]
    if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] or len(added) > 1:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    model = Tokenizer.from_file(path).model
    signs = byte_signs()

    def resolve(words: list[str]) -> list[list[int]]:
        # the library's model on one pre-token each, in the byte alphabet that it is written in
        # (byte 255 is in no UTF-8 text, so it can part them)
        joined = b"\xff".join(map(str.encode, words)).decode("latin-1").translate(signs)
        return [[t.id for t in found] for found in map(model.tokenize, joined.split(signs[255]))]

    mark = (added[0]["content"], added[0]["id"]) if special and added else None
    return BatchEncoder(resolve, mark)
