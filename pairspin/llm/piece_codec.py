"""SentencePiece encoding and decoding with the place of every piece in the source bytes.

A text is rewritten by the model's compiled character map: at each sign the longest rule that matches is applied (a double-array
walk from all signs at once), white space is treated as the model's options say, and for every byte of the result the source
bytes that it comes from are kept.  Pieces are found on the result by the merges of highest score, for each distinct word of a
block once, and each piece's bytes are then projected to a span of the source.

Plan: one scan of the texts, nothing is shuffled.  Models that are not BPE with byte fallback, or whose pieces go on over
the start of a word, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import quoted, table, tidy
from .pretokens import BatchEncoder, distinct_words, slices

#: The sign that stands for a blank in pieces, and its UTF-8.
MARK, MARK_BYTES = "▁", "▁".encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Signs of a word beyond which its merges are kept in a heap.
LONG_WORD = 100


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin..begin + size - 1 of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


class CharacterMap:
    """Rewriting rules over UTF-8 as a double array (its size in bytes comes first), with the replacements behind it, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4) if size else np.zeros(0, np.uint32)
        self.replacements = np.frombuffer(blob[4 + size :], np.uint8)
        self.ends = np.flatnonzero(self.replacements == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> np.uint32(10)) << ((unit & np.uint32(512)) >> np.uint32(6))

    def longest(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest rule that matches at each of the places ``at``: its size in bytes (0 where none does) and its replacement's place."""
        size, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.units):
            return size, value
        node = np.full(len(at), self._offset(self.units[:1])[0], np.uint32)
        alive, step = np.arange(len(at)), 0
        while len(alive := alive[at[alive] + step < len(data)]):
            sign = data[at[alive] + step].astype(np.uint32)
            node[alive] ^= sign
            known = node[alive] < len(self.units)
            alive, sign = alive[known], sign[known]
            unit = self.units[node[alive]]
            hit = unit & np.uint32(0x800000FF) == sign
            alive, unit = alive[hit], unit[hit]
            node[alive] ^= self._offset(unit)
            leaf = alive[(unit >> np.uint32(8)) & np.uint32(1) == 1]
            step += 1
            size[leaf], value[leaf] = step, self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return size, value

    def rewrite(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the rewritten text, first source byte of each, the one after its last).

        Bytes of signs that no rule touches come from one byte each, those of a replacement from all that it replaces.
        """
        at = np.flatnonzero(data & 0xC0 != 0x80)
        width = np.diff(at, append=len(data))
        size, value = self.longest(data, at)
        # a rule over several signs hides the rules that start within it
        free, covered = np.ones(len(at), bool), 0
        for k in np.flatnonzero(size > width).tolist():
            if at[k] >= covered:
                covered = int(at[k] + size[k])
                free[k + 1 : np.searchsorted(at, covered)] = False
        at, width, size, value = at[free], width[free], size[free], value[free]
        ruled = size > 0
        length = width.copy()
        length[ruled] = self.ends[np.searchsorted(self.ends, value[ruled])] - value[ruled]
        out = np.concatenate([data, self.replacements])[ranges(np.where(ruled, len(data) + value, at), length)]
        first = np.where(np.repeat(ruled, length), np.repeat(at, length), ranges(at, length))
        last = np.where(np.repeat(ruled, length), np.repeat(at + size, length), first + 1)
        return out, first, last


class PieceModel:
    """Pieces, scores and options of a model file (BPE with byte fallback).  Blanks stand for the blank mark everywhere in it."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto.FromString(content)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a plain BPE model with byte fallback")
        spec = m.normalizer_spec
        if not (spec.add_dummy_prefix and spec.escape_whitespaces) or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model doesn't mark the start of words")
        plain = {k: p.piece.replace(MARK, " ") for k, p in enumerate(m.pieces) if p.type == NORMAL}
        if any(" " in p.lstrip(" ") for p in plain.values()):
            raise ValueError("a piece goes on over the start of a word")
        self.collapse = spec.remove_extra_whitespaces
        self.rules = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.ids = {p: k for k, p in plain.items()}
        self.rank = {p: -m.pieces[k].score for k, p in plain.items()}
        self.longest = max(map(len, self.ids), default=1)
        of_byte = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == BYTE}
        self.bytes = [of_byte[b] for b in range(256)]
        back = {k: bytes([b]) for b, k in of_byte.items()}
        #: Bytes of each piece; those of control pieces and the unknown piece are empty here
        self.pieces = [plain[k].encode() if k in plain else back.get(k, b"") for k in range(len(m.pieces))]
        self.sizes = np.array([*map(len, self.pieces)], np.int64)
        self.offset = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.is_byte = np.isin(np.arange(len(self.pieces)), self.bytes)
        self.unknown = next(k for k, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.shown_unknown = m.trainer_spec.unk_surface

    def merge(self, word: str) -> list[int]:
        """Ids of one word: of all neighbours that make a piece, those of highest score first, from the left; signs that are no piece as bytes."""
        signs = [*word]
        if len(signs) > LONG_WORD:
            signs = self._merge_long(signs)
        else:
            rank = self.rank.get
            ranks = [rank(a + b, inf) for a, b in zip(signs, signs[1:])]
            while ranks:
                least = min(ranks)
                if least == inf:
                    break
                k = ranks.index(least)
                signs[k] += signs[k + 1]
                del signs[k + 1], ranks[k]
                if k:
                    ranks[k - 1] = rank(signs[k - 1] + signs[k], inf)
                if k < len(ranks):
                    ranks[k] = rank(signs[k] + signs[k + 1], inf)
        out: list[int] = []
        for s in signs:
            found = self.ids.get(s)
            if found is None:
                out += map(self.bytes.__getitem__, s.encode())
            else:
                out.append(found)
        return out

    def _merge_long(self, signs: list[str]) -> list[str]:
        """The same with a heap over a linked list: n log n for words of any length."""
        n = len(signs)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and len(signs[a]) + len(signs[b]) <= self.longest and (r := self.rank.get(signs[a] + signs[b])) is not None:
                heapq.heappush(heap, (r, a, len(signs[a]), len(signs[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if len(signs[k]) != left or j < 0 or len(signs[j]) != right:
                continue  # one of the two has changed since
            signs[k] += signs[j]
            signs[j] = ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k], k)
            offer(k, after[k])
        return [s for s in signs if s]

    def normalise(self, text: str) -> tuple[str, tuple[np.ndarray, np.ndarray] | None]:
        """(normalised text with blanks for marks, source span of each of its bytes); None for spans that are only moved by the leading mark's byte."""
        if not text:
            return "", None
        if not self.rules and not self.collapse and MARK not in text:
            return " " + text, None
        data = np.frombuffer(text.encode(), np.uint8)
        out, first, last = self.rules.rewrite(data) if self.rules else (data, np.arange(len(data)), np.arange(1, len(data) + 1))
        lead = 0
        if self.collapse:
            blank = out == 0x20
            # the leading mark stands after the blanks that it replaces
            for k in range(len(out)):
                if not blank[k] or first[k] != lead or (k + 1 < len(out) and first[k + 1] == lead):
                    break
                lead = int(last[k])
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            out, first, last = out[keep], first[keep], last[keep]
        out, first, last = np.append(np.uint8(0x20), out), np.append(lead, first), np.append(lead, last)
        at = np.flatnonzero((out[:-2] == MARK_BYTES[0]) & (out[1:-1] == MARK_BYTES[1]) & (out[2:] == MARK_BYTES[2])) if len(out) > 2 else np.zeros(0, np.int64)
        if len(at):
            out, last = out.copy(), last.copy()
            out[at], last[at] = 0x20, last[at + 2]
            keep = np.ones(len(out), bool)
            keep[at + 1] = keep[at + 2] = False
            out, first, last = out[keep], first[keep], last[keep]
        if self.collapse:  # at the end marks of the source go as well
            end = len(out.tobytes().rstrip(b" "))
            out, first, last = out[:end], first[:end], last[:end]
        return out.tobytes().decode(), (first, last)

    def joined(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces, one after another."""
        return self.flat[ranges(self.offset[ids], self.sizes[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the first mark goes, control pieces show nothing, bytes that are no UTF-8 become a replacement sign each."""
        ids = np.asarray(ids, np.int64)
        if not (ids == self.unknown).any():
            found = self.joined(ids)
            lead = ids[self.sizes[ids] > 0][:1]
            if len(lead) and not self.is_byte[lead[0]]:
                found = found.removeprefix(b" ")
            try:
                return found.decode()
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        held = b""
        for k in [*ids.tolist(), -1]:
            if k >= 0 and self.is_byte[k]:
                held += self.pieces[k]
                continue
            out.append(_shown(held))
            held = b""
            if k == self.unknown:
                out.append(self.shown_unknown)
            elif k >= 0:
                piece = self.pieces[k].decode()
                out.append(piece if any(out) else piece.removeprefix(" "))
        return "".join(out)


def _shown(data: bytes) -> str:
    """UTF-8 with one replacement sign for each byte that starts no whole sign."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


class PieceEncoder(BatchEncoder):
    """Texts to ids and source spans; words start at blanks that follow something else."""

    def __init__(self, model: PieceModel, known: int = 500_000):
        super().__init__(lambda words: [*map(model.merge, words)], known=known)
        self.model = model

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        whole = "".join(texts)
        signs = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = signs == 0x20
        at[1:] &= signs[:-1] != 0x20
        at[first[:-1][sizes > 0]] = True
        begin = np.flatnonzero(at)
        end = np.append(begin[1:], len(signs))[: len(begin)]
        return *distinct_words(whole, signs, begin, end), np.searchsorted(begin, first)

    def pieces_of(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text as it is in the source; null counts as empty."""
        return self.encode([self.model.normalise(t or "")[0] for t in texts])

    def placed(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first source byte, the one after the last) of the pieces of each text.

        A piece of the leading mark alone has an empty span.  Bytes of an unchanged sign have one source byte each, those of a
        replacement all that was replaced, so spans never step back, and parts of one replacement share its span.
        """
        ready = [self.model.normalise(t or "") for t in texts]
        out = []
        for ids, (_, origin) in zip(self.encode([t for t, _ in ready]), ready, strict=True):
            end = np.cumsum(self.model.sizes[ids])
            begin = end - self.model.sizes[ids]
            if origin is None:
                begin, end = np.maximum(begin - 1, 0), np.maximum(end - 1, 0)
            else:
                begin, end = origin[0][begin], origin[1][end - 1]
            out.append((ids, begin, end))
        return out


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a model file; kept from task to task in a worker process."""
    with open(path, "rb") as f:
        return PieceEncoder(PieceModel(f.read()))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids, spans (begin and end in the source's UTF-8) and decoded text of every row of ``docs``.

    Null and empty texts give no ids, no spans and an empty text; null and repeated keys are kept as they are, other columns
    aren't read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in slices(batches):
            found = encoder.placed(batch.column(1).to_pylist())
            cuts = np.cumsum([0, *(len(ids) for ids, _, _ in found)]).astype(np.int32)
            ids, begin, end = (np.concatenate([f[k] for f in found]).astype(np.int32) if found else np.zeros(0, np.int32) for k in range(3))
            spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["begin", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(cuts, pa.array(ids)),
                    pa.ListArray.from_arrays(cuts, spans),
                    pa.array([encoder.model.decode(f[0]) for f in found], pa.string()),
                ],
                names=[key, "ids", "spans", "decoded"],
            )
        encoder.forget()
        tidy()

    return keyed(docs, key, text).mapInArrow(run, f"{quoted(key)} {_kind(docs, key)}, ids array<int>, spans array<struct<begin: int, end: int>>, decoded string")


def piece_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode_decode`` with counts and SHA-256 digests in place of ids, spans and texts, made where they are.

    ``spans_sha256`` is of begin and end of each piece as little-endian 32-bit integers.  Nulls, empty and repeated rows as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in slices(batches):
            found = encoder.placed(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids, _, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() for ids, _, _ in found], pa.string()),
                    pa.array([hashlib.sha256(encoder.model.decode(ids).encode()).hexdigest() for ids, _, _ in found], pa.string()),
                    pa.array([hashlib.sha256(np.stack([begin, end], 1).astype("<i4").tobytes()).hexdigest() for _, begin, end in found], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )
        encoder.forget()
        tidy()

    return keyed(docs, key, text).mapInArrow(run, f"{quoted(key)} {_kind(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Two columns under names that Arrow functions take, whatever they are called in ``docs``."""
    return docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))


def _kind(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_piece_codec": op12_piece_codec}
