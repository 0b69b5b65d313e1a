"""SentencePiece codec, cross-tokenizer alignment and spelling variants against the library and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairspin.llm import piece_codec, spelling_variants, token_alignment

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, n int, word string, pair long, chunk long, `a.b` string"
TEXTS = [None, "", " ", "a", "  Hello   world\n\nit's <|endoftext|> <s>fine</s><0x41>", "naïve café — 漢字 ١٢٣ \U0001f600\U0001f9d1‍\U0001f680", "x" * 3000, "a▁b ▁ c", "▁", "tab\tnul\x00end �", "the cat sat on the mat " * 40, "the cat sat on the mat " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", 1, "w", 2, 3, "x") for k, t in enumerate(TEXTS)] + [(3, "a", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def some_texts():
    random.seed(5)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    out = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} \n" for c in points[k : k + 50]) for k in range(0, len(points), 2000)]
    signs = [*"aabeinst  \n\t''1é漢<|!-  ▁\x00", "<s>", "<unk>", "the", "ing"]
    out += ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(3000)]
    out += ["".join(random.choices("etaoin shrdlué漢zq", k=random.randint(1, n))) for n in (40, 400, 4000) for _ in range(40)]
    return out + [t or "" for t in TEXTS]


# ---- 12: pieces


def test_pieces_match_the_library(library):
    texts = some_texts()
    encoder = piece_codec.PieceEncoder(piece_codec.PieceModel(open(PIECES, "rb").read()), known=200)
    got = [x.tolist() for x in encoder.pieces_of(texts)]
    assert got == library.encode(texts)
    assert [encoder.model.decode(np.array(x)) for x in got] == library.decode(got)
    random.seed(6)
    ids = [[random.randrange(encoder.model.sizes.size) if random.random() < 0.7 else random.randrange(3, 259) for _ in range(random.randint(0, 12))] for _ in range(3000)]
    assert [encoder.model.decode(np.array(x, np.int64)) for x in ids] == library.decode(ids)


def test_spans_cover_the_source(library):
    encoder = piece_codec.piece_encoder(PIECES)
    for text in some_texts()[::3]:
        (ids, begin, end), source = encoder.placed([text])[0], text.encode()
        if not text:
            assert not len(ids)
            continue
        assert begin[0] == 0 and end[-1] == len(source) and (begin[1:] == end[:-1]).all()
        for k, b, e in zip(ids.tolist(), begin.tolist(), end.tolist(), strict=True):
            assert encoder.model.pieces[k].endswith(source[b:e].replace(piece_codec.MARK_BYTES, b" "))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
def test_normalisation_matches_the_library(rule, collapse):
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=collapse)
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = piece_codec.PieceModel(open(PIECES, "rb").read())
    m.collapse = collapse
    blob = proto.ModelProto.FromString(n.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    m.rules = piece_codec.CharacterMap(blob) if blob else None
    random.seed(7)
    signs = [*"aZ1  \t　 ﬁＡ①Åȩ́각​▁\x01ß", "が", "  ", "ŉ"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 14))) for _ in range(1000)] + some_texts()[:60]
    for t in texts:
        want, places = n.normalize(t, with_offsets=True)
        got, origin = m.normalise(t)
        assert got == want.replace(piece_codec.MARK, " "), t
        if origin is not None and got:
            first, last = origin
            assert (np.diff(first) >= 0).all() and (np.diff(last) >= 0).all()
            # the library counts signs; a sign of the result starts at the first byte of its own
            size = np.cumsum([0, *(len(c.encode()) for c in got)])[:-1]
            before = [len(t.encode()[:b].decode()) for b in first[size].tolist()]
            assert before == places[: len(before)], t


def test_piece_queries(spark, docs, no_docs, library):
    text = {r.doc_id: r.text for r in docs.collect()}
    got = piece_codec.encode_decode(docs, PIECES).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert r.ids == library.encode(text[r.doc_id] or "") and r.decoded == library.decode(r.ids) and len(r.spans) == len(r.ids)
    for r in piece_codec.piece_digests(docs, PIECES).collect():
        ids = library.encode(text[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_codec.encode_decode(no_docs, PIECES).count() == piece_codec.piece_digests(no_docs, PIECES).count() == 0
    assert piece_codec.piece_digests(docs.select(F.col("doc_id").alias("d.id"), F.col("text").alias("t.x"), F.lit(1).alias("n")), PIECES, "d.id", "t.x").count() == len(TEXTS) + 2


def test_pieces_of_very_long_texts(library):
    random.seed(8)
    words = ["".join(random.choices("etaoinshrdlu", k=random.randint(1, 9))) for _ in range(5000)]
    texts = [" ".join(random.choices(words, k=250_000)), "ab" * 60_000, "".join(random.choices("abc  \n", k=900_000))]
    assert [x.tolist() for x in piece_codec.piece_encoder(PIECES).pieces_of(texts)] == library.encode(texts)


# ---- 11: alignment


def brute_alignment(texts):
    """Documents' figures by walking over tokens, and counting pairs in sets."""
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    signs = {s: b for b, s in __import__("pairspin.llm.pretokens", fromlist=["x"]).byte_signs().items()}
    out, holders = [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib.encode(text) if text else []
        wa = [bytes(signs[c] for c in t.id_to_token(k)) for k in a]
        wb = [bytes([int(p[3:5], 16)]) if lib.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, lib.id_to_piece(k)) for k in b)]
        if not text or b"".join(wa) != (" " + text).encode() or b"".join(wb) != (" " + text).encode():
            out.append((0, 0, [], Counter()))
            continue
        ends_a, ends_b = np.cumsum([*map(len, wa)]).tolist(), np.cumsum([*map(len, wb)]).tolist()
        groups, ga, gb = [], [], []
        i = j = 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            while i < len(a) and ends_a[i] <= cut:
                ga.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
            ga, gb = [], []
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        holders.update(links.keys())
        out.append((len(a), len(b), groups, links))
    most = Counter()
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    rows = []
    for n_a, n_b, groups, links in out:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if n_a else ""
        rows.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in links.items()), digest))
    return rows


def test_alignment(spark, docs, no_docs, sf, monkeypatch):
    got = token_alignment.align_tokens(docs, BPE, PIECES).collect()
    text = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_alignment([t for _, t in text])
    assert Counter(map(tuple, got)) == Counter((k, *w) for (k, _), w in zip(text, want, strict=True))
    assert token_alignment.align_tokens(no_docs, BPE, PIECES).count() == 0
    renamed = token_alignment.align_tokens(docs.select(F.col("doc_id").alias("d.id"), F.col("text").alias("t.x"), F.lit(1).alias("n")), BPE, PIECES, "d.id", "t.x")
    assert Counter(map(tuple, renamed.collect())) == Counter(map(tuple, got))
    monkeypatch.setattr(token_alignment, "CHUNK_SIGNS", 300)  # pairs that several chunks hold
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = [tuple(r) for r in rows.collect()]
    want = brute_alignment([t for _, t in text])
    got = token_alignment.align_tokens(rows.repartition(5), BPE, PIECES).collect()
    assert Counter(map(tuple, got)) == Counter((k, *w) for (k, _), w in zip(text, want, strict=True))


def test_wide_groups_of_random_tokens():
    random.seed(9)
    for _ in range(200):
        sizes_a, sizes_b = np.array([random.randint(1, 5) for _ in range(6)]), np.array([random.randint(1, 5) for _ in range(6)])
        ids_a, ids_b = [], []
        for n in (0, 3, random.randint(20, 60)):
            for ids, sizes in ((ids_a, sizes_a), (ids_b, sizes_b)):
                own, left = [], n
                while left > 0:
                    fit = [k for k in range(6) if sizes[k] <= left] or [None]
                    k = random.choice(fit)
                    if k is None:
                        own, left = [], n
                        sizes[0] = 1
                        continue
                    own.append(k)
                    left -= sizes[k]
                ids.append(np.array(own, np.uint32))
        if any(sizes_a[x].sum() != sizes_b[y].sum() for x, y in zip(ids_a, ids_b, strict=True)):
            continue
        a, b, ga, gb, groups, *_ = token_alignment.align(ids_a, ids_b, sizes_a, sizes_b)
        want = Counter()
        for d in range(3):
            for g in range(groups[d], groups[d + 1]):
                want.update((d, int(x), int(y)) for x in a[ga == g] for y in b[gb == g])
        for limit in (0, 4, 1000):
            token_alignment.WIDE_GROUP, old = limit, token_alignment.WIDE_GROUP
            got = {k: n for *k, n in zip(*(x.tolist() for x in token_alignment.link_counts(a, b, ga, gb, groups)), strict=True) for k in [tuple(k)]}
            token_alignment.WIDE_GROUP = old
            assert got == want


# ---- 13: spelling variants


def brute_variants(rows):
    """Words counted by the letter of the rule, and near words by trying every edit."""
    import re

    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out = {}
    for w, k in n.items():
        near = {w[:p] + w[p + 1 :] for p in range(len(w))} | {w[:p] + c + w[p:] for p in range(len(w) + 1) for c in letters} | {w[:p] + c + w[p + 1 :] for p in range(len(w)) for c in letters}
        near = [x for x in near if x in n and x != w]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * k else None
        out[w] = [form, w, k, len(near), n[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return sorted((w, *row) for w, row in out.items())


def shown(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("long_word", [7, 100])
def test_spelling_variants(spark, docs, no_docs, sf, monkeypatch, long_word):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = shown(spelling_variants.spelling_variants(rows))
    assert got == brute_variants([tuple(r) for r in rows.collect()]) and any(g[1] for g in got)
    # words of few letters in every order, doubled letters, chains of forms, ties, null keys and texts, and a very long word
    random.seed(10)
    words = ["".join(random.choices("abé", k=random.randint(7, 9))) for _ in range(400)]
    chain = ["abcdefgh"] * 2000 + ["abcdefg"] * 100 + ["abcdefgx", "abcdefx"] * 3 + ["zzzzzzzzz", "zzzzzzzz"] * 40 + ["Straßenbahn", "STRAßENBAHN", "÷×÷×÷×÷"] * 5
    texts = [(k, " ".join(random.choices(words, k=30)), "x") for k in range(80)] + [(k % 7, w, "y") for k, w in enumerate(chain)]
    texts += [(None, "nothing here nothing", "z"), (1, None, None), (2, "", None), (3, "ab" * 50_000, "w"), (4, "ab" * 50_000 + " " + "ab" * 49_999 + "b", "w"), (3, "ab" * 50_000, "w")]
    df = spark.createDataFrame(texts, "doc_id long, text string, word string").repartition(4)
    monkeypatch.setattr(spelling_variants, "ROWS", 100)
    monkeypatch.setattr(spelling_variants, "LONG_WORD", long_word)
    got = shown(spelling_variants.spelling_variants(df))
    want = brute_variants([(k, t) for k, t, _ in texts if len(t or "") < 50_000])
    assert [g for g in got if len(g[0]) < 50_000] == want and any(w[1] and w[2] != w[1] for w in want)
    assert {len(g[0]) for g in got if len(g[0]) >= 50_000} <= {99_999, 100_000}
    assert shown(spelling_variants.spelling_variants(no_docs)) == shown(spelling_variants.spelling_variants(docs.where("text is null"))) == []
    assert shown(spelling_variants.spelling_variants(df.select(F.col("doc_id").alias("d.id"), F.col("text").alias("t.x"), F.lit(1).alias("n")), "d.id", "t.x")) == got


def test_stored_chunks_are_packed_and_few_in_a_file(spark, monkeypatch):
    """What a reader of stored chunks holds at once doesn't grow with the table."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from pairspin.llm import token_alignment

    monkeypatch.setattr(token_alignment, "CHUNK_ROWS", 1)
    monkeypatch.setattr(token_alignment, "FILE_CHUNKS", 2)
    stored, write = {}, token_alignment.materialize
    monkeypatch.setattr(token_alignment, "materialize", lambda df, name, **o: stored.setdefault(name, write(df, name, **o)))
    docs = spark.createDataFrame([(k, f"some words and {k} more") for k in range(7)], "doc_id long, text string").coalesce(1)
    got = token_alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.count() == 7 and got.where("n_links = 0 or count_sum < n_links").count() == 0
    store = stored["aligned-chunks"]
    assert {store.schema[c].dataType.simpleString() for c in ("ends", "which", "times")} == {"binary"}
    assert max(r["count"] for r in store.groupBy(F.input_file_name()).count().collect()) <= 2
