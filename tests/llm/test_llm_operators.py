"""The operators on small tables with nulls, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairspin.llm import adaptive_ann, bpe_codec, cap_join, digest_cache, language_id, mixing, ngram_join, pretokens, token_files, tool_calls, warc_fixity
from pairspin.llm._shared import components, scratch
from pairspin.llm.prefix_tree import Forest, join_sets
from pairspin.llm.shingles import shingle_sets

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mult int, node string, ids string, digest string, shingle int"
TEXTS = [None, "", " ", "a", "Hello  world\n\nit's <|endoftext|>fine", "naïve café — 漢字 ١٢٣ \U0001f600", "x" * 3000, "lone 'll 've\tTab  ", "the cat sat on the mat " * 40, "the cat sat on the mat " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 0, 1, "n", "i", "d", 2) for k, t in enumerate(TEXTS)]
    rows += [(3, "a", "en", "s", 0, 1, "n", "i", "d", 2), (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# ---- shared


def test_components(spark):
    random.seed(4)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(900, k) for k in range(1000, 1200)] + [(k, k + 1) for k in range(2000, 2040)]
    f = Forest(3000)
    for a, b in pairs:
        f.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got.get(k, k) == f.find(k) for p in pairs for k in p)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 9, 10, 1: tokens


def test_pretokens_match_the_library(library):
    encode = pretokens.library_encoder(BPE).encode
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} \n" for c in points[k : k + 50]) for k in range(0, len(points), 2000)]
    random.seed(1)
    signs = [*"aab  \n\t'''sstmdrevlL1²é漢<|!-  ", "<|endoftext|>", "'re", "'ll", "'ve", " '"]
    texts += ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(4000)] + TEXTS
    assert [x.tolist() for x in encode(texts)] == [ids_of(library, t) for t in texts]


def test_own_merges_match_the_library(library):
    v = bpe_codec.vocabulary(BPE)
    random.seed(2)
    words = ["".join(random.choices("etaoin shrdlué漢zq", k=random.randint(1, n))) for n in (4, 12, 40, 400) for _ in range(150)] + ["a" * 5000]
    encoder = pretokens.BatchEncoder(lambda ws: [v.merge(w) for w in ws], v.special, known=50)
    assert [x.tolist() for x in encoder.encode(words)] == [ids_of(library, w) for w in words]


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate(["tap", "taps", "top", "tops", " a", " an", "é", "x"])}
    lexicon = bpe_codec.Lexicon.of(bpe_codec.compile_lexicon(words))
    assert lexicon.find([*words, "ta", "tapss", "", "zz"]) == [*words.values(), None, None, None, None]
    # tap/taps and top/tops share their suffixes: 8 states without the root hold all
    assert len(lexicon.final) <= 9
    assert bpe_codec.Lexicon.of(bpe_codec.compile_lexicon({})).find(["a"]) == [None]


def test_codec(spark, docs, no_docs, library):
    lexicon = bpe_codec.build_lexicon(docs, BPE)
    got = bpe_codec.encode_decode(docs, BPE, lexicon).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert r.ids == ids_of(library, text[r.doc_id])
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == (text[r.doc_id] or "")
    assert bpe_codec.codec_digests(no_docs, BPE, bpe_codec.build_lexicon(no_docs, BPE)).count() == 0
    assert bpe_codec.vocabulary(BPE).decode([94, 26]) == library.decode([94, 26], skip_special_tokens=False)


def test_counts_and_cache(spark, docs, no_docs, library):
    cache = scratch(spark, "cache")
    for again in (False, True):
        got = sorted(digest_cache.cached_counts(docs, BPE, cache).collect(), key=str)
        assert [tuple(r) for r in got] == sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in docs.collect()), key=str)
        stored = spark.read.parquet(cache)
        # each distinct content, and nothing new the second time (a row that repeats its key may be encoded twice)
        assert stored.select("digest").distinct().count() == len({t or "" for t in TEXTS} | {"no id"})
        assert stored.count() - 1 <= len({t or "" for t in TEXTS} | {"no id"}), again
    assert digest_cache.cached_counts(no_docs, BPE, cache).count() == 0
    model = public_tokenizers.path("piece_bpe_32k.model")
    digest_cache.cached_counts(docs, model, cache).collect()
    assert {r.tokenizer.split(":")[0] for r in spark.read.parquet(cache).select("tokenizer").distinct().collect()} == {"tokenizers", "sentencepiece"}
    word = public_tokenizers.path("word_bpe_49k.json")
    assert digest_cache.count_tokens(word, ["Hello world"]) == [len(Tokenizer.from_file(word).encode("Hello world", add_special_tokens=False).ids)]


def test_token_files(spark, docs, no_docs, library):
    folder = scratch(spark, "tokens")
    manifest = token_files.write_shards(docs, BPE, folder, shards=3)
    got = [tuple(r) for r in token_files.read_shards(manifest, folder).collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for k, t in rows:
        ids = np.array([*ids_of(library, t), 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    # one document, by its offset alone
    found = [token_files.ShardReader(folder, r.path).document(4) for r in manifest.collect()]
    assert [x.tolist() for x in found if x is not None] == [[*ids_of(library, TEXTS[4]), 2]]
    empty = scratch(spark, "tokens")
    assert token_files.read_shards(token_files.write_shards(no_docs, BPE, empty), empty).count() == 0
    path = manifest.first().path.removeprefix("file:")
    raw = bytearray(open(path, "rb").read())
    raw[-40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        token_files.ShardReader(folder, path)


# ---- 2: mixing


def test_pfair_windows():
    for shares in ({"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 1, "c": 1, "d": 4}, dict.fromkeys("abcdefg", 1)):
        slots, period = mixing.pfair_period(shares), sum(shares.values())
        assert sorted(x for s in slots.values() for x in s) == list(range(period))
        for s, n in shares.items():
            for k, slot in enumerate(slots[s]):
                assert k * period // n <= slot < -(-(k + 1) * period // n)
            for t in range(period + 1):
                assert abs(sum(x < t for x in slots[s]) - t * n / period) < 1


def test_mixing(spark, docs, no_docs):
    rows = [(k, "t", None, "a" if k % 3 else "b" if k % 2 else None, 0, 0, "", "", "", 0) for k in range(300)] + [(5, "t", None, "a", 0, 0, "", "", "", 0)] * 3
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d, {"a": 2, "b": 1, "*": 1, "unused": 9}, 4)
    r = got.collect()
    assert len(r) == 303 and len({(x.mix_slot, x.mix_pos) for x in r}) == 303
    assert all(x.mix_release <= x.mix_slot < x.mix_deadline for x in r)
    mixed = [x for x in r if x.mix_mixed]
    n = max(x.mix_slot for x in mixed) + 1
    for name, share in (("a", 0.5), ("b", 0.25), ("*", 0.25)):
        assert abs(len({x.mix_slot for x in mixed if x.mix_group == name}) - share * n) < 1
    assert mixing.mix(no_docs, {"a": 1}).count() == 0
    assert mixing.mixed_order(d, {"a": 2}).columns == d.columns
    with pytest.raises(ValueError):
        mixing.mix(d, {"a": 0})


# ---- 3, 5: vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int, mult int, u int, rank int")


ODD = [(90, None), (91, []), (92, [0.0] * 8), (93, [float("nan")] + [1.0] * 7), (94, [None] + [1.0] * 7), (95, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (96, [1.0, 2.0])]


@pytest.mark.parametrize("cell", [3, 1000])
def test_cap_join(spark, monkeypatch, cell):
    monkeypatch.setattr(cap_join, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 8))
    x = np.concatenate([base, base[:6] + 0.05 * rng.standard_normal((6, 8)), base[:4] * 3, base[[0] * 5] + 0.3 * rng.standard_normal((5, 8))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(40 + k, x[1].tolist()) for k in range(6)] + [(3, x[3].tolist())]
    ids, vs = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    f = Forest(100)
    for a, b in zip(*np.nonzero(linked), strict=True):
        f.join(ids[a], ids[b])
    want = [(k, int(n), f.find(k), f.find(k) == k) for k, n in zip(ids, linked.sum(1), strict=True)]
    want += [(k, 0, k, True) for k, _ in ODD]
    got = cap_join.near_duplicates(vectors(spark, [(k, v, 0, 0, 0, 0, 0) for k, v in [*rows, *ODD]])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_cap_join_empty(spark):
    assert cap_join.near_duplicates(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("dim, n", [(2, 2000), (3, 1_000_000), (8, 2000), (8, 1_000_000), (16, 1_000_000), (64, 10_000), (64, 1_000_000), (64, 100_000_000)])
def test_cap_filters_find_what_is_near(dim, n):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z
    a, b = ([r for s in np.array_split(v, 10) for r in cap_join.filter_lists(s, n, 0.95).to_pylist()] for v in (x, y))
    assert np.mean([not set(p) & set(q) for p, q in zip(a, b, strict=True)]) <= 0.001


@pytest.mark.parametrize("dim, n", [(1, 5), (3, 1000), (64, 10_000), (12, 10**9)])
def test_cap_filters_are_all_above_the_height(dim, n):
    x = np.random.default_rng(1).standard_normal((50, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = cap_join.ProductCode(dim, n, 0.95, 0)
    row, number = code.decode(x)
    scores = np.zeros((len(x), 1))
    for a, b, w in zip(code.cuts[:-1], code.cuts[1:], code.words, strict=True):
        if code.m ** len(code.words) > 3_000_000:
            # too many to look at all: the scores of those listed, and the least number of them
            break
        scores = (scores[:, :, None] + ((x @ code.rotation)[:, a:b] @ w.T)[:, None, :]).reshape(len(x), -1)
    else:
        least = -np.sort(-scores, axis=1)[:, min(code.least, scores.shape[1]) - 1]
        want = scores >= np.minimum(code.height, least)[:, None] - 1e-12
        got = np.zeros_like(want)
        got[row, number] = True
        assert (got == want).all()
    assert (np.bincount(row, minlength=50) >= min(code.least, code.m ** len(code.words))).all()


def test_cap_lists_are_padded():
    lists = pa.array([[1, 5], [], [2, 3, 9]], pa.list_(pa.int64()))
    assert cap_join.padded(lists).tolist() == [[1, 5, -1], [-1, -1, -1], [2, 3, 9]]
    assert cap_join.padded(lists.slice(1)).tolist() == [[-1, -1, -1], [2, 3, 9]]


def test_ann_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[100:130] = x[7]  # ties
    rows = [(k, v.tolist(), 0, 0, 0, 0, 0) for k, v in enumerate(x)] + [(k + 5000 if k is not None else None, v, 0, 0, 0, 0, 0) for k, v in ODD]
    t = vectors(spark, rows)
    got = adaptive_ann.search(t, t.where("vec_id % 20 = 0"), 20).collect()
    s = x.astype(np.float64) @ x.astype(np.float64).T
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - s[r.query_id, r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    hits = 0
    for q in range(0, 3000, 20):
        row = s[q].copy()
        row[q] = -np.inf
        hits += len(set(found[q]) & set(np.lexsort((np.arange(3000), -row.round(10)))[:20].tolist()))
        assert len(found[q]) == 20
    assert hits / (150 * 20) >= 0.9


@pytest.mark.parametrize("dim", [1, 2, 3, 24])
@pytest.mark.parametrize("factor", [1.0, 1e-30, 1e19, 1e150])
def test_ann_of_any_dimension_and_scale(spark, dim, factor):
    """One to three coordinates, and numbers whose squares are beyond single precision."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((700, dim)) * factor
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = adaptive_ann.search(rows, rows.where("vec_id % 20 = 0"), 20).collect()
    hits = 0
    for q in range(0, 700, 20):
        score = x @ x[q]
        want = sorted((k for k in range(700) if k != q), key=lambda k: (-score[k], k))[:20]
        mine = {r.vec_id: r.score for r in got if r.query_id == q}
        assert len(mine) == 20 and np.allclose([mine[k] for k in mine], [score[k] for k in mine], rtol=1e-12, atol=0)
        hits += len(mine.keys() & set(want))
    assert hits >= 0.9 * 20 * 35


def test_ann_small(spark):
    t = vectors(spark, [(k, [1.0, float(k)], 0, 0, 0, 0, 0) for k in range(3)])
    assert [tuple(r)[:3] for r in sorted(adaptive_ann.search(t, t.where("vec_id = 0"), 20).collect())] == [(0, 1, 1), (0, 2, 2)]
    assert adaptive_ann.search(vectors(spark, []), vectors(spark, []), 20).count() == 0


# ---- 4: fixity


def test_fixity(spark):
    schema = "page_id long, url string, html string, archive int, idx int"
    rows = [(k, f"http://h{k}.org", f"<p>{k}</p>" * (k % 7), 0, 0) for k in range(2100)] + [(None, None, None, None, None), (7, "http://again", "x", 0, 0)]
    pages = spark.createDataFrame(rows, schema)
    a = warc_fixity.leaves(pages)
    assert warc_fixity.audit(a, warc_fixity.leaves(pages.repartition(5))).count() == 0
    worse = pages.where("page_id is null or page_id <> 1500").withColumn("html", F.when(F.col("page_id") == 42, "changed").otherwise(F.col("html")))
    got = warc_fixity.audit(a, warc_fixity.leaves(worse)).collect()
    by = {(r.record_id, r.status) for r in got}
    assert (42, "changed") in by and (1500, "missing") in by
    assert {r.record_id for r in got if r.status == "moved"} <= {*range(43, 1000), *range(1501, 2000)}
    assert (1999, "moved") in by and not {r.record_id for r in got} & {*range(2000, 2100)}
    back = warc_fixity.audit(warc_fixity.leaves(worse), a).collect()
    assert (1500, "extra") in {(r.record_id, r.status) for r in back}
    none = warc_fixity.leaves(spark.createDataFrame([], schema))
    assert warc_fixity.audit(none, none).count() == 0 and warc_fixity.audit(a, none).where("status = 'missing'").count() == len(rows)


def test_record_is_a_warc_record(spark):
    r = spark.range(1).select(warc_fixity.record_text(F.lit(3), F.lit("http://a/"), F.lit("é")).alias("r")).first().r.encode()
    head, body = r.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 2" in head and body == "é".encode() + b"\r\n\r\n"


# ---- 6: tool calls


def test_tool_calls(spark):
    call = lambda cid, turn, name, args: (1, cid, turn, name, args, "x")
    calls = [
        call("a", 1, "lookup", '{"query":"q","limit":3}'),
        call("b", 2, "search", '{"limit": 1e0, "query":"q","after":{"$ref":"a"}}'),
        call("c", 3, "search", '{"limit":5,"query":"","after":{"$ref":"b"},"extra":1}'),
        call("d", 4, "search", '{"limit":"5","after":{"$ref":"nowhere"}}'),
        call("e", 5, "lookup", "not json"),
        call("f", 6, "nothing", "{}"),
        call("g", 7, "search", '{"limit":1,"query":"x","after":{"$ref":"h"}}'),
        call("h", 8, "search", '{"limit":1,"query":"x","after":{"$ref":"g"}}'),
        call("a", 9, "lookup", "{}"),
        (None, None, None, None, None, None),
    ]
    results = [(1, "a", 2, 'say "hi"\n', 0), (1, "a", 3, "again", 0), (1, "b", 1, None, 0), (1, "z", 4, "lost", 0)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, refs string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string, n int")
    got = {x.call_id: x for x in tool_calls.link(c, r, tool_calls.SCHEMAS).collect()}
    assert [got[k].status for k in "abcz"] == ["linked", "early", "unanswered", "orphan"]
    assert [got[k].level for k in "abcdgh"] == [0, 1, 2, 0, None, None]
    assert got["a"].repeats == 2 and got["d"].dangling == 1
    assert got["a"].errors == [] and got["c"].errors == ["query: under 1", "unknown field extra"]
    assert got["d"].errors == ["limit: not int", "query: missing"] and got["e"].errors == ["not a JSON object"] and got["f"].errors == ["unknown tool"]
    assert got["a"].json == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"lookup","result":"say \\"hi\\"\\n"}'
    for k, x in got.items():
        assert list(json.loads(x.json)) == ["arguments", "id", "name", "result"], k
    assert tool_calls.link(c.limit(0), r.limit(0), tool_calls.SCHEMAS).count() == 0


def test_tool_calls_that_repeat(spark, monkeypatch):
    """Each call and each result is in one row, also where ids are null or one id is hot."""
    monkeypatch.setattr(tool_calls, "CHUNK", 7)
    odd = [(None, None), (None, ""), (-1, ""), (-1, None), (None, "x"), (1, "x")]
    calls = [(*i, t, f"n{t}", "{}") for i in odd for t in range(5)] + [(2, "hot", t % 400, "hot", "{}") for t in range(1500)] + [(3, "p", 1, "p", "{}"), (3, "q", 2, "q", '{"a":{"$ref":"p"}}')]
    calls += [(3, "q", 3, "q", '{"a":{"$ref":"q"}}'), (3, "q", 4, "q", '{"a":{"$ref":"no"}}'), (3, "s", 5, "s", '{"a":{"$ref":"s"}}'), (3, "s", 6, "s", '{"a":{"$ref":"s"}}')]
    calls += [(None, "p", 1, "p", "{}"), (None, "q", 2, "q", '{"a":{"$ref":"p"}}')]
    results = [(*i, t + 10, f"r{t}") for i in odd for t in range(6)] + [(2, "hot", 1000, "same")] * 1510
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string").repartition(5)
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").repartition(5)
    got = tool_calls.link(c, r, {}).collect()
    assert sorted(((x.conv_id, x.call_id, x.call_turn, json.loads(x.json)["name"]) for x in got if x.status != "orphan"), key=str) == sorted(((x[0], x[1], x[2], x[3]) for x in calls), key=str)
    assert sorted(((x.conv_id, x.call_id, x.result_turn, json.loads(x.json)["result"]) for x in got if x.status != "unanswered"), key=str) == sorted(results, key=str)
    for i in odd:
        mine = [x for x in got if (x.conv_id, x.call_id) == i]
        assert sorted((x.call_turn, x.result_turn, x.repeats) for x in mine if x.status == "linked") == [(t, t + 10, 9) for t in range(5)]
        assert [(x.result_turn, x.repeats) for x in mine if x.status == "orphan"] == [(15, 5)]
    assert sum(x.status == "linked" for x in got if x.call_id == "hot") == 1500
    assert sorted(((x.call_id, x.call_turn, x.level, x.dangling) for x in got if x.conv_id == 3)) == [("p", 1, 0, 0), ("q", 2, 1, 0), ("q", 3, 2, 0), ("q", 4, 0, 1), ("s", 5, None, 0), ("s", 6, None, 0)]
    assert [x.level for x in got if x.conv_id is None and x.call_id == "q"] == [1]


def test_canonical_arguments(spark):
    """Equal values have one text, no digit and no content is lost, and strings stay as they are."""
    same = [
        ["1", "1.0", "1e0", "10E-1", "0.1e1", "1.000"],
        ["0", "-0", "0.0", "0e5", "-0.0E-3"],
        ["123456789012345678901234567890123456789012"],
        ["123456789012345678901234567890123456789013", "123456789012345678901234567890123456789013.0"],
        ["1e400", "10e399"],
        ["-2.5e-3", "-0.0025", "-25E-4"],
        ["1e30", "1000000000000000000000000000000"],
        ["0.00000000000000000000000000012", "1.2e-28"],
        ['{"b":1.0,"a":[2e0,{"d":null,"c":true}]}', ' { "a" : [ 2 , {"c":true,"d":null}], "b":1 } ', '{"\\u0062":1,"a":[2.0,{"d":null,"c":true}]}'],
        ['"1.0"'],
        ['"\\u00011"', '"\\u00011"'],
        ['"\\u0001\\u00015"'],
        ['{"x":"a\\"1.0,\\\\","y":"caf\\u00e9 \\/"}', '{"y":"café /","x":"a\\u00221.0,\\u005c"}'],
    ]
    rows = [(k, t) for k, ts in enumerate(same) for t in ts]
    got = {(r.k, r.t): r.c for r in spark.createDataFrame(rows, "k int, t string").select("k", "t", tool_calls.canonical_json(F.col("t")).alias("c")).collect()}
    texts = []
    for k, ts in enumerate(same):
        found = {got[k, t] for t in ts}
        assert len(found) == 1 and None not in found, (ts, found)
        texts.append(found.pop())
        assert json.loads(texts[-1], parse_int=str, parse_float=str) is not None
        if not any(c in ts[0] for c in '{"'):
            from decimal import Decimal

            assert Decimal(texts[-1]) == Decimal(ts[0])
        else:
            assert json.loads(texts[-1]) == json.loads(ts[0])
    assert len({*texts}) == len(texts)
    bad = ['{"a":1,"a":2}', "01", "1.", "tru", '{"a":1', "\x02", "", None, "-", "[1 2]"]
    assert [r.c for r in spark.createDataFrame([(t,) for t in bad], "t string").select(tool_calls.canonical_json(F.col("t")).alias("c")).collect()] == [None] * len(bad)
    calls = [(1, "a\\/é", 1, "lookup", '{"query":"q","limit":3.0,"limit":4}'), (1, "café", 2, "lookup", "{}"), (1, "b", 3, "search", '{"a":{"$ref":"caf\\u00e9"},"b":{"\\u0024ref" : "a\\\\\\/\\u00e9"},"c":"{\\"$ref\\":\\"b\\"}"}'), (1, "c", 4, "lookup", '{"limit":2.0,"query":"x"}'), (1, "d", 5, "lookup", "{'")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string")
    found = {r.call_id: r for r in tool_calls.link(c, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), tool_calls.SCHEMAS).collect()}
    assert found["a\\/é"].errors == ["repeated key"] and json.loads(found["a\\/é"].json)["arguments"] == calls[0][4]
    assert (found["b"].level, found["b"].dangling) == (1, 0) and found["c"].errors == [] and json.loads(found["d"].json)["arguments"] == "{'"


# ---- 7: language


def test_language_id(spark):
    en, de = "the cat and the dog went to the house with the man ", "der hund und die katze gingen mit dem mann in das haus "
    rows = [(k, (en if k % 2 else de) * (1 + k % 5), "en" if k % 2 else "de", f"h{k % 3}", 0, 0, "", "", "", 0) for k in range(60)]
    odd = [(100, None, "en", "h1", 0, 0, "", "", "", 0), (101, "", None, None, 0, 0, "", "", "", 0), (102, "12345 --- 678", "en", "h1", 0, 0, "", "", "", 0), (103, "漢字仮名交じり文" * 20, "en", "h1", 0, 0, "", "", "", 0), (104, en * 30, "de", "h0", 0, 0, "", "", "", 0), (104, en * 30, "de", "h0", 0, 0, "", "", "", 0)]
    d = spark.createDataFrame([*rows, *odd], DOCS)
    got = {r.doc_id: r for r in language_id.identify_documents(d, spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[r[0]].lang_id == r[2] and not got[r[0]].rejected for r in rows)
    assert [got[k].rejected for k in (100, 101, 102, 103, 104)] == [True, True, True, True, False]
    assert got[104].lang_id == "en"  # the text outweighs a wrong declaration
    assert language_id.identify_documents(d.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.b.de/x", f"<html lang='de'><script>the the</script><p>{de * 5}</p>"), (2, "no address", None), (None, None, f"<p>{en * 4}")], "page_id long, url string, html string")
    p = {r.page_id: r for r in language_id.identify_pages(pages, spark.createDataFrame(rows, DOCS)).collect()}
    assert (p[1].lang_id, p[1].suffix, p[1].declared) == ("de", "de", "de") and p[2].rejected and p[None].lang_id == "en"


def test_language_of_rare_labels(spark):
    """Every label has a model, and a label short of texts loses none of its documents to the background."""
    rng = random.Random(5)
    names = [f"l{k:02}" for k in range(80)]
    words = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(30)] for x in names}
    text = lambda x: " ".join(rng.choices(words[x], k=40))
    rows = [(k, text(x), x) for k, x in enumerate(x for x in names for _ in range(2 if x > "l63" else 3))]
    rows += [(1000 + k, text("l00"), "l00") for k in range(6000)] + [(9000, "qq zz " * 20, "rare"), (9001, "y" * 30_000, "long"), (9002, None, "empty")]
    d = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify_documents(d).collect()}
    assert all(got[k].lang_id == x and not got[k].rejected for k, t, x in rows if t)
    assert got[9002].rejected
    # new texts of a label with one training text, in words that the text doesn't have
    new = spark.createDataFrame([(1, "vyxo kuwj dzem " * 9, "rare", "h"), (2, "vyxo kuwj dzem " * 9, "l00", "h")], d.schema)
    got = {r.doc_id: r.rejected for r in language_id.identify_documents(new, d.where("lang in ('l00', 'rare')")).collect()}
    assert got == {1: False, 2: True}


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    got = language_id.identify_documents(docs.where("doc_id % 2 = 1").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")), half)
    assert got.where("truth = lang_id").count() / got.count() > 0.97


# ---- 8: near duplicates


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, num, den):
    f = Forest(max(ids) + 1)
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                f.join(ids[a], ids[b])
    return [f.find(k) for k in ids]


def test_shingles():
    random.seed(5)
    texts = [None, "", "A b", "a B"] + ["".join(random.choices("aB \n é\x0b", k=random.randint(0, 60))) for _ in range(500)]
    got = list(shingle_sets(texts, 3))
    assert [len(x) for x in got] == [len(x) for x in brute_sets(texts, 3)]
    assert got[2].tolist() == got[3].tolist()


def test_prefix_tree():
    random.seed(3)
    for _ in range(120):
        num, den = random.choice([(85, 100), (8, 10), (1, 2), (1, 1)])
        base = [random.sample(range(60), random.randint(1, 25)) for _ in range(4)]
        sets = []
        for _ in range(random.randint(1, 40)):
            b = set(random.choice(base))
            for _ in range(random.randint(0, 4)):
                b.symmetric_difference_update({random.randrange(60)})
            if b:
                sets.append(np.array(sorted(b)) * 7919)
        true = {(i, j) for i in range(len(sets)) for j in range(i) if den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))}
        assert {(max(p), min(p)) for p in join_sets(sets, num, den, connect=False)} == true
        f, g = Forest(len(sets)), Forest(len(sets))
        for a, b in true:
            f.join(a, b)
        assert all(g.join(a, b) for a, b in join_sets(sets, num, den))
        assert [f.find(k) for k in range(len(sets))] == [g.find(k) for k in range(len(sets))]


@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_share_a_signature(num):
    random.seed(num)
    rng = np.random.default_rng(num)
    parts, tried = ngram_join.Parts(num, 100), 0
    for _ in range(1200):
        n = int(np.exp(random.uniform(0, 7)))
        u = rng.integers(-(2**63), 2**63 - 1, 2 * n + 50)
        most = max(1, int(n * 0.2))
        x = np.unique(u[:n])
        y = np.unique(np.concatenate([u[random.randint(0, min(n - 1, most)) : n], u[n : n + random.randint(0, most)]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < num * (len(x) + len(y) - both):
            continue
        common = u[rng.random(len(u)) < random.choice([0, 0.1, 0.7, 1])]
        a, b = (ngram_join.part_signatures(s, np.isin(s, common), parts) for s in (x, y))
        tried += 1
        assert set(a.tolist()) & set(b.tolist())
    assert tried > 300


@pytest.mark.parametrize("size", [2, 1000])
def test_jaccard_components(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", size)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    random.seed(6)
    words = [f"w{k}" for k in range(400)]
    base = [random.choices(words, k=n) for n in (4, 30, 60, 90)]
    texts = [None, "", "  ", "one", "ONE", "two words", "Two  Words", "two words three"]
    for _ in range(45):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            w[random.randrange(len(w))] = random.choice(words)
        texts.append(" ".join(w))
    rows = [(k, t, "", "", 0, 0, "", "", "", 0) for k, t in enumerate(texts)]
    sets = brute_sets(texts, 4)
    want = [(k, len(s), c) for k, s, c in zip(range(len(texts)), sets, brute_components(range(len(texts)), sets, 85, 100), strict=True)]
    d = spark.createDataFrame([*rows, rows[20], (None, texts[20], "", "", 0, 0, "", "", "", 0)], DOCS).repartition(4)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(d, 4, 85, 100).collect()), key=str)
    assert got == sorted([*want, want[20], (None, want[20][1], None)], key=str)
    if size == 1000:
        kept = sorted((r.doc_id for r in ngram_join.drop_near_duplicates(d, 5, 80, 100).collect()), key=str)
        c5 = brute_components(range(len(texts)), brute_sets(texts, 5), 80, 100)
        assert kept == sorted([*(k for k in range(len(texts)) if c5[k] == k), None], key=str)
        assert ngram_join.jaccard_components(d.limit(0), 4, 85, 100).count() == 0


def test_a_block_of_unrelated_sets_is_read_in_proportion(spark, monkeypatch):
    """Sets of one block that are not linked meet no other chunk whole; near ones of different chunks are linked."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    texts = [" ".join(f"t{k}w{x}" for x in range(30)) for k in range(60)]
    texts += [texts[k] + " more" for k in range(0, 60, 4)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = docs.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("component"))
    read, chosen = [], ngram_join.chosen_sets
    monkeypatch.setattr(ngram_join, "chosen_sets", lambda docs, placed, *a: (read.append(placed.count()), chosen(docs, placed, *a))[1])
    ngram_join.ship(spark)
    links = ngram_join.block_links(docs, labels, 4, 85, 100, (np.zeros(0, np.int64), np.zeros(0, np.int32)), "doc_id", "text")
    assert {(max(r), min(r)) for r in links.collect()} == {(60 + k // 4, k) for k in range(0, 60, 4)}
    assert sum(read) <= 3 * len(texts)


def test_near_copies_apart_make_rows_in_proportion(spark, monkeypatch):
    """Near copies in many chunks of a block of other texts: no step's rows grow with the square of the group."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 20)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    ngram_join.ship(spark)
    made = {}
    frame = type(spark.range(1))
    plain = frame.mapInArrow

    def counted(self, func, schema, *args):
        rows = made.setdefault((func.__qualname__, schema), [])
        rows.append(spark.sparkContext.accumulator(0))
        total = rows[-1]

        def run(batches):
            for b in func(batches):
                total.add(b.num_rows)
                yield b

        return plain(self, run, schema, *args)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    found = []
    for m in (60, 240):
        made.clear()
        # the set that every chunk meets is none of the near copies
        ids = [r.id for r in spark.range(2 * m).orderBy(F.xxhash64("id"), "id").collect()]
        base = [f"w{x}" for x in range(120)]
        texts = {i: " ".join([*base[: k % 120], f"new{k}", *base[k % 120 + 1 :]]) if k % 2 else " ".join(f"t{k}w{x}" for x in range(30)) for k, i in enumerate(ids)}
        docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
        labels = docs.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("component"))
        links = ngram_join.block_links(docs, labels, 4, 85, 100, (np.zeros(0, np.int64), np.zeros(0, np.int32)), "doc_id", "text")
        near = ids[1::2]
        assert {(r.node, r.component) for r in ngram_join.components(links).collect()} == {(i, min(near)) for i in near}
        found.append({k: sum(a.value for a in v) for k, v in made.items()})
    assert all(found[1][k] <= 8 * max(v, 100) for k, v in found[0].items())


def test_stray_cells(spark, monkeypatch):
    """Texts that drift from each other, in blocks of a shingle's sets of two: every link between parts is found."""
    for name, value in (("BLOCK_SETS", 2), ("PIVOTS", 1), ("GROUP", 2), ("PAIRS", 10)):
        monkeypatch.setattr(ngram_join, name, value)
    random.seed(15)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for n in (12, 50, 90):
        w = random.choices(words, k=n)
        for _ in range(30):
            w[random.randrange(n)] = random.choice(words)
            texts.append(" ".join(w))
    random.shuffle(texts)
    sets = brute_sets(texts, 4)
    want = list(brute_components(range(len(texts)), sets, 85, 100))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = docs.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("component"))
    ngram_join.ship(spark)
    # nothing is connected before the cells, which must then find all
    monkeypatch.setattr(ngram_join, "pivot_pairs", lambda rare, *a: rare.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    for common in (np.zeros(0, np.int64), np.unique(np.concatenate([*shingle_sets(texts[:9], 4)]))):
        links = ngram_join.block_links(docs, labels, 4, 85, 100, (common, np.arange(len(common), dtype=np.int32)), "doc_id", "text")
        got = {r.node: r.component for r in ngram_join.components(links).collect()}
        assert [got.get(k, k) for k in range(len(texts))] == want


# ---- queries and pipeline


def test_queries_with_sql(spark, sf):
    from pairspin import llm

    c = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        c.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, text in llm.oracle_sql().items():
        df = llm.queries()[name](spark, sf)
        cols = sorted(df.columns)
        cur = c.execute(text)
        at = [[d[0] for d in cur.description].index(x) for x in cols]
        assert sorted(str([r[x] for x in cols]) for r in df.collect()) == sorted(str([r[k] for k in at]) for r in cur.fetchall()), name


def test_pipeline(spark, sf, library):
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = [k for k in sorted(docs) if (docs[k].text or "").strip()]
    comp = brute_components(ids, brute_sets([docs[k].text for k in ids], 5), 80, 100)
    got = corpus_pipeline.run(spark, sf).collect()
    # every document here is in one of the labelled languages
    assert sorted(r.doc_id for r in got) == [k for k, c in zip(ids, comp, strict=True) if k == c]
    for r in got[:40]:
        assert r.ids == ids_of(library, docs[r.doc_id].text) and r.decoded_equal
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    slots = {r.doc_id: (r.mix_slot, r.mix_pos) for r in mixing.mix(spark.createDataFrame([(r.doc_id, r.source) for r in got], "doc_id long, source string"), mixing.SHARES).collect()}
    assert [slots[r.doc_id] for r in got] == sorted(slots[r.doc_id] for r in got)


def test_pipeline_order_of_several_files(spark):
    """The schedule reaches the result though Spark scans files longest first."""
    import corpus_pipeline

    rows = [(k, f"text {k} " * (1 + 40 * (k % 7 == 0)), "en", f"src{k % 3}", 0, 1, "", "", "", 0) for k in range(600)]
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), "").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch(spark, "uneven")
    for k, part in enumerate(((0, 1), (1, 50), (50, 400), (400, 600))):
        ids = [r.doc_id for r in mixed.select("doc_id").collect()[slice(*part)]]
        mixed.where(F.col("doc_id").isin(ids)).coalesce(1).write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) > 1
    want = {r.doc_id: (r.mix_slot, r.mix_pos) for r in mixing.mix(spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, source string"), mixing.SHARES).collect()}
    assert [want[r.doc_id] for r in back.select("doc_id").collect()] != sorted(want.values())
    got = corpus_pipeline.encode(spark, back, "").collect()
    assert [want[r.doc_id] for r in got] == sorted(want.values())
    assert all((r.mix_slot, r.mix_pos) == want[r.doc_id] for r in got)


# ---- words that clash under polynomial hashes, and very long texts


def thue_morse(n):
    """The word of n letters and its complement: equal under any polynomial hash modulo 2^64 from 1,024 letters on."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096, 65_536])
def test_words_that_clash(library, n):
    x, y = thue_morse(n)
    texts = [f"{x} {y} {x}", f"{y}", f"so {x}"]
    want = [ids_of(library, t) for t in texts]
    assert want[1] != ids_of(library, x)
    assert [i.tolist() for i in pretokens.library_encoder(BPE).encode(texts)] == want
    assert digest_cache.count_tokens(BPE, texts) == [*map(len, want)]
    v, encoder = bpe_codec.codec(BPE, bpe_codec.compile_lexicon({x[:40]: bpe_codec.vocabulary(BPE).merge(x[:40])}))
    assert [i.tolist() for i in encoder.encode(texts)] == want
    sets = [*shingle_sets([x, y, f"{x} b c d e", f"{y} b c d e"], 5)]
    assert sets[0] != sets[1] and not np.intersect1d(sets[2], sets[3]).size


def test_texts_beyond_every_block(library):
    random.seed(8)
    words = ["alpha", "Beta", "don't", "42", "naïve", "漢字", "\n\n", "x" * 40]
    text = " ".join(random.choices(words, k=400_000))
    assert len(text) > 2 * pretokens.BLOCK and len([*pretokens.pieces(text)]) > 1
    dense = text[: 2 * pretokens.BLOCK + 10].replace(" ", "_")  # nowhere to cut
    for t in (text, dense):
        want = ids_of(library, t)
        assert pretokens.library_encoder(BPE).encode([t, "a"])[0].tolist() == want
        _, encoder = bpe_codec.codec(BPE, bpe_codec.compile_lexicon({}))
        assert encoder.encode(["b", t])[1].tolist() == want
    lower = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode().lower()) if w]
    assert len(next(shingle_sets([text], 3))) == len({tuple(lower[k : k + 3]) for k in range(len(lower) - 2)})


def test_jaccard_of_crowds(spark):
    """Many near copies in a task share their signatures; sizes drift, so runs must be parted and joined alike."""
    random.seed(12)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for n in (6, 40, 120):
        w = random.choices(words, k=n)
        for k in range(60):
            w = [*w, random.choice(words)] if k % 3 == 0 else w
            copy = list(w)
            copy[random.randrange(n)] = random.choice(words)
            texts.append(" ".join(random.choice([w, copy])))
    random.shuffle(texts)
    sets = brute_sets(texts, 4)
    want = [(k, len(s), c) for k, s, c in zip(range(len(texts)), sets, brute_components(range(len(texts)), sets, 85, 100), strict=True)]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(d, 4, 85, 100).collect()) == want


def test_near_duplicates_of_repeated_keys(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, 1), (1, b, 2), (1, b, 2), (2, a + " z", 3), (3, "c " * 30, 4), (None, a, 5), (4, None, 6), (4, None, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _rank int").withColumnRenamed("_rank", "a.b").withColumn("_rank", F.lit(0)).withColumn("number", F.lit(1))
    kept = ngram_join.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (3, "c " * 30), (None, a), (4, None), (4, None)], key=str)
    once = d.where("doc_id in (2, 3)")
    assert kept.count() == 6 and ngram_join.drop_near_duplicates(once).columns == d.columns


def test_mixing_of_hot_keys_and_any_names(spark, monkeypatch):
    """A key that a third of the rows share is cut in cells; places are those of one order by (digest, hash of the row)."""
    rows = [(k if k % 3 else None, f"text {k}", "a" if k % 2 else "b") for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_slot", F.lit(7)).withColumn("a.b", F.lit(1))
    tie = F.lpad(F.hex(F.xxhash64("doc_id", "text", "source", "mix_slot", "`a.b`")), 16, "0")
    order = {r.text: (r.h, r.t) for r in d.select("text", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), tie.alias("t")).collect()}
    want = [sorted((r[1] for r in rows if r[2] == s), key=order.get) for s in "ab"]
    for cell in (100_000, 5):
        monkeypatch.setattr(mixing, "CELL_ROWS", cell)
        got = mixing.mix(d.repartition(3), {"a": 2, "b": 1}, 4)
        assert sorted(got.columns) == sorted(["doc_id", "text", "source", "a.b", *(f"mix_{c}" for c in ("group", "block", "pos", "slot", "release", "deadline", "mixed"))])
        r = got.collect()
        assert [[x.text for x in sorted(r, key=lambda x: (x.mix_slot, x.mix_pos)) if x.source == s] for s in "ab"] == want
    assert mixing.mixed_order(d, {"a": 2}).columns == d.columns


def test_stages_take_any_column_names(spark):
    """Names that the operators use themselves, and names with dots, come through every stage but the last unchanged."""
    import corpus_pipeline

    text = "the house stands near the river and the old road leads to the village "
    rows = [(k, f"{text}{k} {k + 1} {k + 2}", "en" if k % 2 else "fr", f"src{k % 3}", 5) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["rejected", "lang_id", "row", "ev", "host", "mix_slot", "_rank", "component", "node", "number", "a.b", "Key"]
    d = d.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    assert d.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() == d.count()


def test_each_content_is_encoded_once(spark, library):
    """Rows that repeat key and text, null keys among them, make one cache entry; a warm cache gets only what is new."""
    rows = [(None, "the same text")] * 500 + [(7, "another")] * 20 + [(k, f"text {k % 30}") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cache = scratch(spark, "once")
    got = digest_cache.cached_counts(d, BPE, cache)
    assert sorted((r.n_bytes, r.n_tokens) for r in got.collect()) == sorted((len(t), len(ids_of(library, t))) for _, t in rows)
    assert spark.read.parquet(cache).count() == 32
    more = d.unionByName(spark.createDataFrame([(1, "new")] * 3, "doc_id long, text string"))
    assert digest_cache.cached_counts(more, BPE, cache).count() == len(rows) + 3
    assert spark.read.parquet(cache).count() == 33


def test_ann_of_several_sizes_and_lengths(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.standard_normal(8 if k % 4 else 5) * rng.lognormal(0, 1) for k in range(400)}
    d = spark.createDataFrame([(k, [float(c) for c in x]) for k, x in data.items()], "vec_id long, embedding array<double>")
    got = adaptive_ann.search(d, d.where("vec_id % 20 = 0 or vec_id % 20 = 1"), 5).collect()
    for q in (x for x in data if x % 20 < 2):
        scores = sorted(((-float(data[q] @ v), k) for k, v in data.items() if k != q and len(v) == len(data[q])))[:5]
        mine = [(r.rank, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == [(k + 1, x) for k, (_, x) in enumerate(scores)]


def test_cap_join_tells_pairs_apart_by_both_ways(monkeypatch):
    rng = np.random.default_rng(4)
    lists = np.sort(rng.integers(-1, 40, (60, 6)), axis=1)
    want = np.array([[not set(a[(a >= 0) & (a < 20)]) & set(b[(b >= 0) & (b < 20)]) for b in lists] for a in lists[10:30]])
    for most in (0, 10**6):
        monkeypatch.setattr(cap_join, "COMPARISON", most)
        linked = np.ones((20, 60), bool)
        cap_join._parted(linked, 10, lists, 20)
        assert (linked == want).all()
