"""Language ID, chat formatting, media columns and BPE against plain Python."""

import base64
import math
import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest

from barloom.llm import bpe, chat, core, langid, media, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, odd characters, a clashing extra column."""
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "ünïcödé 日本語 🤖🤖 don't <|endoftext|>"), (5, "a" * 30000), (6, "same text"), (7, "same text"), (None, "no id"), (8, "12 34 --"), (9, "same text")]
    return spark.createDataFrame([(i, t, None, "x", 0, "clash") for i, t in rows], DOC + ", digest string")


def test_bpe_equals_tiktoken(spark, odd, sf):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, queries.table(spark, sf, "documents")):
        got = {r[0]: r[1:] for r in bpe.round_trip(docs, bpe.public_document()).collect()}
        for r in docs.collect():
            ids = t.encode_ordinary(r.text or "")
            assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text or ""))


def test_bpe_offsets_and_split_characters(spark, odd):
    doc = bpe.public_document()
    enc = bpe.encode(odd, doc)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in enc.collect():
        text = texts[r.doc_id]
        assert (not r.ids) == (not text)
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text)
            c = bpe.codec(doc)
            for i, a, b in zip(r.ids[:400], r.starts, r.ends):
                piece = c.tokens[i]
                assert piece in text[a:b].encode()
            assert "".join(c.decode_stream(r.ids)) == text
    assert {r.doc_id: r.text for r in bpe.decode(enc, doc).collect()} == texts
    assert bpe.codec(doc).decode(bpe.codec(doc).encode(["🤖"])[0][:1]) == "�"


def test_language_accuracy_and_rejects(spark, odd):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r for r in langid.identify(odd, {"en": b"the same text and no idea", "xx": b"qqq zzz"}).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and out[6].lang_pred == "en" and out[7].score == out[6].score
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.sample(odd) == {} and langid.identify(odd.limit(0), {"en": b"abc"}).count() == 0


def brute_phrases(text, ref):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in ref:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_longest_matches():
    """Lanes leave no trace: the phrases are those of one parse of the whole text."""
    rng = np.random.default_rng(3)
    long = bytes(rng.choice(list(b"abcd"), 6000))
    ref = (bytes(rng.choice(list(b"abcd"), 300)), bytes(rng.choice(list(b"abc e"), 200)), long, b"a" * 50)
    sizes = (0, 1, 2, 50, 500, langid.LANE, langid.LANE + 7, 5 * langid.LANE + 1)
    texts = [bytes(rng.choice(list(b"abcdez"), n)) for n in sizes] + [long[100:5900], b"a" * 9001, b"ab" * 4000]
    off = np.cumsum([0, *map(len, texts)])
    got = langid.Parser(tuple(zip("abcd", ref))).phrases(np.frombuffer(b"".join(texts), np.uint8), off)
    for t, row in zip(texts, got):
        assert row.tolist() == [brute_phrases(t, r) for r in ref]


def test_interleaved_rows_are_the_automaton():
    rng = np.random.default_rng(4)
    for width in (2, 5, 60):
        step = langid.automaton(rng.integers(0, width, int(rng.integers(1, 900))))
        place, cells = langid.interleaved(step, width)
        for s, row in enumerate(step):
            for a in range(width):
                owner, to = int(cells[place[s] + a]) >> 32, int(cells[place[s] + a]) & 0xFFFFFFFF
                assert (owner == s) == (a in row) and (a not in row or to == row[a])
        assert np.count_nonzero(cells >= 0) == sum(map(len, step))


def test_language_query_equals_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents")
    samples = langid.sample(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and set(samples) == {r.lang for r in rows if r.lang is not None}
    lowered = {k: v.lower() for k, v in sorted(samples.items())}  # bytes.lower changes A-Z alone
    for r in rows:
        text = (r.text or "").encode().lower()
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        bits = sorted((brute_phrases(text, ref) * math.log2(len(ref)) / len(text), k) for k, ref in lowered.items())
        assert got[r.doc_id].lang_pred == bits[0][1] and math.isclose(got[r.doc_id].score, 1 - bits[0][0] / bits[1][0], abs_tol=1e-12)


def test_sample_takes_lowest_hashes_of_every_language(spark):
    import xxhash

    rows = [("en", f"text {i % 50} of few") for i in range(3000)] + [("de", f"Text {i} von vielen") for i in range(3000)] + [("fr", None), (None, "none"), ("it", "x" * 5000), ("nl", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = langid.sample(df)
    h = lambda t: xxhash.xxh64(t.encode(), 42).intdigest()
    for k in ("en", "de"):
        want = sorted({t for x, t in rows if x == k}, key=lambda t: h(t) >> 11)[: langid.SAMPLE_TEXTS]
        assert got[k] == "\n".join(want).encode()
    assert got["it"] == b"x" * langid.SAMPLE_CHARS and set(got) == {"en", "de", "it"}
    many = spark.range(300).selectExpr("concat('l', id) as lang", "repeat('ab', 100) as text")
    assert len(part := langid.sample(many, total=3000)) == 300 and {len(v) for v in part.values()} == {10}
    with pytest.raises(ValueError):
        langid.sample(spark.range(langid.MAX_LANGS + 1).selectExpr("cast(id as string) as lang", "'t' as text"))


def test_chat_reads_back(spark, sf):
    rows = queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(queries.forged(spark))
    extra = [(-1, 0, "system", "be brief"), (-1, 1, "user", None), (-1, 2, "assistant", "x" * 5000), (-1, 3, "user", "a\\s\\"), (-1, 4, "assistant", "###</turn>\\h: "), (-2, 0, "system", ""), (-3, 0, None, "q"), (-3, 0, "assistant", "same"), (-3, 0, "assistant", "same"), (-4, None, "odd: ###", "z"), (None, 1, "user", "null id")]
    rows = rows.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    want = {}
    for r in rows.collect():
        want.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    for budget, history in ((512, 128), (40, 16), (100000, 10)):
        windows = chat.format_windows(rows, budget, history)
        got = {r.conv_id: r for r in chat.digests(windows).collect()}
        assert set(got) == set(want)
        for k, turns in want.items():
            turns = sorted(turns)
            loss = "".join(t for _, _, role, t in turns if role == "assistant")
            r = got[k]
            assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, _, a, b in turns)))
            assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        for r in windows.collect():
            led = min(want[r.conv_id])[2] == "system"
            assert r.n_tokens <= budget or r.n_turns - r.n_repeated == 1 + (led and r.window == 0)
            if led:
                assert r.text.startswith("### system: ")
    assert chat.digests(chat.format_windows(rows.limit(0))).count() == 0


def test_media_round_trip(spark, odd, tmp_path):
    base = f"file://{tmp_path}/media"
    index = core.written(media.store(odd, base), "t")
    meta = {r.doc_id: r for r in media.metadata(media.by_file(index, "shard"), base).collect()}
    got = {r.doc_id: r for r in media.load(index, base).collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        payload = media.padded(text.encode())
        r = got[k]
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(payload), sha(payload))
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and (meta[k].width, meta[k].height, meta[k].bit_depth) == (64, len(payload) // 64, 8)
        assert r.media_sha256 == meta[k].digest and r.media_bytes == meta[k].length
    assert got[6].media_sha256 == got[7].media_sha256
    import tarfile

    for f in (tmp_path / "media").iterdir():
        with tarfile.open(f) as t:
            for m in t:
                data = t.extractfile(m).read()
                assert m.name == f"{sha(data)}.png" and struct.unpack(">I", data[16:20])[0] == 64
    assert media.store(odd.limit(0), base).count() == 0


def test_media_query_equals_brute_force(spark, sf):
    """All of a row but the stored form follows from the text; the stored form is a PNG that another reader's rules accept."""
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op9_media_columns(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        bins = [0] * 8
        for b in payload:
            bins[b // 32] += 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bit_depth, r.colour_type) == (64, len(payload) // 64, 8, 0)
        assert r.feature == f"64x{r.height};mean={sum(payload) / len(payload):.4f};zero={payload.count(0)};bins={','.join(map(str, bins))}"
        png = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), sha(png))
