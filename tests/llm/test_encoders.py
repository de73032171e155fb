"""Language ID, audio, byte BPE and token files."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.llm import audio, bpe, langid, token_files
from graphweave.llm.queries import vocabulary



def clash(n):
    """Two words of n letters that a polynomial hash modulo 2 ** 64 can't tell apart (Thue and Morse)."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


RANKS, WORDS = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("word_bpe_49k.json")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- language ID


def slow_prices(model, text):
    """Code lengths by the definition, symbol by symbol."""
    size = 256
    x = [langid.PAD] * 3 + list(text.lower().encode())
    out = []
    for lang in model["langs"]:
        tables = []
        for k in range(4):
            d = {}
            for g, n in zip(*(a.tolist() for a in model["grams"][lang][k]), strict=True):
                d.setdefault(g // size, {})[g % size] = n
            tables.append(d)
        bits = 0.0
        for at in range(3, len(x)):
            for k in (3, 2, 1, 0):
                context = 0
                for j in range(k, 0, -1):
                    context = context * size + x[at - j]
                seen = tables[k].get(context)
                if seen is None:
                    continue
                total = sum(seen.values()) + len(seen)
                if x[at] in seen:
                    bits -= np.log2(seen[x[at]] / total)
                    break
                bits -= np.log2(len(seen) / total)
            else:
                bits += 8
        out.append(bits)
    return out


def test_prices_by_definition():
    model = langid.count({"de": ["der die das und nicht der", "die und"], "en": ["the and of the", "that is it"]})
    p = langid.Prices(model)
    for text in ("the die und", "", "zzz!?", "ä the", "a", "漢字 и the \x00"):
        raw = text.lower().encode()
        got = p.bits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert got == pytest.approx(slow_prices(model, text), rel=1e-4, abs=1e-4)


def test_letters():
    assert langid.has_letter([None, "", "12 !", "Ⓐ Ⅷ", "é", "漢", "x" * 9, "9" * 99 + "x"]).tolist() == [False] * 4 + [True] * 4


def test_slots():
    from graphweave.llm import common

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 32, n))
        ask = np.concatenate([keys, rng.integers(0, 1 << 32, 500)])
        want = np.searchsorted(keys, ask)
        want = np.where((want < len(keys)) & (np.append(keys, -1)[np.minimum(want, len(keys))] == ask), want, len(keys))
        assert common.Slots(keys).find(ask).tolist() == want.tolist()


def test_language_id(edge_docs, no_docs):
    out = langid.identify(edge_docs).toPandas().set_index("doc_id", drop=False)
    assert len(out) == edge_docs.count()
    assert (out.loc[[100, 101, 102, 107], "lang_pred"] == "und").all() and (out.loc[[100, 101, 102, 107], "score"] == 0).all()
    assert out.loc[103, "lang_pred"].tolist() == ["en", "en"] and out.loc[105, "lang_pred"] == "de"
    held = out[out.held_out & (out.doc_id < 40)]
    assert len(held) and (held.lang_pred == np.where(held.doc_id % 2, "en", "de")).all()
    assert ((out.score >= 0) & (out.score <= 1)).all()
    assert all(out.held_out[k] == (zlib.crc32(str(int(k)).encode()) % 3 == 1) for k in range(40))
    assert langid.identify(no_docs).count() == 0
    nothing = langid.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert (nothing.lang_pred == "und").all()


# ---------------------------------------------------------------- audio


def slow_adpcm(block):
    value = int(np.array(block[:2], np.uint8).view("<i2")[0])
    index = min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            delta = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                delta += part if nibble & bit else 0
            value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
            index = max(0, min(88, index + int(audio.MOVES[nibble & 7])))
            out.append(value)
    return out


def test_adpcm_and_tables():
    rng = random.Random(4)
    blocks = np.array([[rng.randrange(256) for _ in range(64)] for _ in range(20)], np.uint8)
    assert audio.adpcm_blocks(blocks).tolist() == [slow_adpcm(b.tolist()) for b in blocks]
    assert (audio.MULAW[0xFF], audio.MULAW[0x00], audio.MULAW[0x80]) == (0, -32124, 32124)
    assert (audio.ALAW[0xD5], audio.ALAW[0x55], audio.ALAW[0xAA], audio.ALAW[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(audio.MULAW.tolist())) == 255 and len(set(audio.ALAW.tolist())) == 256
    assert audio.resample2(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]


def test_media_round_trip(edge_docs, no_docs):
    out = {r.doc_id: r for r in audio.convert(audio.encode_media(edge_docs)).collect()}
    for d, text in texts_of(edge_docs):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[d]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and len(payload) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        media = audio.store(payload)
        assert audio.load(media) == payload and r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
        own = audio.MULAW[np.frombuffer(payload, np.uint8)].astype(int)
        assert np.frombuffer(r.pcm16k, "<i2").tolist() == [x for a, b in zip(own, [*own[1:], own[-1]], strict=True) for x in (a, (a + b) >> 1)]
        assert f"pcm={zlib.crc32(r.pcm16k):08x}" in r.feature
    assert out[103].feature == out[104].feature
    again = {r.doc_id: r for r in audio.decode_media(audio.encode_media(edge_docs)).collect()}
    assert all((again[d].pcm16k, again[d].feature) == (out[d].pcm16k, out[d].feature) for d in out)
    assert audio.convert(audio.encode_media(no_docs)).count() == audio.decode_media(audio.encode_media(no_docs)).count() == 0


# ---------------------------------------------------------------- byte BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_scan_is_associative():
    gens, product, _, _ = bpe.monoid()
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000, 40000):
        x = gens[rng.integers(0, len(gens), n)]
        acc, slow = 0, []
        for e in x:
            acc = product[acc, e]
            slow.append(acc)
        assert bpe.prefix(x, product).tolist() == slow


def test_bpe_equals_library(edge_docs, no_docs, tiktoken_encoding, spark):
    rng = random.Random(2)
    alphabet = "aab'strevlmd 1 2\n\t  !?é漢  '’ßſ٣ 😀\x1c\x85"
    made = [(1000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))) for k in range(400)]
    made += [(2000 + k, t) for k, t in enumerate([*clash(1024), *clash(2048), *clash(4096), " ".join(clash(2048))])]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    want = {d: tiktoken_encoding.encode_ordinary(t or "") for d, t in texts_of(docs)}
    text = {d: (t or "").encode() for d, t in texts_of(docs)}
    encoded = bpe.encode(docs, RANKS)
    m = bpe.Merger(RANKS)
    for r in encoded.collect():
        assert list(r.ids) == want[r.doc_id]
        assert bpe.decode_bytes(np.array(r.ids, int), m) == text[r.doc_id]
        assert list(r.starts) == np.cumsum([0, *[len(m.bytes[i]) for i in r.ids]])[:-1].tolist()
    for r in bpe.digest(encoded, RANKS).collect():
        assert r.n_tokens == len(want[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id]).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
    assert sorted(map(str, bpe.round_trip(docs, RANKS).collect())) == sorted(map(str, bpe.digest(encoded, RANKS).collect()))
    assert bpe.digest(bpe.encode(no_docs, RANKS), RANKS).count() == bpe.round_trip(no_docs, RANKS).count() == 0


def test_clashing_hashes_are_noticed(monkeypatch):
    """Slices that share their first hash are told apart by the second, in a batch and against what is kept."""
    from graphweave.llm import common

    real = common.hashes2
    monkeypatch.setattr(common, "hashes2", lambda *x: (real(*x)[0] & np.uint64(3), real(*x)[1]))
    words = [f"word{k}".encode() for k in range(40)]
    cache = common.Cache(lambda own: (np.array([int(w[4:]) for w in own]), np.ones(len(own), np.int64)))
    for part in (words[:1], words[1:2], words, words[5:6]):
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(w) for w in part])
        assert cache.look(data, ends - [len(w) for w in part], ends)[0].tolist() == [int(w[4:]) for w in part]


def test_hashes_depend_on_the_slice_alone():
    from graphweave.llm.common import hashes2

    rng = random.Random(1)
    words = list({bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 90))) for _ in range(3000)}) + [w.encode() for n in (64, 65, 1024, 2048) for w in clash(n)]
    for gap in (b"", b"x", b"yyyyy"):
        data = np.frombuffer(b"".join(w + gap for w in words), np.uint8)
        ends = np.cumsum([len(w) + len(gap) for w in words]) - len(gap)
        a, b = hashes2(data, ends - [len(w) for w in words], ends)
        assert len(set(a.tolist())) == len(set(b.tolist())) == len(set(words))
        if gap == b"":
            first = (a, b)
        assert (first[0] == a).all() and (first[1] == b).all()


def test_both_mergers_agree():
    m = bpe.Merger(RANKS)
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcdethe  in\xc3\xa9!") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    flat, length = m.merge_many(pieces)
    cut = np.cumsum([0, *length]).tolist()
    assert [flat[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [m.merge_one(p) for p in pieces]


# ---------------------------------------------------------------- token files


def test_token_files(edge_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    added = ["a <|startoftext|> b", "in<|endoftext|>side<|endoftext|>", "A <|STARTOFTEXT|> B <|startoftext|", "<|endoftext|>", "<|endoftext|"]
    edge_docs = edge_docs.select("doc_id", "text").union(edge_docs.sparkSession.createDataFrame([(3000 + k, t) for k, t in enumerate(added)], "doc_id long, text string"))
    folder = "file://" + str(tmp_path / "t")
    shards = token_files.write_shards(edge_docs, folder, WORDS, n=3)
    out = token_files.read_shards(edge_docs.sparkSession, folder, shards).orderBy("start").collect()
    rows = sorted(texts_of(edge_docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    assert len(out) == len(rows)
    for r, (d, t) in zip(out, rows, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sum(s["n_tokens"] for s in shards) == at and [s["base"] for s in shards] == np.cumsum([0, *[s["n_tokens"] for s in shards]])[:-1].tolist()
    assert token_files.token_files(no_docs, WORDS).count() == 0
    assert at == sum((tmp_path / "t" / (s["name"] + ".bin")).stat().st_size // 2 for s in shards)


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    from graphweave.llm.common import Cache

    tok = Tokenizer.from_file(WORDS)
    fill, _, pattern = token_files.word_encoder(WORDS)
    rng = random.Random(6)
    alphabet = [*"aAb'strevlmdDS 12\n\t  !.,?é漢  '’ßſ٣ 😀\x1c\x85İ", *"̧́K<|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]
    for k in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) if k else clash(2048)[0] + " " + clash(2048)[1]
        raw = np.frombuffer(t.encode(), np.uint8)
        data, s, e, _ = token_files.lowered(raw, np.array([0, len(raw)]), pattern)
        ids, _ = Cache(fill).look(data, s, e)
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
