import io
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexarium.llm import packing, tokenfile
from lexarium.llm.tokenizing import Encoder, id_bytes, public_path

TEXTS = ["a  b\n\n c\t d", " x", "x ", "\n\nfoo \n bar", "", "'s it's   x", "Ünï  çödé'll ΣΑΣ, 12345 !!??", "é ́x", "a\x0bb\x0cc\r\nd  \r\n  e", "　a b   c", "\x1ca \x1f", "<|endoftext|> hi", "a <|endoftext|>b  <|EndOfText|> <|startoftext|> c<|",  "x" * 3000]


@pytest.mark.parametrize(("name", "chunks"), [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_cached_encoding_equals_whole_texts(name, chunks):
    e, plain = Encoder(public_path(name), chunks, cache=5), Tokenizer.from_file(public_path(name))
    for text in TEXTS + TEXTS:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    kept = Encoder(public_path(name), chunks, protect=True)
    plain.encode_special_tokens = True
    for text in TEXTS:
        assert np.frombuffer(kept.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=" \n\t\r\x0b\x1c ́aZéß'.,1＃"), st.sampled_from([("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")]))
def test_cached_encoding_of_any_text(text, which):
    from lexarium.llm.tokenizing import encoder

    e = encoder(public_path(which[0]), which[1])
    assert np.frombuffer(e.encode(text), "<u4").tolist() == fresh(which[0]).encode(text, add_special_tokens=False).ids


@cache
def fresh(name):
    return Tokenizer.from_file(public_path(name))


def test_wide_ids_are_not_cut():
    w = tokenfile.ShardWriter(io.BytesIO(), 2)
    w.add(1, np.array([70_000], "<u4"))
    with pytest.raises(ValueError, match="does not fit"):
        w.close()
    assert id_bytes(public_path("byte_bpe_50k.json")) == 2


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(0, 60000, rng.integers(0, 400)).astype("<u4")) for i in range(500)]
    out = io.BytesIO()
    w = tokenfile.ShardWriter(out, 2, frame_bytes=4000)
    for d in docs:
        w.add(*d)
    w.close()
    r = tokenfile.ShardReader(out)
    assert len(r.frames) > 5
    got = list(r.documents())
    assert [g[0] for g in got] == [d[0] for d in docs]
    assert all((a[2] == b[1]).all() for a, b in zip(got, docs, strict=True))
    assert [g[1] for g in got] == np.cumsum([0, *(len(d[1]) for d in docs)])[:-1].tolist()
    assert [x[0] for x in r.documents([3, 250])] == [3, 250]
    raw = bytearray(out.getvalue())
    raw[r.frames[1].start + 9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.ShardReader(io.BytesIO(bytes(raw))).documents())


def docs_frame(spark):
    rows = [(i, t, "src") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "s"), (5, None, "s"), (5, "twice", None), (5, "twice", None), (99, "long word " * 4000, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_token_files(spark):
    df = docs_frame(spark)
    got = sorted(tokenfile.token_digests(df, public_path("byte_bpe_50k.json"), "spaces").collect(), key=lambda r: r.start)
    e = Encoder(public_path("byte_bpe_50k.json"), "")
    want, at = [], 0
    for doc_id, text, _ in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        ids = e.encode(text or "") + bytes(4)
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert [tuple(r) for r in got] == want
    empty = df.limit(0)
    assert tokenfile.token_digests(empty, public_path("byte_bpe_50k.json"), "spaces").count() == 0


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 40), max_size=40))
def test_plan_places_every_piece_once(histogram):
    bins, seen = defaultdict(list), defaultdict(list)
    for n, a, b, s, per, off in packing.plan(histogram, 100):
        seen[n].append((a, b))
        for r in range(b - a):
            bins[s + r // per].append((off + r % per * n, n))
    for n, c in histogram.items():
        spans = sorted(seen[n])
        assert [x for a, b in spans for x in range(a, b)] == list(range(c))
    for held in bins.values():
        at = 0
        for off, n in sorted(held):
            assert off == at
            at += n
        assert at <= 100
        assert sum(3 * n > 100 for _, n in held) <= 2
    total = sum(n * c for n, c in histogram.items())
    if total:
        assert len(bins) <= 1.5 * max(-(-total // 100), sum(c for n, c in histogram.items() if 2 * n > 100)) + 1


def test_packing(spark):
    df = docs_frame(spark)
    got = packing.pack_documents(df, public_path("word_bpe_49k.json"), "words").collect()
    e = Encoder(public_path("word_bpe_49k.json"), "")
    want = []
    for doc_id, text, _ in df.collect():
        ids = e.encode(text or "") + bytes(4)
        want += [(doc_id, k, k * 2048, len(ids[x : x + 8192]) // 4, zlib.crc32(ids[x : x + 8192])) for k, x in enumerate(range(0, len(ids), 8192))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == [sum(n for o2, n in held if o2 < o) for o, _ in sorted(held)]
        assert sum(n for _, n in held) <= 2048
    assert packing.pack_documents(df.limit(0), public_path("word_bpe_49k.json"), "words").count() == 0


def test_packing_reaches_the_lower_bound_where_small_pieces_abound():
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(5.3, 1.0, 20_000).astype(int), 2, 2048)
    table = packing.plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), 2048)
    used = max(first + -(-(end - start) // per) for _, start, end, first, per, _ in table)
    assert used == -(-int(lengths.sum()) // 2048)
