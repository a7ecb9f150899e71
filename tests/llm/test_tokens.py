"""Encodings, counts and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm.bpe import Codec, encode_decode
from loamline.llm.token_counts import PieceCounter, token_counts
from loamline.llm.token_files import PerfectHash, Shard, distinct_keys, library_encoder, token_files, write_token_files

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIBRARY = tokenizers.Tokenizer.from_file(BPE)
CODEC, UNITS = Codec(BPE), library_encoder(BPE, "<u2")
PIECE = st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "\xa0", "'s", "é", "1", "!", "<|endoftext|>", "中", "\x1c", "und", " ", "\r\n", "😀", "İ", "͸", "\U0001fac8", "Ᲊ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join))
def test_encoding_is_the_library_s(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode([text])[0].tolist() == ids == UNITS([text])[0].tolist()
    assert CODEC.decode(np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_every_character_class(): 
    text = [f"a{c}1 {c}!{c}" for c in map(chr, [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 11)])]
    assert [x.tolist() for x in CODEC.encode(text)] == [e.ids for e in LIBRARY.encode_batch(text, add_special_tokens=False)]


def test_long_words():
    for text in ("ab" * 4000, "x" * 3000, "é" * 2000 + " " * 500 + "z"):
        assert CODEC.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_encode_decode_rows(docs, rows, none, clashing):
    def expected(r):
        ids = LIBRARY.encode(r[1] or "", add_special_tokens=False).ids
        return str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()

    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(docs, BPE).collect()) == sorted(map(expected, rows))
    assert encode_decode(none, BPE).count() == 0
    out = encode_decode(clashing, BPE, outputs=True).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["one two three", ""] and out[1].ids == []


def test_counts(docs, rows, none, clashing):
    library = PieceCounter(PIECES).library
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PIECES, limit=100, chunk=200, overlap=8).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 100) for r in rows)
    assert token_counts(none, PIECES).count() == 0 and token_counts(clashing, PIECES).count() == 2


def test_splices_of_odd_texts():
    counter, rng = PieceCounter(PIECES, 150, 10), random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", " ", "  ", "\n", "é", "中", "▁", "und ", "x" * 30, "😀", "<s>"]) for _ in range(rng.randint(200, 600))) for _ in range(60)]
    for text in [*texts, "a" * 3000, " " * 2000 + "b", "中" * 2000]:
        assert counter.count(text) == len(counter.library.encode(text))


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = [f"k{i}" for i in range(n)]
        index = PerfectHash.build(keys)
        assert sorted(index.lookup(keys).tolist()) == list(range(n))
    assert distinct_keys([1, 1, None, None, "n"]) == ["=1", "=1#1", "n", "n#1", "=n"]


def test_token_files(docs, rows, none, clashing, tmp_path):
    got = token_files(docs, BPE).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    ids = {r[0]: [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    start = 0
    for r in got:
        own = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert token_files(none, BPE).count() == 0 and token_files(clashing, BPE).count() == 2
    folder = f"file://{tmp_path}/shards"
    shards = write_token_files(docs, BPE, folder)
    held = [Shard(f"{folder}/shard-{s:06d}") for s, n, _ in shards if n]
    owner = next(s for s in held if "=5" in s.keys)
    assert owner.ids("=5").tolist() == ids[5] and all(s.ids("=123456") is None for s in held)
