import base64
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from cases import frame, texts
from tessella.llm import bpe

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public.PATTERN)


def test_matches_the_library_on_odd_texts(reference, codec):
    r = random.Random(1)
    pool = [chr(c) for c in [*range(1, 128), *range(0x80, 0x250), *range(0x3040, 0x3100), *range(0x1F600, 0x1F640), 0x2028, 0x85, 0xA0, 0x1C, 0x1F, 0x200B, 0x661, 0x300]]
    odd = ["".join(r.choice(pool) for _ in range(r.randint(0, 300))) for _ in range(150)] + ["", None, "a" * 5000, "'S don't  \n\n x", "<|endoftext|>"]
    for text, ids in zip(odd, codec.encode(odd)):
        assert ids.tolist() == reference.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_pieces_are_forgotten_without_harm(reference, codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    for _ in range(3):
        assert [x.tolist() for x in codec.encode(["one two three four", "five six"])] == [reference.encode_ordinary(x) for x in ("one two three four", "five six")]


def test_long_piece_and_small_matrices(reference, codec, monkeypatch):
    monkeypatch.setattr(bpe, "CELLS", 64)
    codec.forget()
    r = random.Random(2)
    long = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (9, 31, 64, 700)]
    assert [x.tolist() for x in codec.encode(long)] == [reference.encode_ordinary(x) for x in long]


def test_tables(spark, reference):
    docs = frame(spark, texts())
    ids = bpe.encode(docs, PATH, public.PATTERN, carry=("n_chars",))
    got = sorted(((r.doc_id, r.n_chars, tuple(r.ids)) for r in ids.collect()), key=str)
    assert got == sorted(((t[0], t[4], tuple(reference.encode_ordinary(t[1] or ""))) for t in texts()), key=str)
    back = bpe.decode(ids, PATH, public.PATTERN, carry=("n_chars",)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t[1] or "").encode() for t in texts())
    assert bpe.encode(frame(spark, []), PATH, public.PATTERN).count() == 0


def test_pair_table_finds_what_it_holds():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    table = bpe.PairTable(ranks)
    left, right = np.array([97, 256, 97, 98, 99, -1], np.int32), np.array([98, 99, 258, 99, 97, 98], np.int32)
    assert table.find(left, right).tolist() == [256, 257, 257, 258, bpe.NEVER, bpe.NEVER]
