import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tierline.llm import bpe_chunks as b

PATH = public_tokenizers.path(b.VOCABULARY)
ODD = [
    None, "", " ", "\n\t", "a", "It's they'll DON'T 'S 12345 ½ ４２", "é ́x ̸ ≠", "ΑΣ ΣΑΣ İstanbul ẞ", " a  b c\x85d\x1ce",
    "x<|endoftext|>y <|startoftext|>", "<| endoftext|>", "👩‍👩‍👧 ﻿​漢字かな", "a" * 5000, "\x00\x01\x7f", "</w> <w>", "ऩ क्", "\x0b\x0c v",
]


def texts():
    rng = random.Random(1)
    alphabet = "abcdefgh éßñ  \n\t'12.,!-ΣABC漢́"
    passage = "".join(rng.choices(alphabet, k=3000))
    out = list(ODD)
    for _ in range(25):
        own = "".join(rng.choices(alphabet, k=rng.randint(0, 400)))
        out.append(own + passage[rng.randint(0, 500) :] + own[::-1])
    return out + ["word " * 4000, passage, passage, "no-blank" * 3000 + " end"]


@pytest.mark.parametrize("bits", [0, 2, 5, 8])
def test_agrees_with_the_library(bits):
    assert all(b.agrees(PATH, t or "", bits) for t in texts())


def test_documents_and_decode(spark, documents):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    docs = documents([*rows, rows[20], (None, "null id", None)])
    encoded = b.encode(docs, PATH).cache()
    whole = Tokenizer.from_file(PATH)
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    got = encoded.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            want = ids[r.doc_id]
            assert (r.n_tokens, list(r.ids)) == (len(want), want)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(whole.decode(want, skip_special_tokens=False).encode()).hexdigest()
    for r in b.decode(encoded, PATH).collect():
        if r.doc_id is not None:
            assert r.text == whole.decode(ids[r.doc_id], skip_special_tokens=False)


def test_shared_chunks_are_encoded_once(spark, documents):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choices("abcde", k=5)) for _ in range(2000))
    docs = documents([(i, f"{i} {i} " * 40 + passage, "en") for i in range(6)])
    common = b.common_chunks(docs, PATH)
    assert len(common) > 20
    encoder = b.Encoder(PATH, common)
    for r in docs.collect():
        encoder.encode(r.text)
    assert encoder.reused > 5 * encoder.encoded
    assert b.common_chunks(docs, PATH, most=3).keys() <= common.keys()


def test_equal_passages_are_cut_alike():
    rng = random.Random(4)
    passage = bytes(rng.choices(range(97, 110), k=5000))
    one, two = b.cuts(passage), b.cuts(b"something before " + passage)
    assert {c + 17 for c in one[1:]} <= set(two)


def test_empty_table(spark, documents):
    assert b.encode(documents([]), PATH).count() == 0
