from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugework.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def machine():
    return bpe.Transducer(PATH, window=64)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(2)
    texts = ["", " ", "\n", "<|endoftext|>", "a<|endoftext|> <|endoftext|><|endoftext|>b", "<|endoftext", "I'll don't 'S 's", "x  y   \n\n z ",
             "日本語 テキスト ½²③ ٣٤ 👩‍👩‍👧 é é", "a" * 5000, "ab" * 3000 + "!", " " * 3000 + "x", "\n" * 2001, "é" * 2500, "0" * 3000, "=-" * 1500]
    texts += ["".join(rng.choice("etaoinshrdlucm") for _ in range(4000)) for _ in range(6)]
    texts += ["".join(rng.choice("-=_*#.,!") for _ in range(2000)) for _ in range(3)]
    texts += [" ".join("".join(rng.choice("etaoinsé'") for _ in range(rng.randint(1, 12))) for _ in range(30_000))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 600), rng.randrange(0x400, 0x3000), 32, 10])) for _ in range(200)) for _ in range(100)]
    return texts


def test_ids_and_text_are_those_of_the_library(machine, library):
    for text in odd_texts():
        wanted = library.encode(text, add_special_tokens=False).ids
        found = machine.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == wanted, text[:50]
        assert machine.decode(found, step=7) == library.decode(wanted, skip_special_tokens=False) == text


def test_lookahead_follows_from_the_merges():
    merges = [(b"a", b"b"), (b"ab", b"c"), (b"x", b"abc"), (b"y", b"z")]
    assert bpe.sufficient_lookahead(merges) == 3 + 4  # ab, then x: the border moves by three bytes; a token has up to four
    assert bpe.sufficient_lookahead([]) == 1


def test_broken_sequences_decode_like_the_library(machine, library):
    ids = np.array([machine.first[b] for b in [0xE2, 0x82, 0x41, 0xFF, 0xC3, 0xA9, 0xF0, 0x9F]], dtype="<u4")
    assert machine.decode(ids.tobytes(), step=1) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_documents(documents, library):
    rows = [(1, "some words"), (1, "some words"), (2, None), (3, ""), (4, "long " * 60_000), (None, "no id")]
    docs = documents(rows).withColumn("ids", F.lit("mine")).withColumn("_x", F.lit(1))
    out = bpe.encode_documents(docs, PATH)
    assert out.columns == [*[c for c in docs.columns if c != "ids"], "n_tokens", "ids", "decoded"]
    found = {(r.doc_id, r.text): r for r in out.collect()}
    for i, text in rows:
        wanted = np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert hashlib.sha256(found[i, text].ids).digest() == hashlib.sha256(wanted).digest()
        assert found[i, text].n_tokens == len(wanted) // 4 and found[i, text].decoded == (text or "")
    assert out.count() == len(rows)
    assert bpe.encode_documents(documents([]), PATH).count() == 0
