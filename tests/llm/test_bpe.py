import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tallygrid.llm import bpe
from tests.llm.rows import LONG, ODD, documents

PATH = bpe.tokenizer_file()


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(json.loads(bpe.read_spec(PATH)))


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def same(own, library, text):
    wanted = library.encode(text, add_special_tokens=False).ids
    ids, decoded = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == wanted
    assert decoded == library.decode(wanted, skip_special_tokens=False) == own.decode(ids)


TEXTS = [
    "", "Hello, world's 123 É\nñ", "<|endoftext|> x<|startoftext|>y <|endoftext", "ΑΣ Σ", "it's DON'T İ ﬁ 日本 é",
    "'S 'LL 12 ½ ²", "𝔘nicode 😀😀 ﻿", " \t\n", "a" * 5000, "x" * 300 + "​\x00y　z", "\x1ca\x85b\x1f c", LONG,
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_equals_the_library(own, library, text):
    same(own, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=("Cn", "Co")), max_size=40))
def test_any_text_equals_the_library(own, library, text):
    same(own, library, text)


def test_leftmost_lowest_merge_of_many_words(own):
    """Against one merge after the other without a tree."""
    merger, rng = own.merger, np.random.default_rng(1)
    words = [bytes(rng.choice([97, 98, 101, 110, 116], rng.integers(1, 40)).astype(np.uint8)) for _ in range(300)]
    rank = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(merger.keys, merger.ranks, strict=True)}
    for word, got in zip(words, merger.encode(words), strict=True):
        ids = [int(merger.inside[x]) for x in word[:-1]] + [int(merger.ending[word[-1]])]
        while pairs := [(rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]:
            r, k = min(pairs)
            ids[k : k + 2] = [int(merger.made[r])]
        assert np.frombuffer(got, "<u4").tolist() == ids


def test_rows(spark, library):
    docs = documents(spark, ODD)
    wanted = []
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = bpe.op5_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
