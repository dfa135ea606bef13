import json
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
COUNT = tokens._counter(PATH)


def lib(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("ab 't\n<|endoftext|>é中", max_size=120)), max_size=6))
def test_counts_equal_the_library(texts):
    assert COUNT(texts) == lib(texts)


def test_overlapping_pairs_and_long_runs():
    texts = ["a" * n for n in (1, 2, 3, 4, 5, 63, 1000)] + ["<|endoftext|>x<|endoftext|>", "  \n\n  x", "日本語" * 200, "=" * 777, "\x00\x01"]
    assert COUNT(texts) == lib(texts)


def test_every_code_point():
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}'s a{c} 1{c}  {c} {c}" for c in map(chr, codes)]
    for at in range(0, len(texts), 200_000):
        mine, theirs = COUNT(texts[at : at + 200_000]), lib(texts[at : at + 200_000])
        assert mine == theirs, [hex(codes[at + i]) for i, (a, b) in enumerate(zip(mine, theirs)) if a != b][:9]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ab", "a", "aé中", "lo"])
def test_long_pre_tokens(letters, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(letters), n)) for n in (1, 2, 3, 50, 1500, 20_000)]
    assert COUNT(texts) == lib(texts)
    monkeypatch.setattr(tokens, "LONG_BYTES", 0)  # the same by the other form
    short = ["".join(rng.choice(list(letters), n)) for n in range(1, 60)] + ["hello", "the", "  "]
    assert tokens._counter(PATH)(short) == lib(short)


def test_a_line_of_a_megabyte():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1_000_000))
    begin = time.monotonic()
    assert COUNT([text]) == lib([text])
    assert time.monotonic() - begin < 60


def test_other_settings_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        at = tmp_path / "changed.json"
        at.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokens.BpeRanks(str(at))


def test_frame(spark):
    rows = [(1, "héllo  world", "x"), (1, "héllo  world", "x"), (2, None, None), (None, "", "y"), (3, "word " * 600, "n_tokens")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, PATH).collect()}
    n = lib([r[1] or "" for r in rows])
    assert got == {(r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n)}
    assert tokens.count_tokens(docs, PATH).count() == 5
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()}
    assert got == dict(zip(texts, lib(list(texts.values()))))
