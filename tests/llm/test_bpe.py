"""The pair occurrence index against the tokenizers library."""

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faktum.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
CASES = ["", " ", "aaaaaaaaaaaa", "abab ababab", "it's they'll  we've\n\n x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "çéè ñ ßü 漢字 עברית 🙂🙂", "  x\u0085y\x1c\x1dz", "\t\n  a \r\n b  ", "12 345 ⅷ ½", "é ‍ ﻿", "no " * 4000, "x" * 5000]


def ids(text):
    memory = bpe.Memory(CODEC)
    import numpy as np

    numbers = [memory[p] for part in CODEC.pieces(text) for p in part]
    memory.learn()
    return memory.of(np.array(numbers, np.int64)).tolist()


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert CODEC.decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aabe tshn'\n.,1 ")), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want and CODEC.decode(want) == text


def test_operator(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*CASES, None])] + [(1, " ", "clash"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digest(df, PATH).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        x = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted((r.doc_id or -1, r.decoded) for r in back.collect()) == sorted((i or -1, t or "") for i, t, _ in rows)
    assert bpe.digest(df.limit(0), PATH).count() == 0


def test_long_texts_are_split_by_a_running_match(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 200)
    text = "Some words, it's 12 345\n\n  and <|endoftext|> more words " * 400
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    huge = "word number seven " * 70_000  # over LONG_TEXT as it is in production
    monkeypatch.undo()
    assert len(huge) > bpe.LONG_TEXT and ids(huge) == LIBRARY.encode(huge, add_special_tokens=False).ids
