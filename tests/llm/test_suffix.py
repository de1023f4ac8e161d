"""The suffix array against sorting, and passages against brute force."""

import hashlib
import random
import tempfile

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faktum.llm import induced, suffix


def order(symbols, memory, tmp):
    """Suffixes and common prefixes from the external sort, smallest first."""
    np.append(np.array(symbols, np.uint16), np.uint16(0)).tofile(f"{tmp}/text")
    parts = list(induced.suffixes(f"{tmp}/text", max(symbols, default=0) + 1, memory, str(tmp)))
    pos, common = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)])[::-1] for i in (0, 1))
    return pos.tolist(), [0, *common[:-1].tolist()] if len(pos) else []


def common_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 6), st.sampled_from([1, 1 << 10, 1 << 20]), st.sampled_from([2, 2048]))
def test_suffixes_and_common_prefixes(text, times, memory, one_digit):
    text = text * times
    want = sorted(range(len(text)), key=lambda i: text[i:])
    before, induced.ONE_DIGIT = induced.ONE_DIGIT, one_digit
    try:
        with tempfile.TemporaryDirectory() as tmp:
            got, common = order(text, memory, tmp)
    finally:
        induced.ONE_DIGIT = before
    assert got == want
    assert common == [common_prefix(text[a:], text[b:]) if i else 0 for i, (a, b) in enumerate(zip([0, *want[:-1]], want, strict=False))]


def test_a_text_far_larger_than_memory(tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    words = [rng.integers(97, 123, rng.integers(2, 9)) for _ in range(500)]
    text = np.concatenate([np.append(words[i], 32) for i in rng.zipf(1.4, 60_000) % 500])[:200_000]
    text[150_000:160_000] = text[20_000:30_000]
    memory, most, spilled = 16 << 10, [0], [0]
    put, spill = induced.Pool.put, induced.Pool._spill

    def watched(pool, x):
        run = put(pool, x)
        most[0] = max(most[0], pool.held)
        return run

    def counted(pool):
        spilled[0] += pool.held
        spill(pool)

    monkeypatch.setattr(induced.Pool, "put", watched)
    monkeypatch.setattr(induced.Pool, "_spill", counted)
    got, common = order(text.tolist(), memory, tmp_path)  # the text has 400 kB, its tuples have 4.4 MB
    assert most[0] <= memory and spilled[0] > 100 * memory
    raw = text.astype(np.uint8).tobytes()
    assert sorted(got) == list(range(len(raw)))
    for i in range(1, len(got)):
        a, b = raw[got[i - 1] : got[i - 1] + 5000], raw[got[i] : got[i] + 5000]
        n = common[i]
        assert a[:n] == b[:n] and (n == induced.CAP or a[n : n + 1] < b[n : n + 1])


def brute(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        off = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                off[p : p + length] = True
            seen.add(s)
        spans = sum(1 for j in range(len(b)) if off[j] and (j == 0 or not off[j - 1]))
        kept = bytes(c for c, o in zip(b, off, strict=True) if not o)
        out += [(i, len(b), int(off.sum()), spans, hashlib.sha256(kept).hexdigest())] * rows.count((i, t))
    return sorted(out)


def test_passages(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(2)
    shared = "".join(r.choice("abcde fghij é") for _ in range(400))
    docs += [(1000 + k, "".join(r.choice("xyz ") for _ in range(r.randrange(300))) + shared[r.randrange(150) : 250 + r.randrange(150)] + "tail" * k) for k in range(25)]
    docs += [(-1, None), (-2, ""), (-3, "a" * 1500), (-4, "ab" * 700), (2000, shared), (2000, shared), (2001, shared[:99])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(x) for x in suffix.passages(df).collect())
    assert got == brute(docs)
    assert suffix.passages(df.limit(0)).count() == 0
    clash = df.withColumn("body", F.lit(1)).withColumn("doc", F.lit("x")).withColumn("shard", F.lit(None)).unionByName(spark.createDataFrame([(None, shared, 1, "x", None), (None, None, 1, "x", None)], "doc_id long, text string, body int, doc string, shard void"))
    first = {tuple(x) for x in suffix.passages(clash).collect()}  # the null key comes first, so it keeps what others then lose
    assert (None, len(shared.encode()), 0, 0, hashlib.sha256(shared.encode()).hexdigest()) in first and (None, 0, 0, 0, hashlib.sha256(b"").hexdigest()) in first
    assert {x[2] for x in first if x[0] == 2000} == {len(shared.encode())}


def test_shards_are_dealt_by_bytes(spark):
    group = np.repeat(np.arange(200), 5)
    shard = suffix._shards(3 * suffix.TOGETHER, group, np.full(1000, 50, np.uint8), 3000)
    sizes = np.bincount(shard - (3 << 32), np.full(1000, 50 + suffix.LENGTH))
    assert len(sizes) == 50 and sizes.max() <= 3000 + 5 * (50 + suffix.LENGTH)
    assert all(len(set(shard[group == g].tolist())) == 1 for g in range(200))
    r = random.Random(5)
    shared = "".join(r.choice("abcde fghij") for _ in range(2000))
    docs = [(k, "".join(r.choice("xyz ") for _ in range(60)) + shared[(a := r.randrange(1500)) : a + 400]) for k in range(40)]
    docs.append((99, shared * 30))  # a long text that repeats itself
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in suffix.passages(df, shard_bytes=500, memory=16 << 10).collect()) == brute(docs)
