"""Forward-backward against enumeration, and held-out accuracy."""

import itertools
import zlib

import numpy as np

from faktum.llm import langid


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    evidence, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    p, pairs, log_z = langid.forward_backward(evidence, moves, np.array([0, 4]), np.array([4, 3]), learning=True)
    want, moved = np.zeros((7, 3)), np.zeros((3, 3))
    for k, (begin, n) in enumerate(((0, 4), (4, 3))):
        total = 0.0
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(evidence[begin + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))) / 3
            total += w
            for t, y in enumerate(path):
                want[begin + t, y] += w
        want[begin : begin + n] /= total
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(evidence[begin + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))) / 3 / total
            for a, b in itertools.pairwise(path):
                moved[a, b] += w
        assert np.isclose(np.log(total), log_z[k])
    assert np.allclose(p, want) and np.allclose(pairs, moved)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 ?! ... 34", "en"), (-4, "the and of the is", None), (-4, "the and of the is", None), (None, "der die und ein nicht", None)], docs.schema)
    got = langid.language_id(docs.unionByName(odd)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(got) == len(truth) + 6 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (-1, -2, -3))
    assert by[-4].lang_pred == "en" and by[None].lang_pred == "de" and sum(r.doc_id == -4 for r in got) == 2


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.language_id(empty).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.language_id(one).collect()] == [("und", 0.0)]


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    words = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[name], 20)), name) for i, name in enumerate(sorted(words) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.language_id(df).collect()}
    assert len(set(got.values())) == 70
    assert sum(got[i] == name for i, _, name in rows) >= 0.95 * len(rows)


def test_pieces_of_a_chain_give_the_whole_chain(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["aa", "bb", "ab", "ba", "c"], n)).encode() for n in (1, 0, 9, 40, 41, 3)]
    labels = [[(int(rng.integers(2)), 1)] * len(t.split()) for t in texts]
    model = {"names": ["x", "y"], "bias": np.zeros(2, np.float32), "lexicon": rng.normal(size=(langid.LEXICON, 2)).astype(np.float32), "grams": [rng.normal(size=(langid.GRAMS, 2)).astype(np.float32) for _ in langid.LENGTHS], "moves": rng.normal(size=(2, 2)).astype(np.float32)}
    results = []
    for size in (1, 4, 1000):
        monkeypatch.setattr(langid, "CHAIN", size)
        part = langid.Part(texts, labels, 2)
        p, pairs, log_z = langid.forward_backward(part.f.evidence(model), model["moves"], part.begin, part.length, part.follows, learning=True)
        results.append((p, pairs, log_z.sum(), part.moved, part.likelihood(model)))
    for other in results[:-1]:
        assert all(np.allclose(a, b) for a, b in zip(other, results[-1], strict=True))


def test_slopes_against_differences():
    rng = np.random.default_rng(7)
    texts = [b"aa bb aa c", b"bb ab", b"c c ba"]
    part = langid.Part(texts, [[(0, 2), (1, 2)], [(1, 2)], [(0, 3)]], 2)
    model = {"names": ["x", "y"], "bias": rng.normal(size=2), "lexicon": rng.normal(size=(langid.LEXICON, 2)), "grams": [rng.normal(size=(langid.GRAMS, 2)) for _ in langid.LENGTHS], "moves": rng.normal(size=(2, 2))}
    bias, moves, lexicon, grams = np.zeros(2), np.zeros((2, 2)), np.zeros((langid.LEXICON, 2)), [np.zeros((langid.GRAMS, 2)) for _ in langid.LENGTHS]
    part.gradient(model, np.ones(2), bias, moves, lexicon, grams)
    places = [(model["bias"], bias, (0,)), (model["moves"], moves, (0, 1)), (model["moves"], moves, (1, 1)), (model["lexicon"], lexicon, (int(part.f.lexicon[1]), 1)), (model["grams"][0], grams[0], (int(part.f.grams[0][2]), 0))]
    for table, slope, at in places:
        start, h, ends = table[at], 1e-2, []
        for d in (h, -h):
            table[at] = start + d
            ends.append(part.likelihood(model))
        table[at] = start
        assert np.isclose((ends[0] - ends[1]) / (2 * h), slope[at], rtol=2e-2, atol=1e-3)


def test_code_switched_and_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null").select("text", "lang").collect()
    by = {}
    for r in docs:
        if r.text and len(r.text.split()) > 40:
            by.setdefault(r.lang, []).append(r.text.split()[:40])
    model = langid.fit([" ".join(w).encode() for v in by.values() for w in v[:60]], [k for k, v in by.items() for w in v[:60]])
    assert all(model["moves"][i, i] > model["moves"][i].mean() for i in range(len(by)))
    names = model["names"]
    right = total = 0
    for a, b in itertools.permutations(names, 2):
        one, other = by[a][-1], by[b][-1]
        words = one[:20] + other[:20]
        _, p = langid.label_words(model, [" ".join(words).encode()])
        assert len(p) == 40
        right += sum(names[k] == (a if i < 20 else b) for i, k in enumerate(p.argmax(1).tolist()))
        total += 40
    assert right >= 0.9 * total
    a, b = names[:2]
    long = (by[a][0] * 60 + by[b][0] * 20) * 2  # 6,400 words, three quarters in one language
    langs, scores = langid.predict(model, [" ".join(long).encode()])
    assert langs == [a] and 0.65 < scores[0] < 0.85


def test_keep_identified_with_clashing_columns(spark):
    rows = [(i, "the and of the is it", "en", 1, 2, "x") for i in range(6)] + [(i, "der die und ein nicht das", "de", 1, None, "y") for i in range(6, 12)] + [(20, None, "en", 3, 4, "z"), (21, "12 34", None, 3, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text int, identified_ int, order string")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == rows[:12]
    assert langid.keep_identified(df.limit(0)).count() == 0
