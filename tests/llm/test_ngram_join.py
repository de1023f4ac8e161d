"""Links of sets against all pairs, through the operator and through signatures alone."""

import random

import numpy as np

from faktum.llm import ngram_join as nj


def brute(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_near_groups(spark):
    r = random.Random(5)
    rows = [(-1, None), (-2, ""), (-3, " \t"), (-4, "one two"), (-5, "One  TWO"), (-6, "a b c d e"), (7, "a b c d e f"), (7, "a b c d e f")]
    passage = [f"p{i}" for i in range(60)]
    for base in range(12):
        n = r.choice([6, 12, 30, 80, 200, 500])
        words = [f"w{r.randrange(5000)}" for _ in range(n)] + (passage if base % 3 == 0 else [])
        for k in range(12):
            own = list(words)
            for _ in range(r.randrange(1 + n // 25)):
                own[r.randrange(len(own))] = f"x{r.randrange(9999)}"
            if k % 4 == 3:
                own = own[: int(len(own) * r.uniform(0.75, 1))]
            rows.append((100 * base + k + 10, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in nj.near_groups(df).collect()) == brute(rows)
    assert nj.near_groups(df.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        drop, add = (int(rng.integers(0, n // 5 + 1)) for _ in range(2))
        b = np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if shared * 100 >= 80 * (len(a) + len(b) - shared):
            assert np.intersect1d(nj.signatures(a), nj.signatures(b)).size, (len(a), len(b), shared)


def test_keep_one_tells_texts_of_one_key_apart(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (4, "x y z"), (4, "x y z"), (None, a + " last"), (None, "p q r")]
    left = [tuple(r) for r in nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of_c = [r for r in left if r[0] == 3]
    assert len(of_c) == 1 and of_c[0] in rows
    assert sorted((r for r in left if r[0] != 3), key=str) == sorted([(1, a), (2, b), (4, "x y z"), (None, "p q r")], key=str)


def test_words_that_differ_hash_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, other), (3, f"{word} x"), (4, f"{other} x")]
    assert sorted(tuple(x) for x in nj.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(i, 1, i) for i in (1, 2, 3, 4)]


def test_group_of_near_copies_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nj, "COMPARED", 4)
    r = random.Random(8)
    rows = []
    for base in range(6):  # a shared half links some of these, in chains, and leaves others apart
        words = [f"w{r.randrange(90)}" for _ in range(120)]
        for k in range(14):
            own = list(words)
            for _ in range(r.randrange(5)):
                own[r.randrange(120)] = f"x{r.randrange(999)}"
            rows.append((100 * base + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in nj.near_groups(df).collect()) == brute(rows)


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, 6, 7, "x"), (2, "a b c d e f g", 5, None, 7, "y"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ int, key int, cls int, component_id string")
    assert sorted(tuple(x) for x in nj.keep_one(df).collect()) == [rows[0], rows[1], rows[2]]
    assert nj.keep_one(df.limit(0)).columns == df.columns
