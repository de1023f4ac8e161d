"""Exact parts and the model against brute force; the filter's levels; probabilities that sum to one; junk below prose."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from faktum.llm import lm


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(rows):
    toks = [[*words_of(t), None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for x, h in zip(toks, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return sorted((i, h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for (i, _), x, h in zip(rows, toks, held, strict=True))


class Brute:
    """The model of some texts from dictionaries of exact counts, each rounded as the filter rounds it."""

    def __init__(self, texts):
        self.grams, letters = [Counter(), Counter(), Counter()], Counter()
        for t in texts:
            w = ["<s>", "<s>", *words_of(t), None]
            for k in range(3):
                self.grams[k].update(tuple(w[i - k : i + 1]) for i in range(2, len(w)))
            for x in w[2:-1]:
                letters.update(zip(b" " + x.encode(), x.encode() + b" ", strict=True))
        self.low = lambda n, k: float(lm.at_least(lm.levels(np.array([n]), k), k)[0])
        self.high = lambda n, k: float(lm.at_most(lm.levels(np.array([n]), k), k)[0])
        self.texts, self.mass = len(texts), sum(self.low(n, 0) for n in self.grams[0].values())
        self.k = []
        for k in (0, 1):
            followers, by = Counter(g[:-1] for g in self.grams[k + 1] if g[-2] != "<s>"), defaultdict(list)
            for c, n in followers.items():
                # a pair at a text's start is counted with the start before it
                by[int(lm.levels(np.array([self.grams[k][c]]), k)[0])].append(n)
            means, last = [], 1.0
            for level in range(lm.MOST):
                last = float(np.mean(by[level])) if level in by else last
                means.append(last)
            self.k.append(means)
        self.new = min(0.5, max(1, sum(n == 1 for n in self.grams[0].values())) / (sum(self.grams[0].values()) + 1))
        self.letters, self.rows = letters, Counter()
        for (a, _), n in letters.items():
            self.rows[a] += n

    def spelled(self, word):
        """By letters: every byte but the five controls may follow, and a space only behind a letter."""
        out = 1.0
        for a, b in zip(b" " + word.encode(), word.encode() + b" ", strict=True):
            out *= (self.letters[a, b] + 1) / (self.rows[a] + (250 if a == 32 else 251))
        return out

    def p(self, w, u, v):
        p = (1 - self.new) * self.low(self.grams[0][(w,)], 0) / self.mass + (self.new * self.spelled(w) if w else 0)
        for k, context in ((1, (v,)), (2, (u, v))):
            often = self.texts if v == "<s>" else self.grams[k - 1][context]
            if often:
                more = self.k[k - 1][int(lm.levels(np.array([often]), k - 1)[0])]
                own = self.low(self.grams[k][*context, w], k) if self.grams[k - 1][(u, v, w)[3 - k :]] else 0
                p = (own + more * p) / (self.high(often, k - 1) + more)
        return p

    def score(self, text):
        w = ["<s>", "<s>", *words_of(text), None]
        return sum(math.log10(self.p(w[i], w[i - 2], w[i - 1])) for i in range(2, len(w)))


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "Zz  zz\tZZ"), (-3, "Zz  zz\tZZ"), (-3, "other"), (-4, "word " * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, owner int, _text double")
    got = lm.score(df, owned=50_000).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    model = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    texts, off = dict(rows), []
    for r in got:
        if r.doc_id != -3:
            off.append(abs(r.score - model.score(texts[r.doc_id])) / r.n_tokens)
    assert np.mean(off) < 0.02 and np.median(off) < 0.01  # the filter's false hits
    assert lm.score(df.limit(0)).count() == 0
    none = lm.score(df.filter("doc_id = 15"), owned=50_000).collect() if zlib.crc32(b"15") % 7 == 2 else []
    assert all(r.score == 0 for r in none)


def test_probabilities_sum_to_one_at_most():
    model = Brute(["a b a c", "b a a", "c a b b a", "d"])
    for u, v in (("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("b", "a"), ("x", "a"), ("x", "y")):
        known = sum(model.p(w, u, v) for w in ("a", "b", "c", "d", None))
        assert 0.5 < known <= 1 + 1e-9
        spelled = sum(model.spelled(w) for w in ("a", "b", "c", "d"))
        assert known + model.new * (1 - spelled) * (model.p("zz", u, v) / (model.new * model.spelled("zz"))) <= 1 + 1e-9
    assert sum(model.spelled(chr(i)) for i in range(33, 127)) < 1
    letters = np.zeros(1 << 16, np.int64)
    for (a, b), n in model.letters.items():
        letters[a * 256 + b] = n
    table = lm.Totals([{"tokens": 1, "types": 1, "singles": 1, "mass": 1.0, "ends": 1, "followers": np.zeros(4 * lm.MOST, np.int64).tobytes(), "letters": zlib.compress(letters.tobytes())}])
    assert np.allclose(np.exp(table.letters[[97, 32, 200]]).sum(1), 1)
    _, _, words = lm.tokens([b"ab c", b"zz"])
    assert np.allclose(np.exp(table.spelled(words)), [model.spelled(w) for w in ("ab", "c", "zz")])


def test_junk_scores_below_prose_and_known_words_gain(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    r, extra = random.Random(3), []
    prose = [(i, t) for i, t in docs if t and len(t.split()) > 50 and zlib.crc32(str(i).encode()) % 7 == 2][:40]
    held = iter(k for k in range(10**6, 10**7) if zlib.crc32(str(k).encode()) % 7 == 2)
    for _, t in prose:
        w = t.split()
        r.shuffle(w)
        extra.append((next(held), " ".join(w)))
        extra.append((next(held), " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in x) for x in t.split())))
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(docs + extra, "doc_id long, text string")).collect()}
    mean = lambda ids: np.mean([got[i].score / got[i].n_tokens for i in ids])
    real, shuffled, random_ = mean([i for i, _ in prose]), mean([i for i, _ in extra[::2]]), mean([i for i, _ in extra[1::2]])
    assert real > shuffled + 0.1 and shuffled > random_ + 2
    tests = [x for x in got.values() if x.held_out and x.doc_id < 10**6]
    unknown = np.log10(1 / (tests[0].train_tokens + 1))
    known_base = sum(x.base_score for x in tests) - sum(x.n_tokens - x.n_known for x in tests) * unknown
    assert sum(x.known_score for x in tests) > known_base


def test_filter_levels():
    n = np.arange(1, 3001)
    h = lm.mix(n.astype(np.uint64))
    part = lm.part_of([(h, lm.levels(n, 0)), (h, lm.levels(n, 1)), (h[:0], n[:0])])
    assert np.unpackbits(part).mean() < lm.FILL + 0.02
    for k, most in ((0, 0.26), (1, 0.51)):
        level = lm.level_of(part, k, h)
        assert (level >= lm.levels(n, k)).all() and (level == lm.levels(n, k)).mean() > 0.95
        exact = lm.levels(n, k)
        assert (lm.at_least(exact, k) <= n).all() and (lm.at_most(exact, k) >= n).all() and (lm.at_most(exact, k) <= n * 2**most + 1).all()
    assert (lm.level_of(part, 2, h) > 0).mean() < 0.002


def test_filter_grows_with_the_corpus(spark):
    def sizes(n):
        docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 500)),) for k in range(0, n, 500)], "text string")
        rows = lm.parts(docs, "text", 3).collect()
        assert all(np.unpackbits(np.frombuffer(r.bits, np.uint8)).mean() < lm.FILL + 0.1 for r in rows)
        return sum(len(r.bits) for r in rows)

    assert 9 < sizes(50000) / sizes(5000) < 11


def peak(f):
    """The result of f, and the MB of memory it took at most beside what was there."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50_000, 2500)) for _ in range(500)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    (most, rows), mb = peak(lambda: (lambda sizes: (max(sizes), len(sizes)))([b.nbytes for b in lm._counts([batch], "text", 13)]))
    assert mb < 110 and most < 3e6 and rows > 10
    h = lm.mix(np.arange(1, 800_001, dtype=np.uint64))
    none = (h[:0], np.zeros(0, np.int64))
    part, mb = peak(lambda: lm.part_of([none, (h, np.ones(len(h), np.int64)), none]))
    assert mb < 60
    level, mb = peak(lambda: lm.level_of(part, 1, h))
    assert mb < 40 and (level >= 1).all()


def test_rows_go_to_python_by_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 500) AS text"), spark.conf.get(name)
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    with lm.small_batches(spark):
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 1.1 * lm.SENT
    assert spark.conf.get(name) == before
