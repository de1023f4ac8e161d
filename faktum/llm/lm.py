"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words, pairs and triples of words: readers count what they have and send it to owners of hash ranges; an owner
adds up and makes its part of the filter. A count is stored as its level, about its logarithm: the n-gram is inserted once with
each number from 1 to its level, so that a reader gets the level by probing 1, 2, ... until a probe fails. The first level has
more probes, so that an n-gram that wasn't seen is hardly ever found. A part has as many bits as leave FILL of them set, so the
filter grows with the corpus and no n-gram is left out.

The filter as a whole has no size bound, so it isn't broadcast: parts stay with their owners. Each portion of texts asks the owners
for its n-grams, and owners answer with levels, and with exact counts of words for the base score alone. The portion
itself goes to its home, where answers are put together. Documents are scored in SLICES, one after the other, which bounds what is
under way at a time.

Probabilities are smoothed after Witten and Bell: P(w | h) = (count(hw) + k P(w | shorter h)) / (count(h) + k), with counts of
n-grams rounded down to their levels and counts of contexts rounded up, so that they sum to one at most. k is how many
different words follow a context that is seen as often, on average over all contexts of that level in the training texts. At the end
stand the words' own shares; the share of words seen once goes to new words, by the letters: a table of which byte follows
which, from all words of the training texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktum.llm.store import owners_for, released, saved
from faktum.llm.textkit import Words, grouped, mix, texts_of, trim

#: Share of bits that may be set; probes for the first level by words in the n-gram, and for each other level.
FILL, FIRST, PROBES = 0.3, (8, 12, 6), 3
#: Tokens whose counts a reader gathers before it sends them; bytes of texts whose n-grams an owner gets, about; slices of documents.
GATHERED, OWNED, SLICES = 1 << 19, 8 << 20, 4
#: Bytes of texts in a portion that is scored, and in one that is counted; bytes of counts that a reader sends at a time.
PORTION, COUNTED, SENT = 2 << 20, 1 << 20, 1 << 20
#: N-grams whose bits, and letters whose pairs, are worked out together.
GRAMS, LETTERS = 1 << 15, 1 << 18
#: Levels to a doubling of the counts of words, pairs and triples; the most levels there are.
STEPS, MOST = (4, 2, 2), 250
END, START, _PAIR, _TRIPLE = np.uint64(0xE1D0_0000_0000_0001), np.uint64(0x57A2_0000_0000_0001), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 40) - 1)
_SPACE = np.arange(256)
_SPACE[[9, 10, 11, 12, 13]] = 32


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of all texts' words, each text's followed by END; where each text's begin (one more at the end); the words."""
    words = Words(texts, lower=True)
    n = np.diff(words.first)
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(words.h)) + np.repeat(np.arange(len(n)), n)] = words.h
    return out, first, words


def ngrams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: the pair and the triple that it ends; before a text stand two STARTs."""
    before = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h.copy()
    before[first[:-1]] = START
    pair = mix(before * _PAIR + h)
    two = np.concatenate((np.zeros(1, np.uint64), pair[:-1])) if len(h) else h.copy()
    two[first[:-1]] = START
    return pair, mix(two * _TRIPLE + h)


def owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)


def _cuts(owner: np.ndarray, owners: int) -> list[tuple[int, int, int]]:
    """(owner, from, to) of each owner's part of what is in order of owners."""
    cut = np.searchsorted(owner, np.arange(owners + 1)).tolist()
    return [(o, cut[o], cut[o + 1]) for o in range(owners) if cut[o] < cut[o + 1]]


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(blobs: list[bytes]) -> np.ndarray:
    five = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view(np.uint64)[:, 0]


_COUNTED = ["owner", "words", "word_counts", "pairs", "pair_counts", "triples", "triple_counts", "letters", "followers"]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], _COUNTED)


def _counts(batches, text: str, owners: int):
    """An owner's words, pairs and triples with their counts; for owner 0 the letters, and the contexts and their followers by level."""
    held: list[tuple[np.ndarray, ...]] = []
    letters = np.zeros(1 << 16, np.int64)
    size = 0

    def flush():
        grams, spans = [], {0: [(0, 0)] * 3}
        followers = np.zeros((2, 2, MOST), np.int64)
        first_token = np.concatenate([x[3] for x in held])
        for k in range(3):
            every = np.concatenate([x[k] for x in held])
            h, back, n = np.unique(every, return_inverse=True, return_counts=True)
            for o, a, b in _cuts(owner_of(h, owners), owners):
                spans.setdefault(o, [(0, 0)] * 3)[k] = (a, b)
            grams.append((h, n.astype(np.uint32)))
            if k:  # the context of each different n-gram is what ends one token before it; starts of texts apart
                at = np.empty(len(h), np.int64)
                at[back] = np.arange(len(back))
                inner = at[~first_token[at]] - 1
                different = np.bincount(context_of[inner], minlength=len(context_n))
                level = levels(context_n, k - 1)
                some = different > 0
                followers[k - 1] += np.stack([np.bincount(level[some], w, MOST).astype(np.int64) for w in (np.ones(some.sum()), different[some])])
            context_of, context_n = back, n
        held.clear()
        del every, back, context_of, context_n, at, inner
        rows, size = [], 0
        for o, own in spans.items():
            row = [x for k, ((h, n), (a, b)) in enumerate(zip(grams, own, strict=True)) for x in (_five(h[a:b]) if k else h[a:b].tobytes(), n[a:b].tobytes())]
            row += [b"", b""] if o else [zlib.compress(letters.tobytes(), 1), followers.tobytes()]
            rows.append((o, *row))
            size += sum(map(len, row))
            if size >= SENT:
                yield _sent(rows)
                rows, size = [], 0
        if rows:
            yield _sent(rows)

    for _, texts in grouped(batches, text, COUNTED):
        h, first, words = tokens(texts)
        starts = np.zeros(len(h), bool)
        starts[first[:-1]] = True
        held.append((h, *ngrams(h, first), starts))
        for i in range(0, len(words.buf) - 1, LETTERS):
            buf = _SPACE[words.buf[i : i + LETTERS + 1]]
            letters += np.bincount(buf[:-1] * 256 + buf[1:], minlength=1 << 16)
        size += len(h)
        del h, first, words, starts
        if size >= GATHERED:
            yield from flush()
            letters, size = np.zeros(1 << 16, np.int64), 0
    if size:
        yield from flush()


def levels(n: np.ndarray, k: int) -> np.ndarray:
    """The level of each count of an n-gram of k + 1 words, rounded down; 0 for none."""
    n = np.asarray(n, np.float64)
    return np.where(n > 0, np.floor(STEPS[k] * np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


def at_least(level: np.ndarray, k: int) -> np.ndarray:
    """The smallest count (a whole number) at a level."""
    return np.where(level > 0, np.ceil(2.0 ** ((level - 1) / STEPS[k]) - 1e-9), 0.0)


def at_most(level: np.ndarray, k: int) -> np.ndarray:
    """The largest count at a level."""
    return np.where(level > 0, np.maximum(np.ceil(2.0 ** (level / STEPS[k]) - 1e-9) - 1, 1), 0.0)


def bits_of(h: np.ndarray, k: int, level: int, bits: int) -> np.ndarray:
    """The bit numbers of (n-gram of k + 1 words, level) in a part of so many bits."""
    a = mix((h & _LOW) + np.uint64((k << 56) + (level << 44)))
    b = mix(a) | np.uint64(1)
    out = np.empty((FIRST[k] if level == 1 else PROBES, len(h)), np.int64)
    for i in range(len(out)):  # the upper half of each hash, scaled to the part
        out[i] = (a >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
        a += b
    return out


def part_of(grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The filter with (hashes, levels) of words, pairs and triples, as packed bits."""
    set_bits = sum(float(FIRST[k] * (level > 0).sum() + PROBES * np.maximum(level - 1, 0).sum()) for k, (_, level) in enumerate(grams))
    bits = max(64, (int(set_bits / -np.log(1 - FILL)) + 8) // 8 * 8)
    part = np.zeros(bits, bool)
    for k, (h, level) in enumerate(grams):
        for j in range(1, int(level.max(initial=0)) + 1):
            h, level = h[level >= j], level[level >= j]
            for a in range(0, len(h), GRAMS):
                part[bits_of(h[a : a + GRAMS], k, j, bits).ravel()] = True
    return np.packbits(part)


def level_of(part: np.ndarray, k: int, h: np.ndarray) -> np.ndarray:
    """The level of each n-gram of k + 1 words in a part, 0 if it isn't there."""
    level = np.zeros(len(h), np.uint8)
    for a in range(0, len(h), GRAMS):
        on, j = np.arange(a, min(a + GRAMS, len(h))), 0
        while len(on) and j < MOST:
            j += 1
            at = bits_of(h[on], k, j, 8 * len(part))
            on = on[((part[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)]
            level[on] = j
    return level


def _add_up(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return h[begin], np.add.reduceat(n, begin) if len(h) else n


def _part(table: pa.Table) -> pa.Table:
    """An owner's part of the filter, and its words with their exact counts for the base score."""
    column = lambda name: [x for x in table.column(name).to_pylist() if x]
    numbers = lambda name, kind: np.frombuffer(b"".join(column(name)), kind)
    h, n = _add_up(numbers("words", np.uint64), numbers("word_counts", np.uint32))
    grams = [(h, levels(n, 0))]
    for k, name in ((1, "pair"), (2, "triple")):
        own, count = _add_up(_from_five(column(f"{name}s")), numbers(f"{name}_counts", np.uint32))
        grams.append((own, levels(count, k)))
    letters = sum((np.frombuffer(zlib.decompress(x), np.int64) for x in column("letters")), np.zeros(1 << 16, np.int64))
    followers = sum((np.frombuffer(x, np.int64) for x in column("followers")), np.zeros(4 * MOST, np.int64))
    row = {"owner": pa.array([table.column("owner")[0].as_py()], pa.int32()), "tokens": [int(n.sum())], "types": [len(h)], "singles": [int((n == 1).sum())], "mass": [float(at_least(grams[0][1], 0).sum())], "ends": [int(n[h == END].sum())], "letters": [zlib.compress(letters.tobytes()) if letters.any() else b""], "followers": [followers.tobytes()], "bits": [part_of(grams).tobytes()], "words": [h.tobytes()], "counts": [n.tobytes()]}
    trim()
    return pa.table(row)


_PART = "owner int, tokens long, types long, singles long, mass double, ends long, letters binary, followers binary, bits binary, words binary, counts binary"


class Totals:
    """What every worker has of the model: sums over all of the training texts, and the tables of letters and of followers."""

    def __init__(self, rows: list) -> None:
        self.tokens, self.types, self.singles, self.texts = (sum(r[k] for r in rows) for k in ("tokens", "types", "singles", "ends"))
        self.mass = sum(r["mass"] for r in rows)
        letters = sum((np.frombuffer(zlib.decompress(r["letters"]), np.int64) for r in rows if r["letters"]), np.zeros(1 << 16, np.int64)).reshape(256, 256) + 1.0
        letters[32, 32] = 0  # a word has a letter
        letters[:, [9, 10, 11, 12, 13]] = 0
        self.letters = np.log(np.maximum(letters, 1e-300)) - np.log(letters.sum(1, keepdims=True))
        counted = sum((np.frombuffer(r["followers"], np.int64) for r in rows), np.zeros(4 * MOST, np.int64)).reshape(2, 2, MOST)
        self.followers = [self._mean(*counted[k]) for k in (0, 1)]

    @staticmethod
    def _mean(contexts: np.ndarray, different: np.ndarray) -> np.ndarray:
        """How many different followers a context of each level has; levels that no reader met have those of the next lower one."""
        out, last = np.ones(MOST), 1.0
        for i in range(MOST):
            last = different[i] / contexts[i] if contexts[i] else last
            out[i] = last
        return out

    def spelled(self, words: Words) -> np.ndarray:
        """The natural log of each word's probability by its letters and the space behind it."""
        total = np.zeros(len(words.buf) + 1)
        for i in range(0, len(words.buf) - 1, LETTERS):
            buf = _SPACE[words.buf[i : i + LETTERS + 1]]
            total[i + 2 : i + 1 + len(buf)] = total[i + 1] + np.cumsum(self.letters[buf[:-1], buf[1:]])
        return total[words.ends + 1] - total[words.starts]

    def log10(self, spelled: np.ndarray, starts: np.ndarray, levels_of: list[np.ndarray]) -> np.ndarray:
        """log10 of each token's probability, from its spelling (-inf for the end) and the levels of its word, pair and triple."""
        if not self.tokens:
            return np.zeros(len(spelled))
        new = min(0.5, max(1.0, self.singles) / (self.tokens + 1))
        with np.errstate(divide="ignore"):
            log = np.logaddexp(np.log1p(-new) + np.log(at_least(levels_of[0], 0)) - np.log(self.mass), np.log(new) + spelled)
            for k in (1, 2):
                # the context is the word or pair that the token before ends; a text's first token has all texts' starts
                level = np.concatenate((levels_of[k - 1][:1], levels_of[k - 1][:-1])).astype(np.int64)
                level[starts] = int(levels(np.array([self.texts]), k - 1)[0])
                often, more = at_most(level, k - 1), self.followers[k - 1][level]
                own = np.where(levels_of[k - 1] > 0, at_least(levels_of[k], k), 0.0)  # what has no shorter part is a false hit
                longer = np.logaddexp(np.log(own), np.log(more) + log) - np.log(often + more)
                log = np.where(level > 0, np.minimum(longer, 0.0), log)
        return log / np.log(10)


def _look_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The value of each h by keys in order, 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0)


def parts(docs: DataFrame, text: str = "text", owners: int = 1) -> DataFrame:
    """The owners' parts of the model of the texts of docs, one row each."""
    kinds = ", ".join(f"{c} binary" for c in _COUNTED[1:])
    return docs.select(text).mapInArrow(lambda b: _counts(b, text, owners), f"owner int, {kinds}").groupBy("owner").applyInArrow(_part, _PART)


class Questions:
    """What a portion of texts has to ask: its words, pairs and triples, each in order (of owners too), and where its tokens find them."""

    def __init__(self, h: np.ndarray, first: np.ndarray, owners: int) -> None:
        self.asked, self.back = [], []
        for gram in (h, *ngrams(h, first)):
            gram, back = np.unique(gram, return_inverse=True)
            self.asked.append((gram, _cuts(owner_of(gram, owners), owners)))
            self.back.append(back)


_ROW = "owner int, portion long, other int, texts binary, {}"
_ASKED_NAMES = ["owner", "portion", "other", "texts", "words", "pairs", "triples"]
_TOLD_NAMES = ["owner", "portion", "other", "texts", "counts", "words", "pairs", "triples"]
_ASKED, _TOLD = (_ROW.format(", ".join(f"{c} binary" for c in names[4:])) for names in (_ASKED_NAMES, _TOLD_NAMES))


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * (len(names) - 3)
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _ask(batches, owners: int):
    """For each portion of texts: itself for its home, and for each owner the words, n-grams and contexts it has."""
    for rows, texts in grouped(batches, "_text", PORTION):
        h, first, _ = tokens(texts)
        # of the content alone, so that a task that runs again gives the same number; equal portions get equal answers
        portion = int.from_bytes(hashlib.blake2b(first.tobytes() + h.tobytes(), digest_size=8).digest(), "little", signed=True)
        home = portion % owners
        q = Questions(h, first, owners)
        asked: dict[int, list[bytes]] = {}
        for i, (gram, cuts) in enumerate(q.asked):
            for o, a, b in cuts:
                asked.setdefault(o, [b""] * 3)[i] = gram[a:b].tobytes() if i == 0 else _five(gram[a:b])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rows)
        out = [(home, portion, home, sink.getvalue().to_pybytes(), None, None, None)]
        out += [(o, portion, home, None, *x) for o, x in asked.items()]
        done = size = 0
        for i, row in enumerate(out):
            size += sum(len(x) for x in row[3:] if x)
            if size >= SENT or i + 1 == len(out):
                yield from _table(out[done : i + 1], _ASKED_NAMES).to_batches()
                done, size = i + 1, 0


def _tell(asked: pa.Table, own: pa.Table) -> pa.Table:
    """An owner's answers to the portions' homes; portions go on as they are."""
    part, keys, counts = np.zeros(8, np.uint8), np.empty(0, np.uint64), np.empty(0, np.int64)
    if own.num_rows:
        part, keys, counts = (np.frombuffer(own.column(c)[0].as_py(), k) for c, k in (("bits", np.uint8), ("words", np.uint64), ("counts", np.int64)))
    me, portion, home, texts, *questions = (asked.column(c).to_pylist() for c in _ASKED_NAMES)
    out = [(me[i], portion[i], me[i], texts[i], *[None] * 4) for i in range(len(me)) if texts[i] is not None]
    rows = [i for i in range(len(me)) if texts[i] is None]
    answers, counted = [], []
    for k, blobs in enumerate(questions):  # all portions' questions at once, each different one once
        own = [np.frombuffer(blobs[i], np.uint64) if k == 0 else _from_five([blobs[i]]) for i in rows]
        h, back = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_inverse=True)
        ends = np.cumsum([len(x) for x in own])[:-1] if own else []
        answers.append(np.split(level_of(part, k, h)[back], ends))
        if k == 0:
            counted = np.split(_look_up(keys, counts, h)[back], ends)
    for j, i in enumerate(rows):
        n = counted[j]
        out.append((home[i], portion[i], me[i], None, n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64).tobytes(), *(x[j].tobytes() for x in answers)))
    trim()
    return _table(out, _TOLD_NAMES)


def _scored(table: pa.Table, model: Totals, owners: int, names: list[str]) -> pa.Table:
    """The scores of a home's portions from the owners' answers."""
    column = {c: table.column(c) for c in _TOLD_NAMES}
    told, portions = {}, []
    for i, (portion, other, answer) in enumerate(zip(column["portion"].to_pylist(), column["other"].to_pylist(), column["texts"].is_null().to_pylist(), strict=True)):
        if answer:
            told[portion, other] = i
        else:
            portions.append((portion, i))
    out = []
    for portion, i in portions:
        rows = pa.ipc.open_stream(column["texts"][i].as_py()).read_all()
        h, first, words = tokens(texts_of(rows.column("_text").combine_chunks()))
        q = Questions(h, first, owners)

        def answers(k, name, portion=portion, q=q):
            cuts = q.asked[k][1]
            got = [column[name][told[portion, o]].as_py() for o, _, _ in cuts]
            kinds = [np.uint8 if name != "counts" else np.uint32 if len(x) == 4 * (b - a) else np.uint64 for x, (_, a, b) in zip(got, cuts, strict=True)]
            return np.concatenate([np.frombuffer(x, kind) for x, kind in zip(got, kinds, strict=True)])[q.back[k]].astype(np.int64)

        exact = answers(0, "counts")
        n = np.diff(first)
        text_of = np.repeat(np.arange(len(n)), n)
        starts, ends = np.zeros(len(h), bool), np.zeros(len(h), bool)
        starts[first[:-1]] = ends[first[1:] - 1] = True
        spelled = np.full(len(h), -np.inf)
        spelled[~ends] = model.spelled(words)
        log = model.log10(spelled, starts, [answers(k, name) for k, name in enumerate(("words", "pairs", "triples"))])
        base = np.bincount(text_of, np.log10(exact + 1.0), len(n)) - n * np.log10(model.tokens + model.types + 1)
        known = np.bincount(text_of, exact > 0, len(n)).astype(np.int64)
        gain = np.bincount(text_of, np.where(exact > 0, log, 0.0), len(n))
        out.append(pa.table([rows.column("_key"), rows.column("held"), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(np.bincount(text_of, log, len(n))), pa.array(gain)], names))
    return pa.concat_tables(out)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python by SENT bytes at a time: an executor holds a batch several times outside its heap, and that memory isn't given back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{SENT}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", owned: int = OWNED) -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score (of known tokens alone).

    Learns from rows whose crc32 of the key as text isn't 2 modulo 7. Null and empty texts are one end token. Repeated rows
    are learned and scored as often as they occur. Without any row to learn from scores are 0. Very long texts are
    scored whole. An empty table gives no rows. Other columns aren't read. A null key is in the learning part.
    """
    code = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7
    rows = docs.select(F.col(key).alias("_key"), (code == 2).alias("held"), F.col(text).alias("_text"))
    owners = min(owners_for(rows, "_text", owned), 1 << 20)
    with small_batches(docs.sparkSession):
        own = saved(parts(rows.filter("not held"), "_text", owners), "lm")
    model = Totals(own.drop("owner", "bits", "words", "counts").toArrow().to_pylist())
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "known_score"]
    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double"
    out = None
    for i in range(SLICES):
        some = rows.filter(F.pmod(F.xxhash64("_key"), F.lit(SLICES)) == i)
        asked = some.mapInArrow(lambda b: _ask(b, owners), _ASKED)
        told = asked.groupBy("owner").cogroup(own.select("owner", "bits", "words", "counts").groupBy("owner")).applyInArrow(_tell, _TOLD)
        with small_batches(docs.sparkSession):
            scored = saved(told.groupBy("owner").applyInArrow(lambda t: _scored(t, sent.value, owners, names), schema), "scores")
        out = scored if out is None else out.unionByName(scored)
    released(own)
    return out


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
