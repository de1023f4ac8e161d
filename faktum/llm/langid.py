"""Language ID by a linear-chain conditional random field over words.

Each word of a text gets a label. A word's evidence is the sum of weights of its hashed features: byte n-grams of 2 to 4
bytes, those that touch the word's edges being its affixes, and the word itself (the lexicon). Transition weights between
labels of neighbouring words are learned too, so a passage in another language inside a text is labelled as such. Forward-
backward gives each word's probabilities; a text's language has the largest share of the words that hold a letter.

Learning is by gradient steps on the conditional likelihood over a bounded sample: at most SAMPLE_DOCS documents of each
language, chosen by hash; every language is learned. The model's tables have a fixed size for each language and are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.llm.store import unused
from faktum.llm.textkit import Words, grouped, mix

#: Documents of each language that the model learns from, at most.
SAMPLE_DOCS = 200
#: Letters of each of these documents, at most (a bound on the driver's memory; what is predicted is whole texts).
LEARNED = 4_000
#: Sizes of the n-gram tables and of the lexicon; n-gram lengths; gradient steps.
GRAMS, LEXICON, LENGTHS, STEPS = 1 << 16, 1 << 17, (2, 3, 4), 12
#: Bytes of texts that are labelled together, about.
PORTION = 1 << 20
#: Texts that are worked on together when learning; languages beyond which portions of texts shrink, to hold memory.
TOGETHER, MANY = 100, 16
#: A text is one chain. With at most FEW languages it is worked on in pieces of CHAIN words, to which what comes before and after is carried.
CHAIN, FEW = 256, 16
#: Of so many texts that are learned from one is spliced with another one's words, SPLICED of each, so that moves are learned.
EVERY, SPLICED = 3, 25
UNKNOWN = "und"

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Features:
    """Of a list of texts: each word's lexicon slot, and each byte's n-gram slots."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = w = Words(texts, lower=True)
        buf = np.append(np.where(_SPACE[w.buf], np.uint8(32), w.buf), np.full(max(LENGTHS), 32, np.uint8)).astype(np.uint64)
        self.grams = []
        for length in LENGTHS:
            h = np.zeros(len(buf) - length + 1, np.uint64)
            for i in range(length):
                h = h << np.uint64(8) | buf[i : len(buf) - length + 1 + i]
            self.grams.append((mix(h + np.uint64(length << 40)) >> np.uint64(48)).astype(np.int64) & (GRAMS - 1))
        self.lexicon = (w.h & np.uint64(LEXICON - 1)).astype(np.int64)
        letters = np.concatenate(([0], np.cumsum(_ALPHA[w.buf])))
        self.letters = letters[w.ends] > letters[w.starts]
        # an n-gram is a word's if it begins at the separator before it or later and ends at the separator after it or before
        self.spans = [(w.starts - 1, np.maximum(w.starts - 1, w.ends + 2 - length)) for length in LENGTHS]

    def evidence(self, model: dict) -> np.ndarray:
        out = model["lexicon"][self.lexicon] + model["bias"]
        for table, slots, (begin, end) in zip(model["grams"], self.grams, self.spans, strict=True):
            for label in range(out.shape[1]):
                total = np.concatenate(([0.0], np.cumsum(table[:, label][slots], dtype=np.float64)))
                last = np.minimum(end, len(slots))
                out[:, label] += (total[last] - total[np.minimum(begin, last)]).astype(np.float32)
        return out

    def chains(self, n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece of a chain begins, how long it is, and whether it goes on with the one before."""
        first = self.words.first
        count = np.diff(first)
        size = CHAIN if n_labels <= FEW else max(1, int(count.max(initial=1)))
        parts = -(-count // size)
        text = np.repeat(np.arange(len(count)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + nth * size
        return begin, np.minimum(size, first[text + 1] - begin), nth > 0


def _carried(emit: np.ndarray, step: np.ndarray, begin: np.ndarray, length: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: the label probabilities (up to a factor) of the word before it, and what the words after it say of its last one.

    A piece is a matrix, the product of its words' steps; all pieces' matrices are made at once, then vectors go through them.
    """
    n, n_labels = len(begin), len(step)
    before, after = np.full((n, n_labels), 1 / n_labels), np.ones((n, n_labels))
    if not follows.any():
        return before, after
    cut = np.flatnonzero(~follows)
    size = np.diff(np.append(cut, n))
    long = np.repeat(size > 1, size)
    at_piece = np.flatnonzero(long)
    matrix = np.zeros((n, n_labels, n_labels))
    now = np.where(follows[at_piece, None, None], step[None], np.eye(n_labels)[None]) * emit[begin[at_piece]][:, None, :]
    for t in range(1, int(length[at_piece].max())):
        on = length[at_piece] > t
        now[on] = (now[on] @ step) * emit[begin[at_piece[on]] + t][:, None, :]
        now[on] /= now[on].sum((1, 2), keepdims=True)
    matrix[at_piece] = now
    several = cut[size > 1]
    lengths = size[size > 1]
    for i in range(1, int(lengths.max())):
        at = several[lengths > i] + i
        x = np.einsum("ka,kab->kb", before[at - 1], matrix[at - 1])
        before[at] = x / x.sum(1, keepdims=True)
    for i in range(int(lengths.max()) - 2, -1, -1):
        at = several[lengths > i + 1] + i
        x = np.einsum("kab,kb->ka", matrix[at + 1], after[at + 1])
        after[at] = x / x.sum(1, keepdims=True)
    return before, after


def forward_backward(evidence: np.ndarray, moves: np.ndarray, begin: np.ndarray, length: np.ndarray, follows: np.ndarray | None = None, learning: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's label probabilities, the expected count of each move (when learning), and each piece's log partition.

    The log partition of a chain is the sum of its pieces'. All pieces are worked on at once, word by word.
    """
    n_labels = evidence.shape[1]
    follows = np.zeros(len(begin), bool) if follows is None else follows
    top = evidence.max(1, keepdims=True) if len(evidence) else np.zeros((0, 1))
    emit = np.exp(evidence - top).astype(np.float64)
    step = np.exp(moves).astype(np.float64)
    before, after = _carried(emit, step, begin, length, follows)
    order = np.argsort(-length, kind="stable")
    begin, length, follows, before, after = begin[order], length[order], follows[order], before[order], after[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    alpha = np.zeros((len(evidence), n_labels))
    log_z = np.zeros(len(begin))
    now = np.where(follows[:, None], before @ step, 1 / n_labels)
    for t in range(steps):
        k = active[t]
        at = begin[:k] + t
        now = (now[:k] if t == 0 else now[:k] @ step) * emit[at]
        scale = now.sum(1)
        log_z[:k] += np.log(scale) + top[at, 0]
        now = now / scale[:, None]
        alpha[at] = now
    marginals = np.zeros((len(evidence), n_labels))
    pairs = np.zeros((n_labels, n_labels))
    beta = after.copy()
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        p = alpha[at] * beta[:k]
        marginals[at] = p / p.sum(1, keepdims=True)
        back = emit[at] * beta[:k]
        if learning:
            inner = np.flatnonzero(follows[:k]) if t == 0 else np.arange(k)
            left = alpha[at[inner] - 1]
            each = (left @ step * back[inner]).sum(1, keepdims=True)
            pairs += step * (left.T @ (back[inner] / each))
        beta[:k] = back @ step.T
        beta[:k] /= beta[:k].sum(1, keepdims=True)
    out = np.empty(len(begin))
    out[order] = log_z
    return marginals, pairs, out


class Part:
    """Some of the texts that are learned from; the right labels of their words, as (label, words) runs of each text."""

    def __init__(self, texts: list[bytes], labels: list[list[tuple[int, int]]], n: int) -> None:
        self.f = f = Features(texts)
        f.grams = [g.astype(np.int32) for g in f.grams]
        self.n = n
        self.begin, self.length, self.follows = f.chains(n)
        self.gold = np.array([x for runs in labels for x, words in runs for _ in range(words)], np.int64)
        inner = np.ones(len(self.gold), bool)
        inner[self.begin[~self.follows]] = False
        at = np.flatnonzero(inner)
        self.moved = np.bincount(self.gold[at - 1] * n + self.gold[at], minlength=n * n).reshape(n, n).astype(float)

    def likelihood(self, model: dict) -> float:
        """The log likelihood of the right labels."""
        evidence = self.f.evidence(model)
        _, _, log_z = forward_backward(evidence, model["moves"], self.begin, self.length, self.follows)
        starts = np.count_nonzero(~self.follows)  # every label is as likely to begin with
        return float(evidence[np.arange(len(self.gold)), self.gold].sum() + (self.moved * model["moves"]).sum() - starts * np.log(self.n) - log_z.sum())

    def gradient(self, model: dict, weigh: np.ndarray, bias: np.ndarray, moves: np.ndarray, lexicon: np.ndarray, grams: list[np.ndarray]) -> None:
        """Adds the slope of the log likelihood of the right labels to bias, moves, lexicon and grams."""
        f, n = self.f, self.n
        p, pairs, _ = forward_backward(f.evidence(model), model["moves"], self.begin, self.length, self.follows, learning=True)
        off = (np.eye(n)[self.gold] - p) * weigh[self.gold][:, None]
        bias += off.sum(0)
        moves += self.moved - pairs
        for j in range(n):
            lexicon[:, j] += np.bincount(f.lexicon, off[:, j], LEXICON)
        for change, slots, (first, last) in zip(grams, f.grams, f.spans, strict=True):
            last = np.minimum(last, len(slots))
            first = np.minimum(first, last)
            size = len(slots) + 1
            for j in range(n):
                each = np.cumsum(np.bincount(first, off[:, j], size) - np.bincount(last, off[:, j], size))[:-1]
                change[:, j] += np.bincount(slots, each, GRAMS)


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS) -> dict:
    """The model learned from texts whose every word is taken to be in the text's language, and from some of them spliced."""
    names = sorted(set(labels))
    n = len(names)
    model = {"names": names, "bias": np.zeros(n, np.float32), "lexicon": np.zeros((LEXICON, n), np.float32), "grams": [np.zeros((GRAMS, n), np.float32) for _ in LENGTHS], "moves": np.zeros((n, n), np.float32)}
    if n < 2:
        return model
    number, together = {x: i for i, x in enumerate(names)}, max(1, TOGETHER * MANY // max(MANY, n))
    runs = [[(number[x], len(t.split()))] for t, x in zip(texts, labels, strict=True)]
    texts = list(texts)
    for i in range(0, len(runs), EVERY):  # words of two texts of different languages one after the other
        other = next((j % len(labels) for j in range(i + 1, i + len(labels)) if labels[j % len(labels)] != labels[i]), None)
        if other is not None:
            both = [texts[k].split()[:SPLICED] for k in (i, other)]
            texts.append(b" ".join(both[0] + both[1]))
            runs.append([(number[labels[k]], len(w)) for k, w in zip((i, other), both, strict=True)])
    parts = [Part(texts[i : i + together], runs[i : i + together], n) for i in range(0, len(texts), together)]
    held = sum(np.bincount(p.gold, minlength=n) for p in parts)
    # each language counts alike, however many of its words the sample holds
    weigh = held.sum() / n / np.maximum(held, 1)
    squares: dict = {}

    def move(name: str, table: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        squares[name] = squares.get(name, 0) + gradient**2
        table += (rate * gradient / np.sqrt(squares[name] + 1e-8) - 1e-4 * table).astype(np.float32)

    for _ in range(steps):
        bias, moves, lexicon, grams = np.zeros(n), np.zeros((n, n)), np.zeros((LEXICON, n)), [np.zeros((GRAMS, n)) for _ in LENGTHS]
        for p in parts:
            p.gradient(model, weigh, bias, moves, lexicon, grams)
        move("bias", model["bias"], bias, 0.05)
        move("moves", model["moves"], moves, 0.1)
        move("lexicon", model["lexicon"], lexicon, 0.2)
        for g, change in enumerate(grams):
            move(f"grams{g}", model["grams"][g], change, 0.2)
    return model


def label_words(model: dict, texts: list[bytes]) -> tuple[Features, np.ndarray]:
    f = Features(texts)
    begin, length, follows = f.chains(len(model["names"]))
    p, _, _ = forward_backward(f.evidence(model), model["moves"], begin, length, follows)
    return f, p


def predict(model: dict, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Each text's language, and the share of its words with letters that are in it."""
    names = model["names"]
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    f, p = label_words(model, texts)
    total = np.concatenate((np.zeros((1, len(names))), np.cumsum(p * f.letters[:, None], 0)))
    counts = total[f.words.first[1:]] - total[f.words.first[:-1]]
    best = counts.argmax(1)
    share = counts.max(1) / np.maximum(counts.sum(1), 1e-12)
    langs, scores = [], []
    for i, t in enumerate(texts):
        known = counts[i].sum() > 1e-9 and (any(c < 128 and _ALPHA[c] for c in t[:64]) or any(c.isalpha() for c in t.decode("utf-8", "replace")))
        langs.append(names[best[i]] if known else UNKNOWN)
        scores.append(min(1.0, float(share[i])) if known else 0.0)
    return langs, scores


def learn(rows: DataFrame, text: str, lang: str, order: Column, sample: int = SAMPLE_DOCS) -> dict:
    """The model of every non-null lang from at most sample rows of each, those with the smallest order (a whole number below 2^32)."""
    counts = {r[0]: r[1] for r in rows.filter(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    if not counts:
        return fit([], [])
    # a hash bound for each language lets through a few more rows than are needed; the exact number is cut from those
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (sample + 6 * sample**0.5 + 20) / n) * 2**32)])
    some = rows.filter(F.col(lang).isin(list(counts))).select(F.col(lang).alias("lang"), F.substring(text, 1, LEARNED).alias("text"), order.alias("order")).filter(F.col("order") < bound[F.col("lang")]).collect()
    some.sort(key=lambda r: (r[2], r[1] or ""))
    taken: dict[str, int] = {}
    texts, labels = [], []
    for name, body, _ in some:
        if body and taken.get(name, 0) < sample:
            taken[name] = taken.get(name, 0) + 1
            texts.append(body.encode())
            labels.append(name)
    return fit(texts, labels)


def identify(docs: DataFrame, model: dict, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs, then the language and its score under names. Null text and text without a letter: und, 0.0."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    body = text if text in keep else unused(docs, "_text")  # a text travels once
    read = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(text).alias(body)]))

    def run(batches):
        for rows, texts in grouped(batches, body, PORTION * MANY // max(MANY, len(sent.value["names"]))):
            langs, scores = predict(sent.value, texts)
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(keep))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return read.mapInArrow(run, schema)


def train_for(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Learns from rows whose crc32 of the key as text isn't 0 modulo 5 and whose lang isn't null."""
    code = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    order = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 32)
    return learn(docs.filter(code % 5 != 0), text, lang, order)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: key, held_out, lang_pred, score.

    Null or letterless text: und, 0.0; so are all texts if no row has a language to learn from. Very long texts are labelled
    whole, chain by chain. Repeated rows and equal keys each give their row. A null key is in the learning part.
    """
    code = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    out = identify(docs.select(key, text), train_for(docs, key, text, lang), [key], text)
    return out.select(key, (code % 5 == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.35) -> DataFrame:
    """docs without the rows whose language can't be told (und) or has a share below least; all columns stay, whatever their names.

    Null texts and texts without a letter go. Repeated rows all stay or all go. If no row has a language to learn from, all go;
    an empty table gives no rows. Very long texts are labelled whole. A null key counts as a text of its own.
    """
    names = (unused(docs, "identified_"), unused(docs, "share_"))
    told = identify(docs, train_for(docs, key, text, lang), docs.columns, text, names)
    return told.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(docs.columns)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
