"""Byte-pair encoding and decoding through a pair occurrence index.

The pieces that the split pattern makes are encoded together, a partition's distinct ones at a time. Their bytes lie in one
array of symbols, linked to their neighbours inside a piece. An index maps each pair (by its merge rank) to all positions
where it occurs. The lowest active rank is taken; all its occurrences are merged at once, left to right where they overlap;
then the pairs on either side of each merge are looked up and their positions added to the lists of their ranks. A merge
can only make pairs of higher rank, so ascending order gives the same ids as merging piece by piece.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from faktum.llm.textkit import trim

#: How text is split before merging; \\s is the White_Space property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of text whose new pieces are encoded together, and pieces that a task remembers before it starts anew.
TOGETHER, REMEMBERED = 4 << 20, 100_000
#: Text longer than this is split by a running match, so that its pieces are never all in memory.
LONG_TEXT = 1 << 20
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class Codec:
    """The tables of one vocabulary file."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.of_byte = np.array([vocab[s] for s in symbols], np.int32)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.same = np.array([a == b for a, b in pairs])
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.split = regex.compile(PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces one after the other, and where each piece's begin (one more at the end)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return np.empty(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            r = rank[positions]
            positions, r = positions[r != _NONE], r[r != _NONE]
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for x, own in zip(r[np.concatenate(([0], cut))].tolist() if len(r) else [], np.split(positions, cut), strict=False):
                if x not in index:
                    index[x] = []
                    heapq.heappush(active, x)
                index[x].append(own)

        add(inner)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[alive[at] & (rank[at] == r)]
            if len(lists) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            if self.same[r] and len(at) > 1:
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                run = np.flatnonzero(~chained)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            following = after[gone]
            sym[at] = self.result[r]
            alive[gone] = False
            after[at] = following
            has = following >= 0
            before[following[has]] = at[has]
            rank[at] = _NONE
            rank[at[has]] = self._rank(sym[at[has]], sym[following[has]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self._rank(sym[left], sym[after[left]])
            add(np.concatenate((at[has], left)))
        where = np.concatenate(([0], ends))
        return sym[alive], np.concatenate(([0], np.cumsum(alive)))[where]

    def pieces(self, text: str) -> Iterator[list[str]]:
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                yield [part]
            elif len(part) <= LONG_TEXT:
                yield self.split.findall(part)
            else:
                held = []
                for m in self.split.finditer(part):
                    held.append(m.group())
                    if len(held) >= 1 << 16:
                        yield held
                        held = []
                yield held

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Memory(dict):
    """Pieces by number, in order of first sight, and the ids of those encoded so far."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.new = codec, []
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n

    def learn(self) -> None:
        special = self.codec.special
        ids, first = self.codec.encode_pieces([b"" if p in special else p.encode() for p in self.new])
        if any(p in special for p in self.new):
            own = [np.array([special[p]], np.int32) if p in special else ids[first[i] : first[i + 1]] for i, p in enumerate(self.new)]
            ids, first = np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))
        self.first = np.concatenate((self.first, self.first[-1] + first[1:]))
        self.ids = np.concatenate((self.ids, ids))
        self.new = []

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces given by number, one after the other."""
        begin, size = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        end = np.cumsum(size)
        return self.ids[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def encoded(codec: Codec, batches: Iterator[pa.RecordBatch], text: str, together: int = TOGETHER, remembered: int = REMEMBERED) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the ids of each row's text (null: empty), in the rows' order."""
    memory = Memory(codec)
    held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        memory.learn()
        for rows, numbers in held:
            yield rows, [memory.of(x) for x in numbers]

    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            rows = batch.slice(at, 128)
            numbers = []
            for t in rows.column(rows.schema.get_field_index(text)).to_pylist():
                parts = [np.fromiter(map(memory.__getitem__, p), np.int32, len(p)) for p in codec.pieces(t or "")]
                numbers.append(np.concatenate(parts) if parts else np.empty(0, np.int32))
                size += len(t or "")
            held.append((rows, numbers))
            if size >= together:
                yield from flush()
                held, size = [], 0
                if len(memory) > remembered:
                    memory = Memory(codec)
    yield from flush()
    held, memory = [], None
    trim()


def _codec(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent to the tasks (its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids; null text has no ids. A column of that name is replaced."""
    from pyspark.sql import types as T

    spec = _codec(docs, path or default_path())
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        for rows, ids in encoded(Codec(spec.value), batches, text):
            table = pa.Table.from_batches([rows])
            table = table.drop_columns([out]) if out in table.column_names else table
            yield from table.append_column(pa.field(out, pa.list_(pa.field("element", pa.int32(), False)), False), pa.array([x for x in ids], pa.list_(pa.int32())).cast(pa.list_(pa.field("element", pa.int32(), False)))).to_batches()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the decoded text of each row's ids; null ids give an empty text. A column of that name is replaced."""
    from pyspark.sql import types as T

    spec = _codec(tokens, path or default_path())
    schema = T.StructType([f for f in tokens.schema if f.name != out] + [T.StructField(out, T.StringType(), False)])

    def run(batches):
        codec = Codec(spec.value)
        for rows in batches:
            table = pa.Table.from_batches([rows])
            text = [codec.decode(x or []) for x in rows.column(rows.schema.get_field_index(ids)).to_pylist()]
            table = table.drop_columns([out]) if out in table.column_names else table
            yield from table.append_column(pa.field(out, pa.string(), False), pa.array(text, pa.string())).to_batches()

    return tokens.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, ids_sha256 and decoded_sha256 (see the names), from a full encoding and decoding.

    Null counts as empty: 0 tokens and the SHA-256 of nothing. Special tokens' strings become their ids, as the library does.
    Repeated rows give repeated rows, an empty table none; other columns aren't read.
    """
    spec = _codec(docs, path or default_path())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        codec = Codec(spec.value)
        for rows, ids in encoded(codec, batches, text):
            n = [len(x) for x in ids]
            sha = [hashlib.sha256(np.ascontiguousarray(x, "<u4")).hexdigest() for x in ids]
            back = [hashlib.sha256(codec.decode(x.tolist()).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
