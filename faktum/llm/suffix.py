"""Suffix-array dedup of byte passages by external induced sorting.

A passage is any string of LENGTH bytes. Only bytes near something that repeats can be in a repeated one, so texts are first
cut at anchors: of the GRAM-byte strings in a passage the one with the least hash (the first of those) is its anchor, and
a segment is a run of passages with one anchor. Equal passages have equal anchors, so they are in segments that meet at
the anchor's owner. There segments of equal content (two independent 64-bit hashes and the length) fold into the earliest, so
that a passage with any share of the rows is sorted once. Others can only share a passage if they share the SIDE bytes to the
left or to the right of the anchor; a segment that shares neither is done. What is left is sorted: an
owner deals its anchors to shards by bytes; a shard's segments are written one after the other to a text on the task's disk,
whose suffixes come out in order with their common prefixes from faktum.llm.induced, in memory that doesn't depend on the
size of the shard. Neighbours with a common prefix of LENGTH bytes are equal passages; all but the earliest go.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm.induced import Pool, Spread, suffixes
from faktum.llm.store import owners_for, released, saved, tasks
from faktum.llm.textkit import CHUNK, grouped, mix, power, texts_of

#: Bytes of a passage and of an anchor; bytes that a sorting task's runs hold in memory; segments gathered before they are sent; bytes of a shard.
LENGTH, GRAM, MEMORY, GATHERED, SHARD_BYTES = 100, 32, 48 << 20, 1 << 19, 8 << 20
#: Bytes of texts whose segments an owner gets, about.
OWNED = 16 << 20
#: Owners that deal to the same shards.
TOGETHER = 2
#: Of the two sides of a passage's anchor, the longer has at least so many bytes.
SIDE = (LENGTH - GRAM) // 2
#: What each byte counts as in the second content hash.
_OTHER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def segments(text: bytes) -> tuple[np.ndarray, ...] | None:
    """Of a text's segments: hash of the anchor, two hashes of the content, start, number of passages, hashes of the sides.

    A passage reaches at least SIDE bytes to the left or to the right of its anchor. The hash of a side stands for the SIDE
    bytes there if some passage of the segment reaches over them, and is 0 if none does.
    """
    buf = np.frombuffer(text, np.uint8)
    n = len(buf)
    if n < LENGTH:
        return None
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power(n), out=total[1:])
    down = power(n, "down")
    least = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    hashes, at, size, window = least, np.arange(len(least), dtype=np.int64), 1, LENGTH - GRAM + 1
    while size < window:
        step = min(size, window - size)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        size += step
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(start, len(at)))
    content = mix((total[start + count + LENGTH - 1] - total[start]) * down[start] + count.astype(np.uint64))
    before, total = total, np.zeros(n + 1, np.uint64)
    np.cumsum(_OTHER[buf] * power(n), out=total[1:])
    other = mix((total[start + count + LENGTH - 1] - total[start]) * down[start] + count.astype(np.uint64))
    p = at[start]
    here = p - start >= SIDE
    left = np.where(here, mix((before[p] - before[np.where(here, p - SIDE, 0)]) * down[np.where(here, p - SIDE, 0)]) >> np.uint64(33) | np.uint64(1), np.uint64(0))
    here = p - (start + count - 1) <= LENGTH - GRAM - SIDE
    q = np.where(here, p + GRAM, 0)
    right = np.where(here, mix((before[q + np.where(here, SIDE, 0)] - before[q]) * down[q]) >> np.uint64(33) | np.uint64(1), np.uint64(0))
    return hashes[p], content, other, start, count, left, right


_SEG = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("start", "<u4"), ("n", "u1"), ("left", "<u4"), ("right", "<u4")])
_RUN = np.dtype([("start", "<u4"), ("n", "<u4")])


def _packed(x: np.ndarray) -> bytes:
    """Column by column, so that columns with repeats compress."""
    return np.array([len(x)], np.int64).tobytes() + b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out, at = np.empty(n, _SEG), 8
    for f in _SEG.names:
        kind = _SEG[f]
        out[f] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _sent(batches, owners: int):
    held, size = [], 0

    def flush():
        x = np.concatenate(held)
        owner = ((mix(x["anchor"]) >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        x, owner = x[order], owner[order]
        cut = np.searchsorted(owner, np.arange(owners + 1))
        some = [o for o in range(owners) if cut[o] < cut[o + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_packed(x[cut[o] : cut[o + 1]]) for o in some], pa.binary())], ["owner", "blob"])

    for rows, texts in grouped(batches, "body"):
        for doc, tie, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts, strict=True):
            if (s := segments(text)) is not None:
                x = np.zeros(len(s[0]), _SEG)
                x["anchor"], x["content"], x["other"], x["start"], x["n"], x["left"], x["right"] = s
                x["doc"], x["tie"] = doc, tie
                held.append(x)
                size += len(x)
        if size >= GATHERED:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _rows(x: np.ndarray, kind: int, shard: np.ndarray | None = None) -> pa.Table:
    """One row for each document: its runs of passage starts (kind 0: to remove; 1: to compare in shard)."""
    order = np.lexsort((x["start"], x["tie"], x["doc"]) if shard is None else (x["start"], shard, x["tie"], x["doc"]))
    x = x[order]
    shard = np.zeros(len(x), np.int64) if shard is None else shard[order]
    new = np.concatenate((np.ones(min(1, len(x)), bool), (x["doc"][1:] != x["doc"][:-1]) | (x["tie"][1:] != x["tie"][:-1]) | (shard[1:] != shard[:-1])))
    cut = np.flatnonzero(new)
    runs = np.zeros(len(x), _RUN)
    runs["start"], runs["n"] = x["start"], x["n"]
    ends = [*cut[1:].tolist(), len(x)]
    return pa.table([pa.array(np.full(len(cut), kind, np.int32)), pa.array(shard[cut]), pa.array(x["doc"][cut]), pa.array(x["tie"][cut].astype(np.int64)), pa.array([runs[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=False)], pa.binary())], ["kind", "shard", "doc", "tie", "runs"])


def _shards(owner: int, group: np.ndarray, n: np.ndarray, limit: int) -> np.ndarray:
    """The shard of each segment of n passages. Anchors (groups, in order) stay whole; a shard ends with the one that brings it to limit bytes."""
    _, anchor = np.unique(group, return_inverse=True)
    size = np.bincount(anchor, n.astype(np.int64) + LENGTH)
    return (owner // TOGETHER << 32) + ((np.cumsum(size) - size) // limit).astype(np.int64)[anchor]


def _owned(table: pa.Table, limit: int) -> pa.Table:
    """Folds equal segments into the earliest; of an anchor's other segments those that share a side are to be compared."""
    x = np.concatenate([_unpacked(b) for b in table.column("blob").to_pylist()])
    x = x[np.lexsort((x["start"], x["tie"], x["doc"], x["n"], x["other"], x["content"], x["anchor"]))]
    again = np.concatenate(([False], (x["start"][1:] == x["start"][:-1]) & (x["doc"][1:] == x["doc"][:-1]) & (x["tie"][1:] == x["tie"][:-1])))
    x = x[~again]  # rows that are equal in key and text
    new = np.concatenate(([True], x["anchor"][1:] != x["anchor"][:-1]))
    first = new | np.concatenate(([True], (x["content"][1:] != x["content"][:-1]) | (x["other"][1:] != x["other"][:-1]) | (x["n"][1:] != x["n"][:-1])))
    group = np.cumsum(new) - 1
    compare = np.zeros(len(x), bool)
    for side in ("left", "right"):  # equal passages have equal sides, the left or the right ones
        at = np.flatnonzero(first & (x[side] > 0))
        _, name, times = np.unique(group[at].astype(np.uint64) << np.uint64(32) | x[side][at], return_inverse=True, return_counts=True)
        compare[at[times[name] > 1]] = True
    shard = _shards(table.column("owner")[0].as_py(), group[compare], x["n"][compare], limit)
    return pa.concat_tables([_rows(x[~first], 0), _rows(x[compare], 1, shard)])


def _cut_out(batches):
    """The segments' bytes, from their documents."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for doc, tie, parts, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_of(batch.column(3)), strict=True):
            for part in parts:
                for s, n in np.frombuffer(part["runs"], _RUN).tolist():
                    out.append((part["shard"], doc, tie, s, text[s : s + n + LENGTH - 1]))
                    size += n + LENGTH
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], _PIECE)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], _PIECE)


_PIECE = ["shard", "doc", "tie", "start", "bytes"]
_PLACED = np.dtype([("begin", "<i8"), ("size", "<i8"), ("doc", "<i8"), ("tie", "<u4"), ("start", "<u4")])


class Shard:
    """A shard's text on the task's disk, from its segments in order of document and start."""

    def __init__(self, memory: int) -> None:
        self.memory, self.folder = memory, tempfile.TemporaryDirectory()
        self.text, self.placed = (open(f"{self.folder.name}/{name}", "wb") for name in ("text", "placed"))
        self.n, self.last = 0, None

    def add(self, rows: pa.RecordBatch) -> None:
        columns = [rows.column(i).to_pylist() for i in range(1, 5)]
        for doc, tie, start, piece in zip(*columns, strict=True):
            if (doc, tie, start) == self.last:
                continue  # rows that are equal in key and text
            self.last = doc, tie, start
            symbols = np.frombuffer(piece, np.uint8).astype(np.uint16) + np.uint16(2)
            self.text.write(symbols.tobytes())
            self.text.write(b"\1\0")
            self.placed.write(np.array([(self.n, len(piece), doc, tie, start)], _PLACED).tobytes())
            self.n += len(piece) + 1

    def gone(self) -> Iterator[np.ndarray]:
        """Positions of passages that an earlier position has too, in no order."""
        kept: int | None = None  # the earliest so far of the group that goes on
        for pos, v in suffixes(f"{self.folder.name}/text", 258, self.memory, self.folder.name):
            begin = np.flatnonzero(v < LENGTH)
            whole = np.concatenate(([0], begin)) if not len(begin) or begin[0] else begin
            least = np.minimum.reduceat(pos, whole)
            group = np.repeat(np.arange(len(whole)), np.diff(np.append(whole, len(pos))))
            out = pos[pos != least[group]]
            if kept is not None and v[0] >= LENGTH:
                out = np.append(out, max(kept, int(least[0])))
                least[0] = min(kept, least[0])
            kept = int(least[-1])
            yield out

    def removed(self) -> Iterator[pa.Table]:
        """The runs of passages that go, by document."""
        self.text.write(b"\0\0")
        self.text.close()
        self.placed.close()
        pool = Pool(self.memory)
        spread = Spread(pool, self.n, max(1, self.memory // 64))
        for pos in self.gone():
            spread.put(pos, pos)
        placed = np.memmap(f"{self.folder.name}/placed", _PLACED, "r")
        for pos in spread.spans():
            pos = np.sort(pos)
            piece = np.searchsorted(placed["begin"], pos, side="right") - 1
            inside = placed["begin"][piece] + placed["size"][piece] - pos >= LENGTH  # a passage doesn't reach into the next segment
            pos, piece = pos[inside], piece[inside]
            if len(pos):
                head = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1] + 1)))
                own = placed[piece[head]]
                x = np.zeros(len(head), np.dtype([("doc", "<i8"), ("tie", "<u4"), ("start", "<u4"), ("n", "<u4")]))
                x["doc"], x["tie"], x["start"] = own["doc"], own["tie"], own["start"] + pos[head] - own["begin"]
                x["n"] = np.diff(np.append(head, len(pos)))
                yield _rows(x, 0)
        pool.close()

    def close(self) -> None:
        self.text.close()
        self.placed.close()
        self.folder.cleanup()


def _sorted_shards(batches: Iterable[pa.RecordBatch], memory: int = MEMORY) -> Iterator[pa.RecordBatch]:
    """The runs of passages to remove, from segments in order of shard, document and start; one shard after the other."""
    shard, name = None, None

    def finished():
        if shard is not None:
            for table in shard.removed():
                yield from table.to_batches()
            shard.close()

    for batch in batches:
        names = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if names[a] != name:
                yield from finished()
                shard, name = Shard(memory), names[a]
            shard.add(batch.slice(a, b - a))
    yield from finished()


def removed_runs(runs: list[bytes], n: int) -> np.ndarray:
    """Which of a text's n bytes are covered by passages that start in the runs."""
    cover = np.zeros(n + 1, np.int32)
    for blob in runs:
        r = np.frombuffer(blob, _RUN)
        np.add.at(cover, r["start"], 1)
        np.add.at(cover, r["start"] + r["n"] + LENGTH - 1, -1)
    return np.cumsum(cover)[:-1] > 0


_FOUND = "kind int, shard long, doc long, tie long, runs binary"


def _kept(batches, names: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for runs, text in zip(batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            if not runs:
                rows.append((len(text), 0, 0, text))
                continue
            off = removed_runs(runs, len(text))
            spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
            rows.append((len(text), int(off.sum()), spans, np.frombuffer(text, np.uint8)[~off].tobytes()))
        last = pa.array([r[3] if whole else hashlib.sha256(r[3]).hexdigest() for r in rows], pa.binary() if whole else pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), last], names)


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 (whole: kept, the bytes left, instead).

    Null counts as empty. A text shorter than LENGTH keeps all. Rows that are equal in key and text are one document and get
    one result each; rows of one key with different texts are in order of a hash of the text; a null key comes first. The
    key is a whole number. Very long texts are cut into segments as a whole. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), F.pmod(F.xxhash64(body), F.lit(2**32)).cast("long").alias("tie"), body.alias("body"))
    owners = owners_for(rows, "body", OWNED)
    sent = rows.select("doc", "tie", "body").mapInArrow(lambda b: _sent(b, owners), "owner int, blob binary")
    found = saved(sent.groupBy("owner").applyInArrow(lambda t: _owned(t, shard_bytes), _FOUND), "segments")
    wanted = found.filter("kind = 1").groupBy("doc", "tie").agg(F.collect_list(F.struct("shard", "runs")).alias("parts"))
    texts = rows.select("doc", "tie", "body").join(wanted, ["doc", "tie"]).select("doc", "tie", "parts", "body")
    pieces = saved(texts.mapInArrow(_cut_out, "shard long, doc long, tie long, start long, bytes binary"), "pieces")
    dealt = pieces.repartition(tasks(docs.sparkSession), "shard").sortWithinPartitions("shard", "doc", "tie", "start")
    compared = saved(dealt.mapInArrow(lambda b: _sorted_shards(b, memory), _FOUND), "compared")
    released(pieces)
    gone = found.filter("kind = 0").unionByName(compared).groupBy("doc", "tie").agg(F.collect_list("runs").alias("runs"))
    out = rows.join(gone, ["doc", "tie"], "left").select("_key", "runs", "body")
    names = [key, "n_bytes", "n_removed", "n_spans", "kept" if whole else "kept_sha256"]
    kind = docs.schema[key].dataType.simpleString()
    return out.mapInArrow(lambda b: _kept(b, names, whole), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, {names[-1]} {'binary' if whole else 'string'}")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without their repeated passages."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
