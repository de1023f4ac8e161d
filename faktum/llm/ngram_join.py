"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Two sets whose Jaccard similarity is at least s differ in at most
(1-s)/(1+s) of their joint size. For a band of sizes that gives a bound k on the difference. The domain of shingles is
partitioned by hash into n1 parts of N2 cells each; with n1 = k // (K2+1) + 1 + m parts, at least m + 1 parts differ in at most
K2 elements, and in such a part some N2 - K2 cells are equal. A signature names a band, a part, a subset of its cells and
what the set has in them, so similar sets share at least m + 1 signatures. Each set leaves out its m signatures with the
fewest elements (ties by value): the order is the same for all sets, so the best shared one is never left out, and
signatures of no or few elements, which many sets share by chance, mostly are.

Sets that are equal are one class. Owners of signature ranges find the classes that share a signature. These are first
linked with a leader of their group; what a group then still has in several components is compared across components, as
far as a bound from sketches allows, the likeliest pairs first. So a group of near copies costs about as many comparisons
as it has members, and no link between components is lost. Each comparison is made on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm.components import connected
from faktum.llm.store import owners_for, released, saved, unused
from faktum.llm.textkit import Words, grouped, mix, shingles, trim

#: Words in a shingle; similarity in percent; growth of a band of sizes; cells of a part and how many may differ; spare parts.
WIDTH, PERCENT, GROWTH, N2, K2, SPARE = 5, 80, 1.25, 3, 1, 0.1
#: Signatures that a task gathers before it sends them to their owners.
GATHERED = 1 << 19
#: Pairs of a class with a part of a component that are tried before all the others.
BEST = 3
#: Members of a component that one task compares with.
COMPARED = 4096
#: Bits of the sketch that bounds the difference of two sets from below, at least.
SKETCH = 2048
#: Bytes of texts whose signatures an owner gets, at most.
OWNED = 10 << 20
#: Classes that a task remembers, so as not to send the signatures of copies again.
REMEMBERED = 1 << 18


def document_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted hashes."""
    words = Words(texts, lower=True)
    return [np.unique(shingles(words.h[a:b], width)) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(own).sum() + np.uint64(len(own)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64)).view(np.int64)[0])


def bands(percent: int = PERCENT, growth: float = GROWTH) -> list[tuple[int, int, int]]:
    """(least size, largest size, least size of a partner) of each band; bands cover all sizes up to 2^40."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * growth))
        out.append((low, high, -(-low * percent // 100)))
        low = high + 1
    return out


_BANDS = {PERCENT: bands()}


def signatures(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set, in the band of its size and in the larger ones in which a partner may be."""
    size, out = len(own), []
    all_bands = _BANDS.setdefault(percent, bands(percent))
    at = int(np.searchsorted([b[0] for b in all_bands], size, side="right")) - 1
    low, high = (own & np.uint64(0xFFFFFFFF)).astype(np.float64), (own >> np.uint64(32)).astype(np.float64)
    while at < len(all_bands) and size >= all_bands[at][2]:
        k = 2 * all_bands[at][1] * (100 - percent) // (100 + percent)
        k2 = min(K2, k)
        base = k // (k2 + 1) + 1
        spare = int(SPARE * base)
        n1, n2 = base + spare, N2 if k2 else 1
        cell = (own % np.uint64(n1 * n2)).astype(np.int64)
        count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        inside = np.bincount(cell, low, n1 * n2).astype(np.uint64) + (np.bincount(cell, high, n1 * n2).astype(np.uint64) << np.uint64(32))
        inside = mix(inside + count.reshape(-1).astype(np.uint64)).reshape(n1, n2)
        tag = mix(np.arange(n1, dtype=np.uint64) + np.uint64(at << 40))
        if k2:
            s = np.concatenate([mix(inside[:, a] + inside[:, b] * np.uint64(3) + tag + np.uint64(c)) for a, b, c in ((1, 2, 1), (0, 2, 2), (0, 1, 3))])
            n = np.concatenate([count[:, a] + count[:, b] for a, b in ((1, 2), (0, 2), (0, 1))])
        else:
            s, n = mix(inside[:, 0] + tag), count[:, 0]
        out.append(s[np.lexsort((s, n))[spare:]] if spare else s)
        at += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the counts of elements by hash, in four bits or more an element (a power of two of bits, SKETCH at least).

    Two sketches of one length differ in at most as many bits as the sets in elements; one that is longer folds to half its length.
    """
    bits = max(SKETCH, 1 << (4 * len(own) - 1).bit_length())
    odd = np.bincount((mix(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two matrices of sketches differ, at the shorter one's length."""
    while x.shape[1] != y.shape[1]:
        if x.shape[1] > y.shape[1]:
            x, y = y, x
        half = y.shape[1] // 2
        y = y[:, :half] ^ y[:, half:]
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


class Sketches:
    """The sketches of many sets, those of one length together."""

    def __init__(self, size: np.ndarray, sketches: list[bytes]) -> None:
        self.size, length = size, np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.of = {}
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            self.of[n] = at, np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), n // 8)

    def allowed(self, n: int, own: bytes, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which sets may be similar enough to one of n elements, by sizes and sketches, and how many bits apart they are at least."""
        found, bits = [], []
        one = np.frombuffer(own, np.uint64)[None, :]
        for at, rows in self.of.values():
            fits = np.flatnonzero((self.size[at] * percent <= n * 100) & (n * percent <= self.size[at] * 100))
            if len(fits):
                apart = _apart(one, rows[fits])
                ok = apart * (100 + percent) <= (self.size[at[fits]] + n) * (100 - percent)
                found.append(at[fits[ok]])
                bits.append(apart[ok])
        return (np.concatenate(found), np.concatenate(bits)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_shingles, cls (null for an empty set)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for rows, texts in grouped(batches, text):
            own = document_sets(texts, width)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([class_of(x) if len(x) else None for x in own], pa.int64())], ["key", "n_shingles", "cls"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_shingles long, cls long")


def _sent(docs: DataFrame, text: str, owners: int, width: int, percent: int) -> DataFrame:
    """owner, blob: signatures by the range they are in. A blob has classes, sizes and how many signatures of 5 bytes each has."""

    def blobs(held):
        cls = np.array([c for c, _, _ in held], np.int64)
        size = np.array([n for _, n, _ in held], np.uint32)
        number = np.repeat(np.arange(len(held)), [len(s) for _, _, s in held])
        s = np.concatenate([s for _, _, s in held])
        owner = ((s >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        s, number, owner = s[order], number[order], owner[order]
        cut = np.searchsorted(owner, np.arange(owners + 1))
        names, data = [], []
        for o in range(owners):
            a, b = cut[o], cut[o + 1]
            if a < b:
                docs_, counts = np.unique(number[a:b], return_counts=True)
                five = s[a:b].view(np.uint8).reshape(-1, 8)[:, :5]
                names.append(o)
                data.append(np.array([len(docs_)], np.int64).tobytes() + cls[docs_].tobytes() + size[docs_].tobytes() + counts.astype(np.uint32).tobytes() + five.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["owner", "blob"])

    def run(batches):
        held, n, seen = [], 0, set()
        for _, texts in grouped(batches, text):
            for own in document_sets(texts, width):
                if not len(own) or (c := class_of(own)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                held.append((c, len(own), s := signatures(own, percent)))
                n += len(s)
                if n >= GATHERED:
                    yield blobs(held)
                    held, n = [], 0
        if held:
            yield blobs(held)

    return docs.select(text).mapInArrow(run, "owner int, blob binary")


def _groups(table: pa.Table, percent: int) -> pa.Table:
    """Of an owner: the groups of classes that share a signature, but for those within another group, with each member's leader."""
    parts = []
    for blob in table.column("blob").to_pylist():
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        counts = np.frombuffer(blob, np.uint32, n, 8 + 12 * n)
        five = np.zeros((int(counts.sum()), 8), np.uint8)
        five[:, :5] = np.frombuffer(blob, np.uint8, offset=8 + 16 * n).reshape(-1, 5)
        parts.append((five.view(np.uint64)[:, 0], np.repeat(np.frombuffer(blob, np.int64, n, 8), counts), np.repeat(np.frombuffer(blob, np.uint32, n, 8 + 8 * n), counts)))
    s, cls, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((cls, size, s))
    s, cls, size = s[order], cls[order], size[order]
    fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])))
    s, cls, size = s[fresh], cls[fresh], size[fresh].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    length = np.diff(np.append(begin, len(s)))
    name = np.add.reduceat(mix(cls.view(np.uint64)), begin)
    begin, length, name = begin[length > 1], length[length > 1], mix(name[length > 1])
    _, first = np.unique(name, return_index=True)
    bids, members, sizes, leaders = [], [], [], []
    holds: dict[int, set[int]] = {}  # of each class, the groups kept so far that it is in
    for i in first[np.argsort(-length[first], kind="stable")].tolist():
        a, b = begin[i], begin[i] + length[i]
        who = cls[a:b].tolist()
        if set.intersection(*(holds.get(c, set()) for c in sorted(who, key=lambda c: len(holds.get(c, ()))))):
            continue  # all its members are together in a larger group
        for c in who:
            holds.setdefault(c, set()).add(i)
        own = size[a:b]
        lead, at = np.zeros(len(own), np.int64), 0
        while at < len(own):  # sizes ascend: a leader serves all that aren't too large for it
            end = int(np.searchsorted(own, own[at] * 100 // percent, side="right"))
            lead[at:end] = at
            at = end
        bids.append(int(name[i].view(np.int64)))
        members.append(cls[a:b])
        sizes.append(own)
        leaders.append(cls[a:b][lead])
    many = pa.list_(pa.int64())
    trim()
    return pa.table([pa.array(bids, pa.int64()), pa.array(members, many), pa.array(sizes, many), pa.array(leaders, many)], ["bid", "members", "sizes", "leaders"])


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be similar enough, before any set is sent."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("of_a", "of_b"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            kind = np.fromiter((len(i) << 32 | len(j) for i, j in zip(x, y, strict=True)), np.int64, len(x))
            apart = np.zeros(len(x), np.int64)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                one, other = (np.frombuffer(b"".join([v[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1) for v in (x, y))
                apart[at] = _apart(one, other)
            ok = (n * percent <= m * 100) & (m * percent <= n * 100) & (apart * (100 + percent) <= (n + m) * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    slim = sets.select("cls", "size", "sketch")
    both = pairs.join(slim.withColumnsRenamed({"cls": "b", "size": "m", "sketch": "of_b"}), "b").join(slim.withColumnsRenamed({"cls": "a", "size": "n", "sketch": "of_a"}), "a")
    return both.select("a", "b", "n", "m", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Of each pair one set travels; the other is joined where it lies."""
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("of_b")), "b").join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _sketches(rows: list) -> Sketches:
    return Sketches(np.array([x["size"] for x in rows], np.int64), [x["sketch"] for x in rows])


def _pair_rows(a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _among(batches, percent: int, best: int | None):
    """Of two parts of a group's members outside its main component: pairs between components that sizes and sketches allow, or each member's best of them."""
    for batch in batches:
        for row in batch.to_pylist():
            one, other = row["one"], row["other"]
            others, root = _sketches(other), np.array([x["root"] for x in other], np.int64)
            cls = np.array([x["cls"] for x in other], np.int64)
            for x in one:
                j, apart = others.allowed(x["size"], x["sketch"], percent)
                other_root = root[j] != x["root"]
                j, apart = j[other_root], apart[other_root]
                if best is not None:
                    j = j[np.lexsort((j, apart))[:best]]
                if len(j):
                    yield _pair_rows([x["cls"]] * len(j), cls[j].tolist())


def _asked(batches, percent: int, best: int | None):
    """Of members of a component and classes that share a signature with some of it: the pairs that sizes and sketches allow, or the best of them."""
    for batch in batches:
        for row in batch.to_pylist():
            members, askers = row["members"], row["askers"]
            known = _sketches(members)
            for x in askers:
                j, apart = known.allowed(x["size"], x["sketch"], percent)
                if best is not None:
                    j = j[np.lexsort((j, apart))[:best]]
                if len(j):
                    yield _pair_rows([x["cls"]] * len(j), [members[k]["cls"] for k in j.tolist()])


def _open_pairs(each: DataFrame, links: DataFrame, sets: DataFrame, percent: int, best: int | None) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Pairs of classes that share a signature and aren't in one component yet, as far as they may be similar enough.

    A group's members outside its main component are compared among themselves, and with the main component as a whole: once,
    however many groups they share with it, and with so many of its members in a task. The saved tables behind the pairs come with them.
    """
    roots = saved(connected(links), "roots")
    placed = each.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    counts = placed.groupBy("bid", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bid").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("bid", "main", "roots")
    outside = saved(placed.join(main, "bid").filter("root <> main").select("bid", "cls", "size", "root", "main", "roots"), "outside")
    bits = sets.select("cls", "sketch")
    among = outside.filter("roots > 2").join(bits, "cls")
    cut = among.groupBy("bid").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("long").alias("parts"))
    among = among.join(cut, "bid").groupBy("bid", "parts", F.pmod("cls", "parts").alias("part")).agg(F.collect_list(F.struct("cls", "size", "root", "sketch")).alias("who"))
    one, other = (among.select("bid", F.col("part").alias(p), F.col("who").alias(w)) for p, w in (("p", "one"), ("q", "other")))
    met = one.join(other, "bid")
    pairs = (met if best is not None else met.filter("p <= q")).select("one", "other").mapInArrow(lambda b: _among(b, percent, best), "a long, b long")
    ask = outside.select("cls", "size", F.col("main").alias("root")).distinct()
    known = sets.select("cls", "sketch", "size").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    wanted = known.join(ask.select("root").distinct(), "root", "left_semi")
    members = _parts(wanted).groupBy("root", "part").agg(F.collect_list(F.struct("cls", "size", "sketch")).alias("members"))
    askers = _parts(ask.join(bits, "cls")).groupBy("root", "part").agg(F.collect_list(F.struct("cls", "size", "sketch")).alias("askers"))
    met = members.join(askers.select("root", "askers"), "root").select("members", "askers").mapInArrow(lambda b: _asked(b, percent, best), "a long, b long")
    return saved(pairs.unionByName(met).distinct(), "open"), (roots, outside)


def _parts(rows: DataFrame) -> DataFrame:
    """rows with the part of its root that a row is in; a part has about COMPARED rows."""
    parts = rows.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("long").alias("parts"))
    return rows.join(parts, "root").withColumn("part", F.pmod("cls", "parts"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has key, n_shingles, cls for each row of docs; links has the pairs of classes found similar.

    links connects any two classes that a chain of similar pairs connects; of a group of near copies it has no more pairs
    than are needed for that.
    """
    rows = saved(classes(docs, key, text, width), "classes")
    owners = owners_for(docs, text, OWNED)
    groups = _sent(docs, text, owners, width, percent).groupBy("owner").applyInArrow(lambda t: _groups(t, percent), "bid long, members array<long>, sizes array<long>, leaders array<long>")
    groups = saved(groups.dropDuplicates(["bid"]), "groups")
    each = groups.select("bid", F.explode(F.arrays_zip("members", "sizes", "leaders")).alias("x")).select("bid", F.col("x.members").alias("cls"), F.col("x.sizes").alias("size"), F.col("x.leaders").alias("lead"))
    wanted = each.select("cls").distinct().join(rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("key")), "cls")

    def sets_of(batches):
        for part, texts in grouped(batches, text):
            own = document_sets(texts, width)
            fits = [i for i, x in enumerate(own) if len(x) and class_of(x) == part.column(0)[i].as_py()]
            columns = [pa.array([part.column(0)[i].as_py() for i in fits], pa.int64()), pa.array([own[i].view(np.int64) for i in fits], pa.list_(pa.int64())), pa.array([len(own[i]) for i in fits], pa.int64()), pa.array([sketch(own[i]) for i in fits], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "elements", "size", "sketch"])

    chosen = docs.select(F.col(key).alias("key"), text).join(wanted, "key").select("cls", text)
    sets = saved(chosen.mapInArrow(sets_of, "cls long, elements array<long>, size long, sketch binary"), "sets")
    if not sets.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # a key that several rows have
        sets = saved(sets.dropDuplicates(["cls"]), "sets")
    stars = saved(each.filter("cls <> lead").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct(), "stars")
    likely = saved(_bounded(stars, sets, percent), "likely")
    links = saved(_verified(likely, sets, percent), "links")
    released(likely)
    tried, old = stars, [stars, groups, sets]
    for best in (BEST, None):  # likely pairs first: what they link needn't be compared again
        found, behind = _open_pairs(each, links, sets, percent, best)
        more = saved(found.join(tried, ["a", "b"], "left_anti"), "across")
        released(found, *behind)
        links = links.unionByName(saved(_verified(more, sets, percent), "links"))
        tried = tried.unionByName(more)
        old.append(more)
    released(*old)
    return rows, links


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the smallest key that links lead to, or the row's own).

    Null, empty or wordless text: an empty set, which links with nothing. Fewer words than a shingle: one shingle of all.
    Texts of equal sets link; repeated rows and equal keys give a row each. Very long texts are taken whole. An empty table
    gives no rows; other columns aren't read.
    """
    rows, links = join(docs, key, text, width, percent)
    roots = connected(links)
    named = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("least")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = saved(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = named.join(least, "root").select("cls", "component_id")
    out = rows.join(groups, "cls", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest key (then of the least hash of the text); all columns stay.

    Rows are told apart by key and text, so texts that share a key stay or go on their own; a null key counts as the largest.
    Rows without words are linked with nothing and stay; of rows that are equal in key and text one stays. Other columns may
    have any names and values. An empty table gives no rows.
    """
    id_, gone_, again_ = unused(docs, "id_"), unused(docs, "gone_"), unused(docs, "again_")
    named = docs.withColumn(id_, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash")))
    groups = saved(near_groups(named.select(id_, text), id_, text), "near")
    kept = named.join(groups.filter(F.col(id_) != F.col("component_id")).select(F.col(id_).alias(gone_)).distinct(), F.col(id_).eqNullSafe(F.col(gone_)), "left_anti")
    repeated = saved(groups.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(id_).alias(again_)), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    same = F.col(id_).eqNullSafe(F.col(again_))
    once = kept.join(repeated, same, "left_semi").dropDuplicates([id_])
    return kept.join(repeated, same, "left_anti").unionByName(once).select(docs.columns)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n_shingles + y.n_shingles - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
