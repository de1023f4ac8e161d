"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, index permutations, one join.

Each source's words are one stream, packed into blocks of BLOCK words. A mix is a sequence of slots, one block each, dealt to
output shards of SLOTS slots. Every shard draws how many of its slots each source gets (a multinomial draw, from a
pseudorandom number per slot); a source's n-th slot over all shards reads the block that a pseudorandom permutation of its
block indices gives for n, a new permutation for each pass. So the draws decide which shard gets which blocks. Over all shards
a source may draw more or less than its target: what it drew beyond it, in the last shards, goes to the sources that drew too
little, in the same shards, so every source is taken to its target to the word. Plan and blocks meet in a join on
(source, index).
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faktum.llm.store import repeated, saved, unused

#: Words in a block, slots in an output shard, weights by rank of the source, passes over a source at most.
BLOCK, SLOTS, WEIGHTS, MOST = 2048, 64, (5, 2, 1), 3
#: Rows of a source that one task brings into order.
RUN_ROWS = 2_000
#: A table of sources of at most so many rows (under 10 MB) is broadcast.
BROADCAST_SOURCES = 1 << 16
#: What separates words: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_P = 2_147_483_647


def prf(x: str, k: str) -> str:
    """SQL for a pseudorandom whole number below 2^31 - 1 from x >= 0 and k; reads alike in Spark and DuckDB."""
    y = f"((({x}) % {_P} * 48271 + {k}) % {_P})"
    return f"(({y} * ({y} + 16807) + {k}) % {_P})"


def div(a: str, b: str) -> str:
    return f"CAST((({a}) - ({a}) % ({b})) / ({b}) AS BIGINT)"


def permute_steps() -> list[tuple[str, str]]:
    """Columns to add one after the other to rows with j, n, seed (0 <= j < n): the last, x4, is a permutation of j for each seed.

    Each round turns the index by a pseudorandom step and then mixes its two digits, of bases a and b with a * b <= n;
    indices beyond a * b stay in place until a turn moves them. Each round is one-to-one.
    """
    steps = [("pa", "CAST(floor(sqrt(n)) AS BIGINT)"), ("pb", div("n", "greatest(pa, 1)")), ("x0", "j")]
    for r in range(1, 5):
        steps += [
            (f"t{r}", f"CASE WHEN n < 2 THEN j ELSE (x{r - 1} + {prf('seed', str(1000 + r))}) % n END"),
            (f"r{r}", f"t{r} % greatest(pb, 1)"),
            (f"l{r}", f"({div(f't{r}', 'greatest(pb, 1)')} + {prf(f'r{r}', f'(seed + {2000 + r})')}) % greatest(pa, 1)"),
            (f"x{r}", f"CASE WHEN t{r} < pa * pb THEN l{r} * pb + (r{r} + {prf(f'l{r}', f'(seed + {3000 + r})')}) % greatest(pb, 1) ELSE t{r} END"),
        ]
    return steps


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tie: str | None = None) -> DataFrame:
    """key, source, tie (orders rows of one key and size), size: the number of words, 0 for null."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), (F.col(tie) if tie else F.lit(0).cast("long")).alias("tie"), F.coalesce(F.expr(f"regexp_count({text}, r'{WORD}')"), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: sid (rank by code point, null last), size, n, target, blocks, quota, full, rest, slots.

    Targets share all words by weight; those over MOST times their source's size stop there and their excess goes to the
    others by weight. With sources in order of cap/weight this is one level for all that stay below their cap, found by
    running sums over the table of sources (one row a source).
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("size"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    t = (
        t.withColumn("place", F.row_number().over(rank))
        .withColumn("left", F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("below", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    first = F.min(F.when(F.col("below"), F.col("place"))).over(everything)
    level = F.min_by(F.when(F.col("below"), F.col("level")), F.when(F.col("below"), F.col("place"))).over(everything)
    t = t.withColumn("target", F.when(first.isNull() | (F.col("place") < first), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    t = t.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
    size1 = F.greatest(F.col("size"), F.lit(1))
    t = t.withColumn("full", F.floor(F.col("quota") / size1).cast("long")).withColumn("rest", F.col("quota") % size1)
    t = t.withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("from", F.coalesce(F.sum("slots").over(before), F.lit(0))).select("sid", "source", "size", "n", "target", "blocks", "quota", "full", "rest", "slots", "from")


def _in_interval(points: DataFrame, at: str, spans: DataFrame, start: str, length: str, total: int, n: int) -> DataFrame:
    """Each point joined with the span that holds it, by an equal join on cells of the line."""
    cell = max(1, total // (4 * max(1, n)))
    spans = spans.filter(F.col(length) > 0).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(start) + F.col(length) - 1) / cell))))
    spans = F.broadcast(spans) if n <= BROADCAST_SOURCES else spans
    joined = points.withColumn("_cell", F.floor(F.col(at) / cell)).join(spans, "_cell")
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length))).drop("_cell")


def plan(sources: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """The mix: shard, sid, nth (of the source's slots), turn (pass over the source), block, words (of the block, from its start)."""
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    slot = spark.range(total).select(F.col("id"), F.floor(F.col("id") / slots).alias("shard"), F.expr(f"({prf('id', '11')} * {_P} + {prf('id', '23')}) % {max(1, total)}").alias("ticket"))
    drawn = _in_interval(slot, "ticket", sources.select("sid", "slots", "from"), "from", "slots", total, n)
    counts = saved(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("count")), "draws")
    running = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    nth = counts.withColumn("start", F.coalesce(F.sum("count").over(running), F.lit(0))).select("shard", "sid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("nth"))
    got = sources.select("sid", "slots").join(counts.groupBy("sid").agg(F.sum("count").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    balance = got.withColumn("over", F.greatest(F.col("got") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
    balance = saved(balance.withColumn("over_from", F.coalesce(F.sum("over").over(before), F.lit(0))).withColumn("under_from", F.coalesce(F.sum("under").over(before), F.lit(0))), "balance")
    short = balance.agg(F.coalesce(F.sum("under"), F.lit(0))).first()[0]
    small = F.broadcast(balance) if n <= BROADCAST_SOURCES else balance
    nth = nth.join(small.select("sid", "slots", "over_from"), "sid")
    kept = nth.filter("nth < slots").select("shard", "sid", "nth")
    spare = nth.filter("nth >= slots").select("shard", (F.col("over_from") + F.col("nth") - F.col("slots")).alias("spare"))
    moved = _in_interval(spare, "spare", balance.select("sid", "got", "under", "under_from"), "under_from", "under", short, n).select("shard", "sid", (F.col("got") + F.col("spare") - F.col("under_from")).alias("nth"))
    about = sources.select("sid", "size", "blocks", "full", "rest")
    out = saved(kept.unionByName(moved).join(F.broadcast(about) if n <= BROADCAST_SOURCES else about, "sid"), "slots")
    out = out.withColumn("turn", F.floor(F.col("nth") / F.col("blocks"))).withColumn("j", F.col("nth") % F.col("blocks")).withColumn("n", F.col("blocks") - 1).withColumn("seed", F.col("sid") * 31 + F.col("turn"))
    for name, sql in permute_steps():
        out = out.withColumn(name, F.expr(sql))
    last = F.col("j") == F.col("blocks") - 1  # the short block of a source is the last of each pass
    index = F.when(last, F.col("j")).otherwise(F.col("x4"))
    whole = F.when(last, F.col("size") - F.col("j") * block).otherwise(F.lit(block))
    words = F.when((F.col("turn") == F.col("full")) & (F.col("rest") - F.col("j") * block < block), F.col("rest") - F.col("j") * block).otherwise(whole)
    # written here: a condition on the index must not be pushed through the steps, each of which would repeat the one before
    return saved(out.select("shard", "sid", "nth", "turn", index.cast("long").alias("block"), words.cast("long").alias("words")), "plan")


def _placed(rows: DataFrame, sources: DataFrame, n_sources: int, total: int) -> DataFrame:
    """rows with sid, source_size, target, start: where the row's words begin in its source's stream.

    A stream is in runs, by the key's remainder, and in a run by key. A run's rows are ordered in one task; runs begin where
    sums over runs say. So a source with any share of the rows is spread over as many tasks as it needs.
    """
    runs = 1 + total // RUN_ROWS
    s = sources.select(F.col("source").alias("_s"), "sid", F.col("size").alias("source_size"), "target")
    known = rows.join(F.broadcast(s) if n_sources <= BROADCAST_SOURCES else s, rows["source"].eqNullSafe(s["_s"])).drop("_s")
    known = known.withColumn("run", F.pmod(F.coalesce(F.col("key").cast("long"), F.lit(0)), F.lit(runs)))
    sums = known.groupBy("sid", "run").agg(F.sum("size").alias("in_run"))
    sums = sums.withColumn("run_from", F.coalesce(F.sum("in_run").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_run")
    inside = Window.partitionBy("sid", "run").orderBy(F.col("key").asc_nulls_first(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("in_front", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "run"]).withColumn("start", F.col("run_from") + F.col("in_front"))


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, slots: int = SLOTS, tie: str | None = None) -> DataFrame:
    """key, tie, size, source_size, target, sid, start, block, shard, nth, turn, begin, take: each use that the mix makes of a document's words.

    A document that the mix doesn't use has one row with null nth and take 0. Documents without words have start null.
    """
    rows = saved(sized(docs, key, text, source, tie), "sized")
    sources = saved(targets(rows, block), "sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = _placed(rows, sources, n_sources, total)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    parts = placed.withColumn("start", F.when(F.col("size") > 0, F.col("start"))).withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    joined = parts.join(plan(sources, block, slots), ["sid", "block"], "left")
    begin, end = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    take = F.coalesce(F.greatest(F.least(end, F.coalesce(F.col("words"), F.lit(0))) - begin, F.lit(0)), F.lit(0)).cast("long")
    first_word = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    return joined.select("key", "tie", "size", "source_size", "target", "sid", "start", "block", "shard", "nth", "turn", first_word.alias("begin"), take.alias("take"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken, first_shard, last_shard (null if nothing is taken).

    Null or empty text: size 0, taken 0. A null source is a source. Rows of equal key and size count one by one. The largest
    document may lie in many blocks and is taken from each of them. Reruns agree: nothing depends on how rows lie in
    partitions. No rows in, no rows out. Other columns aren't read.
    """
    used = pieces(docs, key, text, source, block, slots)
    shard = F.when(F.col("take") > 0, F.col("shard"))
    # (sid, start) is one document with words; equal documents without words are counted
    uses = used.groupBy("sid", "start", "key", "size", "source_size", "target").agg(F.sum("take").alias("taken"), F.min(shard).alias("first_shard"), F.max(shard).alias("last_shard"), F.when(F.col("start").isNull(), F.count(F.lit(1))).otherwise(1).alias("_n"))
    return repeated(uses, "_n", "_copy").select(F.col("key").alias(key), "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", block: int = BLOCK, slots: int = SLOTS, shard: str | None = None) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken whole, or for each part of it.

    A part's text is the taken words with the white space after each; chars, if docs has it, is the length of the text given.
    shard names a further column with the output shard that drew the words; without it a pass over a document is one row when
    all of it is taken. Null and empty texts have no words and aren't taken; nor are documents that the mix passes over. Rows
    that repeat or share a key count one by one, each with its own other columns, whatever their names. No rows in, no rows out.
    """
    tie, words = unused(docs, "tie_"), unused(docs, "words_")
    hashed = [F.to_json(F.col(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in docs.schema.fields]
    named = docs.withColumn(tie, F.xxhash64(*hashed))
    used = pieces(named, key, text, source, block, slots, tie=tie).filter("take > 0")
    use = ["key", "tie", "sid", "start", "size", "turn"] + (["shard"] if shard else [])
    per = used.groupBy(*use).agg(F.sum("take").alias("got"), F.collect_list(F.struct("begin", "take")).alias("parts"))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("begin"), F.col("size").alias("take")))
    one = F.explode(F.when(F.col("got") == F.col("size"), whole).otherwise(F.col("parts"))).alias("part")
    rows = per.select(F.col("key").alias("k"), F.col("tie").alias("t"), one, *(["shard"] if shard else []))
    texts = named
    if not named.groupBy(key, tie).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # equal rows; each use is joined to one of them
        texts = named.dropDuplicates([key, tie])
    joined = texts.join(rows, (texts[tie] == rows["t"]) & texts[key].eqNullSafe(rows["k"]))
    taken = F.array_join(F.slice(F.regexp_extract_all(texts[text], F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1), (rows["part.begin"] + 1).cast("int"), rows["part.take"].cast("int")), "")
    out = joined.select(*[texts[c] for c in docs.columns], F.when(rows["part.begin"] < 0, texts[text]).otherwise(taken).alias(words), *([rows["shard"].alias(tie)] if shard else []))
    final = [F.col(words).alias(text) if c == text else F.length(words).cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*final, *([F.col(tie).alias(shard)] if shard else []))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix of all documents takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "text", "source"))


def _oracle() -> str:
    nested = "placed_slots"
    for name, sql in permute_steps():
        nested = f"(SELECT *, {sql} AS {name} FROM {nested})"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {MOST} * size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, sid) AS place,
  (sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s1),
s3 AS (SELECT *, min(CASE WHEN level * weight <= cap THEN place END) OVER () AS p0,
  arg_min(level, place) FILTER (WHERE level * weight <= cap) OVER () AS lam FROM s2),
s4 AS (SELECT *, CASE WHEN p0 IS NULL OR place < p0 THEN cap::DOUBLE ELSE lam * weight END AS target FROM s3),
s AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota, CAST(ceil(size / {BLOCK}) AS BIGINT) AS blocks FROM s4),
slots AS (SELECT sid, size, blocks, quota // greatest(size, 1) AS full_, quota % greatest(size, 1) AS rest,
  (quota // greatest(size, 1)) * blocks + CAST(ceil((quota % greatest(size, 1)) / {BLOCK}) AS BIGINT) AS slots FROM s),
f AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS from_ FROM slots),
ids AS (SELECT unnest(range(0, (SELECT sum(slots)::BIGINT FROM slots))) AS id, (SELECT greatest(sum(slots), 1)::BIGINT FROM slots) AS total),
tickets AS (SELECT id // {SLOTS} AS shard, ({prf('id', '11')} * {_P} + {prf('id', '23')}) % total AS ticket FROM ids),
draws AS (SELECT shard, sid, count(*) AS n FROM tickets JOIN f ON ticket >= from_ AND ticket < from_ + slots GROUP BY shard, sid),
begun AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM draws),
drawn AS (SELECT shard, sid, unnest(range(start, start + n)) AS nth FROM begun),
got AS (SELECT f.sid, f.slots, coalesce(sum(n), 0)::BIGINT AS got FROM f LEFT JOIN draws ON draws.sid = f.sid GROUP BY f.sid, f.slots),
bal AS (SELECT *, greatest(slots - got, 0) AS under,
  coalesce(sum(greatest(got - slots, 0)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS over_from,
  coalesce(sum(greatest(slots - got, 0)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS under_from FROM got),
spare AS (SELECT shard, over_from + nth - slots AS spare FROM drawn JOIN bal USING (sid) WHERE nth >= slots),
dealt AS (SELECT shard, sid, nth FROM drawn JOIN bal USING (sid) WHERE nth < slots
  UNION ALL SELECT shard, sid, got + spare - under_from FROM spare JOIN bal ON spare >= under_from AND spare < under_from + under),
nths AS (SELECT slots.*, dealt.shard, dealt.nth FROM dealt JOIN slots USING (sid)),
placed_slots AS (SELECT *, nth // blocks AS turn, nth % blocks AS j, blocks - 1 AS n, sid * 31 + nth // blocks AS seed FROM nths),
mixed AS (SELECT sid, shard, CASE WHEN j = blocks - 1 THEN j ELSE x4 END AS block,
  CASE WHEN turn = full_ AND rest - j * {BLOCK} < {BLOCK} THEN rest - j * {BLOCK} WHEN j = blocks - 1 THEN size - j * {BLOCK} ELSE {BLOCK} END AS words FROM {nested}),
runs AS (SELECT 1 + count(*) // {RUN_ROWS} AS k FROM d),
p AS (SELECT d.doc_id, d.size, s.size AS source_size, s.target, s.sid,
  coalesce(sum(d.size) OVER (PARTITION BY s.sid ORDER BY ((d.doc_id % k) + k) % k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN runs),
b AS (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM p WHERE size > 0),
u AS (SELECT b.doc_id, m.shard, greatest(0, least(b.start + b.size - b.block * {BLOCK}, {BLOCK}, m.words) - greatest(b.start - b.block * {BLOCK}, 0)) AS take
  FROM b JOIN mixed m ON b.sid = m.sid AND b.block = m.block),
t AS (SELECT doc_id, sum(take)::BIGINT AS taken, min(shard) FILTER (WHERE take > 0) AS first_shard, max(shard) FILTER (WHERE take > 0) AS last_shard FROM u GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken, t.first_shard, t.last_shard FROM p LEFT JOIN t ON p.doc_id = t.doc_id
"""


OP3_SQL = _oracle()
