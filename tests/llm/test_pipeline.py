"""Each stage on what the one before gave, against brute force; then all of them in a row; and odd tables."""

import hashlib
import random
import struct
from collections import Counter

import public_tokenizers
import pytest
from test_ngram_join import brute as near
from tokenizers import Tokenizer

import corpus_pipeline
from faktum.llm import langid, mixing


def digests(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for i, t in texts:
        x = library.encode(t or "", add_special_tokens=False).ids
        out[i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    r = random.Random(1)
    good = [d for d in docs if d[1] and len(d[1].split()) > 60][:12]
    for k, (_, text, lang, source, _) in enumerate(good):
        words = text.split()
        words[r.randrange(len(words))] = "changed"
        docs += [(5000 + k, text, lang, source, len(text)), (6000 + k, " ".join(words), lang, None, len(text))]
    docs += [(7000, None, None, None, None), (7001, "", "en", "x", 0), (7002, "12 34 ?!", None, "x", 8), (docs[0][0], *docs[0][1:]), (None, good[0][1] + " and more", "en", "y", 9)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [[tuple(x) for x in t.collect()] for t in tables]
    assert all(t.columns == docs.columns for t in tables[:5])
    # language ID: whole rows stay, those that the model tells
    told = langid.identify(docs, langid.train_for(docs), docs.columns).collect()
    assert Counter(rows[1]) == Counter(tuple(x)[:5] for x in told if x.lang_pred != "und" and x.score >= 0.35)
    clean = [x for x in rows[0] if x[2] and x[1] and len(x[1].split()) > 60]
    assert len([x for x in rows[1] if x in clean]) >= 0.97 * len(clean) and not any(x[0] in (7000, 7001, 7002) for x in rows[1])
    # exact dedup
    largest = {}
    for x in rows[1]:
        largest[x[1]] = max(largest.get(x[1], -1), -1 if x[0] is None else x[0])
    assert sorted(((-1 if x[0] is None else x[0]), x[1]) for x in rows[2]) == sorted((i, t) for t, i in largest.items())
    assert set(rows[2]) <= set(rows[1])
    # n-gram Jaccard join
    groups = near([(10**9 if x[0] is None else x[0], x[1]) for x in rows[2]])
    assert sorted(10**9 if x[0] is None else x[0] for x in rows[3]) == sorted(i for i, _, least in groups if i == least)
    assert set(rows[3]) <= set(rows[2]) and len(rows[3]) < len(rows[2])
    # mixing: as many words of each document as the operator says
    want = {x.doc_id: x.taken for x in mixing.mix(tables[3]).collect() if x.taken}
    words = Counter()
    for x in rows[4]:
        words[x[0]] += len(x[1].split())
        assert x[4] == len(x[1])
    assert words == want
    # encoding, and the whole pipeline
    assert Counter(rows[5]) == digests([(x[0], x[1]) for x in rows[4]])
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(rows[5])


def test_every_stage_takes_odd_tables(spark, folder):
    columns = "doc_id long, text string, lang string, source string, n_chars long, part string, _text int, _sha string, id_ int, `key` long, cls double, size map<string,int>"
    rows = [(1, "the and of the is", "en", None, 5, "p", 1, "s", 2, 3, 0.5, {"a": 1}), (None, None, None, None, None, None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns
        assert stage(spark, odd, folder).count() <= 2
        assert stage(spark, odd.limit(0), folder).count() == 0
    assert corpus_pipeline.encode(spark, odd.limit(0), folder).count() == 0
