"""Each stage of the corpus pipeline against brute force over its own input, and the whole run."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emporio.llm import cotraining, packing
from emporio.llm.common import stored

from .conftest import CLASHING, SCHEMA, messy_rows, same_columns, words
from .test_dedup import brute_char_lines, exact_classes
from .test_scan import brute_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with NULLs, empty and long texts, repeated rows, near copies, benchmark passages and clashing names."""
    base = tmp_path_factory.mktemp("corpus")
    rng = random.Random(31)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(1, words(rng, 14)), (2, words(rng, 6)), (None, words(rng, 12)), (4, None), (5, "")]
    rows = [r for r in messy_rows() if r[0] != 11 and r[0] is not None]
    rows += [(101, words(rng, 30) + " " + items[0][1] + " " + words(rng, 30), "en", "a", 1),
             (102, items[1][1], "en", "a", 1), (103, words(rng, 20) + "\n" + items[2][1].upper() + ".", None, None, None),
             (104, words(rng, 3000), "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(small.withColumn("doc_id", F.col("doc_id") + 10_000))
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumn("doc_id", F.col("doc_id") + 10_000)
    more = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic").union(more).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def texts_of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def brute_quality(spark, docs, folder):
    """The learned model applied to one row after another."""
    o = cotraining.Options()
    m = cotraining.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"), o)
    kept = collections.Counter()
    for r in docs.collect():
        t = (r["text"] or "").encode()
        found = cotraining.evidence([m.words[w] for w in cotraining.terms_of(cotraining.words_of(t)) if w in m.words])
        a, b = m.odds([found], np.array([cotraining.shares_of(t)]), [cotraining.meta_of(r["lang"], r["source"], r["n_chars"])])
        if cotraining.sigmoid(a + b - m.prior)[0] >= o.threshold:
            kept[r["doc_id"], r["text"]] += 1
    return kept


def brute_lines(docs):
    """Texts without the repeated lines; documents that lose their last line with a word go."""
    rows = docs.select("doc_id", "text").collect()
    gone = set()
    for g in brute_char_lines(rows).values():
        gone |= {(d[1], t, p) for d, t, p, _ in sorted(g, key=lambda x: (x[0], x[2]))[1:]}
    out = collections.Counter()
    for i, t in rows:
        lines = None if t is None else t.split("\n")
        left = lines and [x for p, x in enumerate(lines) if (i, t, p) not in gone]
        if lines is None or len(left) == len(lines) or re.search(r"\S", "\n".join(left)):
            out[i, None if t is None else "\n".join(left)] += 1
    return out


def test_each_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "near-dedup", "decontamination", "packing"]

    def run(name, docs):
        out = stored(stages[name](spark, docs, folder), "test-stage")
        assert same_columns(out, docs), name
        assert out.select(CLASHING[0]).distinct().collect() in ([], [(f"own {CLASHING[0]}",)])
        return out

    good = run("quality classifier", docs)
    assert texts_of(good) == brute_quality(spark, docs, folder)

    # stages are judged on their own input, so each gets all documents here
    lined = run("line dedup", docs)
    assert texts_of(lined) == brute_lines(docs)
    before = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    for r in lined.collect():
        assert r["n_chars"] == before[r["doc_id"]] or r["n_chars"] == len(r["text"])

    near = run("near-dedup", docs)
    classes = exact_classes(docs)
    assert collections.Counter(r["doc_id"] for r in near.collect()) == collections.Counter(
        {c: 1 for _, c, n in classes if n > 1} | {i: 1 for i, _, n in classes if n == 1})

    clean = run("decontamination", docs)
    hit = {i for (i, _, _, _, _, bad) in brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items) if bad}
    assert hit >= {101, 102, 103}
    assert texts_of(clean) == collections.Counter({k: n for k, n in texts_of(docs).items() if k[0] not in hit})

    packed = stages["packing"](spark, docs, folder).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer()[0])
    sizes = collections.Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert sizes == want
    room = collections.defaultdict(list)
    for r in packed:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in room.values():
        assert sum(n for _, n in own) <= 1024
        assert sorted(own) == [(sum(n for _, n in sorted(own)[:k]), n) for k, (_, n) in enumerate(sorted(own))]


def test_run_chains_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "test-chain")
    kept = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == kept


def test_stages_on_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    # without labels and items nothing is rejected for them
    some = spark.createDataFrame([(1, "a text of its own", "en", "a", 17)], SCHEMA)
    for name in ("quality classifier", "decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, some, str(tmp_path)).count() == 1
