"""Quality and language models on held-out rows, and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from test_llm_pairs import brute_jaccard, brute_substring
from trailframe.llm import langid, quality, queries, token_counts
from trailframe.llm.common import hash_sample, table
from trailframe.llm.segments import read_tokenizer

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op1_quality(spark, MID).collect()}
    assert len(got) == table(spark, MID, "documents").count()
    assert all(r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
               for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in table(spark, MID, "labels").collect()
            if crc(r.doc_id) % 3 == 1]
    assert np.mean([a == b for a, b in held]) >= 0.93


def test_quality_cases(spark):
    docs = spark.createDataFrame(
        [(i, ("fine words here and there number %d. " % i if i % 2 else "JUNK!! %d$$$ ### " % i) * 20, 1) for i in range(80)]
        + [(200, None, 1), (201, "", 1), (None, "fine words", 1), (202, "x" * 300_000, 1), (1, "again", 1)],
        "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, 0), (None, 1), (4, None)],
                                   "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.text != "again"}
    assert np.mean([by[i].predicted == i % 2 for i in range(80)]) == 1.0
    assert by[200].score == by[201].score
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, MID).collect()}
    docs = table(spark, MID, "documents").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [got[r.doc_id].lang_pred == r.lang for r in docs if crc(r.doc_id) % 4 == 2]
    assert np.mean(held) >= 0.95


def test_language_cases(spark):
    rows = [(i, ["the cat and the dog", "der hund und die katze", "le chat et le chien"][i % 3] + f" {i}",
             ["en", "de", "fr"][i % 3], 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "123 !? 🎉", None, 1), (None, "the dog", "de", 1),
             (103, "DER HUND", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == ["en", "de", "fr"][i % 3] for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "de" and got[None].lang_pred == "en"
    assert langid.predict(docs, langid.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def test_document_frequencies_cover_all_rows(spark):
    texts = ["ab", "ab ab", None, "12", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts, n = langid.document_frequencies(df, "text")
    want = np.zeros(langid.BUCKETS, dtype=np.int64)
    for t in texts:
        g = np.unique(langid.grams(t))
        want[g] += 1
    assert n == 3 and (counts == want).all()


def test_hash_sample_is_spread(spark):
    ids = hash_sample(spark.range(200_000), "id", 2000).toPandas().id.to_numpy()
    assert 1800 < len(ids) < 2200
    assert (np.histogram(ids, bins=10, range=(0, 200_000))[0] > 130).all()


def test_fits_scan_in_parallel(spark, monkeypatch):
    """Only samples go to one task, behind an exchange; no scan is one task."""
    plans = []
    docs = table(spark, SF, "documents")
    real = type(docs).mapInArrow

    def seen(self, *a, **k):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, *a, **k)

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    quality.fit(docs, table(spark, SF, "labels"))
    langid.fit(docs)
    token_counts.frequent_lengths(docs, read_tokenizer(None, "byte_bpe_50k.json"))
    assert len(plans) >= 4 and not any("Coalesce" in p for p in plans)
    assert sum("Exchange SinglePartition" in p or "RoundRobinPartitioning(1)" in p for p in plans) == 3


def test_language_stage_without_languages(spark):
    """Nothing to learn from: only documents without a letter go."""
    rows = [(i, t, None, "x", 1) for i, t in enumerate(["one two", "", None, "12 34 !!", "é", "中文"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5] and kept.columns == docs.columns


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = table(spark, MID, "documents").withColumn("score", F.lit(1))
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, out[-1], MID).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_return_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "ngram_jaccard_join", "substring_dedup", "packing"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    assert all(b.count() <= a.count() for a, b in zip(stages[:4], stages[1:5]))


def test_quality_stage_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    rows = table(spark, MID, "labels").collect()
    assert np.mean([(r.doc_id in kept) for r in rows if r.quality == 1]) >= 0.97
    assert np.mean([(r.doc_id in kept) for r in rows if r.quality == 0]) <= 0.2
    assert stages[2].count() >= 0.99 * stages[1].count()


def test_dedup_stages_equal_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i for i, (_, c) in brute_jaccard(rows).items() if c == i}
    assert {r.doc_id for r in stages[3].collect()} == want
    rows = {r.doc_id: r.text for r in stages[3].collect()}
    cut = brute_substring(list(rows.items()))
    for r in stages[4].collect():
        n, gone, _ = cut[r.doc_id]
        assert len(r.text.split()) == n - gone
        assert r.text == rows[r.doc_id] if not gone else r.n_chars == len(r.text)


def test_packing_stage_packs_all(stages):
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == \
        {r.doc_id for r in stages[4].collect()}


def test_run_is_registered(spark):
    assert "pipeline" in E.queries() and corpus_pipeline.ORACLE_SQL is None
    df = corpus_pipeline.run(spark, SF)
    assert df.count() > 0 and {"doc_id", "start", "length", "sequence_id"} <= set(df.columns)


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0, name
