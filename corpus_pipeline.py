"""A training-corpus pipeline: five stages over ``documents``.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result
is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``.

1. quality: documents that the compression classifier predicts as bad go
   (fitted on the labels of the same folder);
2. language: documents without a letter and documents whose best language
   has a probability below ``MIN_LANG_SCORE`` go (where no row has a language
   to learn from, only documents without a letter);
3. near duplicates: of every group linked by word 5-grams of Jaccard
   similarity 0.8 or more, the document with the smallest id stays;
4. repeats: words in 50-word windows that also start in a document of
   smaller id go; ``n_chars`` follows the new text, and a document that
   lost all its words stays with an empty text;
5. packing: power-of-two pieces of at most 1024 tokens.

Extra columns pass through the first four stages untouched, and so do
repeated rows (rows that share an id are one document); an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import jaccard, langid, packing, quality, substring
from trailframe.llm.common import crc_mod, prepare, table
from trailframe.session import ensure_checkpoint_dir

#: least probability of the best language; below it the language is unknown
MIN_LANG_SCORE = 0.5
#: names of the operators' columns inside a stage, so that none of the documents' own is replaced
OWN = ("trailframe_1_", "trailframe_2_", "trailframe_3_")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = quality.fit(docs, quality.teaching(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model, names=OWN[:2])
    return scored.filter(F.col(OWN[1]) == 1).drop(*OWN)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    if not model["classes"]:
        return langid.with_letters(docs)
    found = langid.predict(docs, model, names=OWN[:2])
    return found.filter((F.col(OWN[0]) != langid.UND) & (F.col(OWN[1]) >= MIN_LANG_SCORE)).drop(*OWN)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.keep_one(docs, jaccard.jaccard_groups(docs))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = substring.remove_repeats(docs, names=OWN)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(OWN[1]) > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.drop(*OWN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", repeat_stage),
    ("packing", packing_stage),
]

#: models and hashes have no SQL form; the tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to
    the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailframe-llm/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
