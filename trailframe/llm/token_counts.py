"""Operator 3: token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table of the token counts of frequent
pre-token segments (at most ``table_size`` entries, taken from a sample of
at most about ``sample_rows`` documents); tier two is a cache of each
Python worker for the segments the table lacks, encoded by the library in
batches.  Segments are never shuffled.  The table only saves work: any
content gives the same counts.

Cases: null and empty texts have 0 bytes and 0 tokens; a null ``doc_id``
stays null; repeated rows are counted each; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import hash_sample
from trailframe.llm.segments import SegmentEncoder, read_tokenizer, slices, worker_encoder

TABLE_SIZE = 65_536
SAMPLE_ROWS = 4_000
LIMIT = 1024


def frequent_lengths(src: DataFrame, spec_json: str, table_size: int = TABLE_SIZE,
                     sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """``{segment: tokens}`` of the most frequent segments of a bounded
    sample; the table is scanned in parallel, only the sample goes to one
    task, which counts and encodes it, and at most ``table_size`` rows
    reach the driver."""
    sample = hash_sample(src, "doc_id", sample_rows).select("text").repartition(1)

    def run(it):
        enc = SegmentEncoder(spec_json, count=True)
        seen: Counter = Counter()
        for batch in it:
            for t in batch.column(0).to_pylist():
                if t and not enc.whole(t):
                    seen.update(t.split(" ")[1:])
        top = [s for s, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size]]
        for a in range(0, len(top), 8192):
            part = top[a:a + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array(enc.library([" " + s for s in part]), pa.int32())],
                names=["segment", "tokens"])

    got = sample.mapInArrow(run, "segment string, tokens int").toArrow()
    return dict(zip(got.column("segment").to_pylist(), got.column("tokens").to_pylist()))


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT,
                 id_col: str = "doc_id", text_col: str = "text",
                 table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, whole texts,
    no special tokens added."""
    spark = docs.sparkSession
    spec_json = read_tokenizer(tokenizer, "byte_bpe_50k.json")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = frequent_lengths(src, spec_json, table_size, sample_rows)
    shared = spark.sparkContext.broadcast((spec_json, frequent))
    key = f"count:{hash(spec_json)}:{shared.id if hasattr(shared, 'id') else id(shared)}"

    def run(it):
        spec, table = shared.value
        enc = worker_encoder(key, spec, count=True, frequent=table)
        for batch in it:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for _, part in slices(texts):
                counts += enc.encode(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    out = (src.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
           .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
