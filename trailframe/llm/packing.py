"""Operator 8: packing by power-of-two decomposition.

Each document is encoded, ended with the separator id, and cut into as many
full sequences as fit plus one piece for every binary digit of the rest
(largest first).  A piece is a sequence of its own, its length is a power
of two, so equal lengths form buckets that need no padding and no sequence
crosses documents.

Everything happens in the scan's own tasks: no shuffle, no row of another
document is needed, and a lost task is recomputed from its file split.

Cases: null or empty text is the separator id alone (one piece of length
1); a null ``doc_id`` stays null; repeated rows are packed once each, with
sequence ids of their own; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.segments import read_tokenizer, slices, worker_ids

SEQ_LEN = 1024


def piece_lengths(n: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Full sequences, then the binary digits of the rest, largest first."""
    full, rest = divmod(n, seq_len)
    return [seq_len] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = SEQ_LEN, separator: int = 0,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket`` (bucket: log2 of the length) and, with
    ``with_ids``, the ids themselves.  ``tokenizer`` is the path of a
    tokenizers file (default: the public byte-level one).

    ``sequence_id`` numbers the pieces by task and row (unique, and the same
    when a task is run again on its split)."""
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer, "byte_bpe_50k.json"))
    key = f"ids:{hash(spec.value)}"
    last = np.asarray([separator], dtype="<u4").tobytes()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        schema += ", ids array<int>"
    tails = [np.asarray(piece_lengths(r, seq_len), dtype=np.int64) for r in range(seq_len)]

    def run(it):
        enc = worker_ids(key, spec.value)
        for batch in it:
            ids_col, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in slices(texts):
                rows, lens, starts, crcs, totals, ids = [], [], [], [], [], []
                for i, raw in enumerate(enc.encode(part)):
                    raw += last
                    n = len(raw) // 4
                    full, rest = divmod(n, seq_len)
                    ln = tails[rest] if not full else np.concatenate((np.full(full, seq_len), tails[rest]))
                    st = np.cumsum(ln) - ln
                    rows.append(np.full(ln.size, first + i))
                    lens.append(ln)
                    starts.append(st)
                    totals.append(np.full(ln.size, n))
                    cut = [raw[4 * a:4 * (a + b)] for a, b in zip(st.tolist(), ln.tolist())]
                    crcs += map(zlib.crc32, cut)
                    if with_ids:
                        ids += [np.frombuffer(c, dtype="<u4").astype(np.int32) for c in cut]
                cols = [ids_col.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts)),
                        pa.array(np.concatenate(lens)), pa.array(crcs, pa.int64()),
                        pa.array(np.concatenate(totals))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = src.mapInArrow(run, schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
                            "bucket": F.log2("length").cast("int")})
