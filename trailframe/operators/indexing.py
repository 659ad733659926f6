"""Order-derived numbering (W1 frame index, W2 slot index).

A plain ``row_number() over (partition by g order by o)`` runs each group in
one task, and an unpartitioned window runs the whole table in one task.
Both break when one group holds a large share of the rows.  The helpers here
sort the rows into parts of about equal numbers of ROWS (bounds from a sample
of the rows, so neither large gaps in the ordering column nor a hot group
matter), number them where they lie, and add the running count of the earlier
parts of the group.  Every row is shuffled by that sort alone; the table of
shifts has one row per group and part, and one task sees one group's parts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.session import materialize

_PART = "_tf_part"
_POS = "_tf_pos"
_FIRST = "_tf_first"
_SHIFT = "_tf_shift"
_N = "_tf_n"
_TIE = "_tf_tie"


def row_index(df: DataFrame, groups: Sequence[str], order: str, out: str,
              bucket_width: int | None = None) -> DataFrame:
    """0-based ``row_number`` within ``groups`` ordered by ``order``.

    Rows with equal ``order`` inside a group are numbered in arbitrary order,
    exactly like ``row_number``, and may lie in several parts unless they are
    copies in all columns; NULL order values come first, a NULL group is a
    group.  There are as many parts as the session has shuffle partitions, or
    parts of about ``bucket_width`` rows where it is given (that counts the
    rows first).  The sorted rows are written once: bounds are sampled, so
    they must not be drawn twice.
    """
    groups = list(groups)
    parts = [] if bucket_width is None else [max(1, math.ceil(df.count() / bucket_width))]
    place = F.monotonically_increasing_id()  # the part, then 33 bits of place in it
    dealt = materialize(
        df.withColumn(_TIE, F.xxhash64(*[F.col(c) for c in df.columns]))
        .repartitionByRange(*parts, *groups, order, _TIE).sortWithinPartitions(*groups, order)
        .drop(_TIE).withColumn(_POS, place), "numbered")
    dealt = (dealt.withColumn(_PART, F.shiftright(_POS, 33))
             .withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dealt.groupBy(*groups, _PART).agg(F.count(F.lit(1)).alias(_N), F.min(_POS).alias(_FIRST))
    w = Window.partitionBy(*groups).orderBy(_PART) if groups else Window.orderBy(_PART)
    before = F.coalesce(F.sum(_N).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # NULL groups are a group of their own: the join treats two NULLs as equal
    keys = [*groups, _PART]
    shifts = counts.select(*[F.col(c).alias(f"{c}_o") for c in keys], (before - F.col(_FIRST)).alias(_SHIFT))
    cond = F.lit(True)
    for c in keys:
        cond = cond & dealt[c].eqNullSafe(shifts[f"{c}_o"])
    return (dealt.join(shifts, cond)
            .withColumn(out, (F.col(_SHIFT) + F.col(_POS)).cast("long"))
            .drop(_PART, _POS, _SHIFT, *[f"{c}_o" for c in keys]))


def dense_index(df: DataFrame, key: str, out: str, bucket_width: int | None = None,
                numeric=None) -> DataFrame:
    """Table ``(key, out)`` with ``out`` = 0-based dense rank of ``key``.

    ``numeric(col)`` maps the key column to a long that orders like the key
    (default: the key itself); distinct keys are cut into parts as in
    :func:`row_index`.  Join the result back onto the facts on ``key``; it has
    one row per distinct key, so AQE broadcasts it when it is small enough
    (with ``eqNullSafe`` where the key may be NULL: that row comes first).
    """
    keys = df.select(F.col(key).alias("_tf_key")).distinct()
    num = numeric(F.col("_tf_key")) if numeric is not None else F.col("_tf_key")
    keys = keys.withColumn("_tf_num", num.cast("long"))
    idx = row_index(keys, [], "_tf_num", out, bucket_width=bucket_width)
    return idx.select(F.col("_tf_key").alias(key), out)
