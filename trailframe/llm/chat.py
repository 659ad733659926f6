"""Operator 5: chat formatting, in Spark expressions only.

Turns are collected per conversation as structs, sorted, adjacent turns of
one role are merged into a block, and blocks are joined into one string:

    <|turn|>role<|text|>text<|part|>text of the next turn, same role<|end|>

Texts and roles may hold control strings (the template's own and those of
other common templates).  A backslash is put behind the first character of
each, and one more where backslashes already stand there, so no control
string is left inside a text and ``unescape`` gives the text back exactly.

The loss mask is a run-length list: numbers of characters that take turns
in not counting and counting, ``end_chars`` more at the end.  It covers the
assistant texts and nothing else, and with ``end_chars`` its runs add up to
the length of the string; the digests read the loss text through it.

Cases: null text is empty; a null role is the empty role; null turns come
first, ties are ordered by role and text; repeated rows stay; rows with a
null ``conv_id`` form one conversation; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.arrays import bind, starts

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"

#: bodies of the control strings that are escaped, without the first character
CONTROL_BODIES = (r"\|(?:turn|text|part|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]")
_OUT = rf"([<\[])(\\*)({CONTROL_BODIES})"
_BACK = rf"([<\[])\\(\\*)({CONTROL_BODIES})"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(_OUT), F.lit(r"$1$2\\$3"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(_BACK), F.lit("$1$2$3"))


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_runs``, one row per conversation."""
    none = F.lit("")
    turns = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), none).alias("role"),
                 F.coalesce(F.col(text), none).alias("text"),
                 F.coalesce(F.col(role).isin(*loss_roles), F.lit(False)).alias("loss")).alias("t"))
    t = (turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
         .withColumn("n", F.size("t")))
    # the first turn of every block, then the end of the table
    t = t.withColumn("starts", F.expr(
        "filter(sequence(0, n - 1), i -> i = 0 or t[i].role <> t[i - 1].role)")).withColumn(
        "ends", F.expr("concat(slice(starts, 2, size(starts)), array(n))"))
    role_of = F.transform("starts", lambda s: escape(F.col("t")[s]["role"]))
    texts = F.transform("t", lambda x: escape(x["text"]))
    blocks = t.withColumns({"roles": role_of, "escaped": texts}).select("conv_id", F.expr(
        "transform(starts, (s, i) -> named_struct('role', roles[i], 'loss', t[s].loss, "
        "'texts', slice(escaped, s + 1, ends[i] - s)))").alias("blocks"))
    head, mid, tail = len(TURN), len(TEXT), len(END)

    def runs(b, j):  # (characters outside, characters inside) for every text
        # in front of a block's first text: the end of the block before and its own head
        first = F.length(b["role"]) + (head + mid) + F.when(j > 0, tail).otherwise(0)

        def run(x, i):
            gap = F.when(i == 0, first).otherwise(len(PART)).cast("long")
            n = F.length(x).cast("long")
            return F.when(b["loss"], F.array(gap, n)).otherwise(F.array(gap + n, F.lit(0).cast("long")))

        return F.flatten(F.transform(b["texts"], run))

    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(
            F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], PART), F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("blocks", runs)).alias("loss_runs"), F.lit(tail).alias("end_chars"))


def masked_texts(formatted: Column, loss_runs: Column) -> Column:
    """The texts under the loss mask, cut out of the formatted string by the
    mask's own offsets, unescaped.  Characters are four bytes each there, so
    a cut does not walk through the string."""
    wide = F.encode(formatted, "UTF-32")
    places = F.filter(F.sequence(F.lit(0), F.size(loss_runs) - 1), lambda i: (i % 2 == 1) & (loss_runs[i] > 0))
    at = starts(F.transform(loss_runs, lambda x: x.cast("int")))
    return bind(F.struct(wide.alias("w"), at.alias("at")), lambda v: F.transform(places, lambda i: unescape(F.decode(
        F.substring(v["w"], v["at"][i] * 4 + 1, loss_runs[i].cast("int") * 4), "UTF-32"))))


def parse_chats(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Read the turns back: ``conv_id, turns`` (array of role, text in their
    original form and the number of characters the text has in the string)."""
    # every block ends with END; the piece after the last one is empty
    raw = formatted.withColumn("blocks", F.expr(
        f"transform(slice(split(formatted, '<[|]end[|]>'), 1, size(split(formatted, '<[|]end[|]>')) - 1), "
        f"b -> split(substring(b, {len(TURN) + 1}), '<[|]text[|]>'))"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.split(b[1], "<[|]part[|]>"),
        lambda x: F.struct(unescape(b[0]).alias("role"), unescape(x).alias("text"), F.length(x).alias("chars")))))
    return raw.withColumn("turns", turns).drop("blocks")


def digests(conversations: DataFrame) -> DataFrame:
    """Format, read back, and digest: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``.  Turns are parsed from the
    string, the loss text is cut out of it by the mask."""
    got = parse_chats(format_chats(conversations))
    nl = F.lit("\n")
    got = got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], nl, x["text"], nl)), "").alias("all"),
        F.array_join(masked_texts(F.col("formatted"), F.col("loss_runs")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    return got.select("conv_id", "n_turns", F.sha2(F.encode("all", "UTF-8"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts hold control strings."""
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
