r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged where
neighbours have the same role, and joined into one string:

    <|im_start|>role<|im_sep|>text[<|im_sep|>text ...]<|im_end|>\n ...

A merged block keeps its texts apart by the separator, so the turns can be
read back. In roles and texts a backslash is written as two, and `<|` as
`<\|`; no control string can therefore come from a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_SEP_RE, _END_RE = r"<\|im_sep\|>", r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def running_sums(values: Column) -> Column:
    """Sums of an array up to each place, by doubling strides: n log n steps, where a growing array would be copied n times."""
    strides = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(strides, values, lambda sums, by: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - by), F.lit(0))))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start from 0, length; in code points).

    Turns are sorted by turn, then role, then text; a null turn comes first,
    a null role or text counts as empty, and repeated rows are turns of their
    own. Null is a conv_id like any other. Other columns of the input are
    not used. A conversation is one record and has to fit in a row.
    """
    given = turns.select(
        F.col("conv_id"),
        F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = given.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Where a block begins: the first turn and each change of role; the end closes the last one.
    n = F.size("ts")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i).role != F.get("ts", i - 1).role))
    grouped = grouped.withColumn("heads", F.concat(heads, F.array(n)))
    blocks = F.transform(
        F.sequence(F.lit(0), F.size("heads") - 2),
        lambda b: F.struct(
            F.get("ts", F.get("heads", b)).role.alias("role"),
            F.transform(F.slice("ts", F.get("heads", b) + 1, F.get("heads", b + 1) - F.get("heads", b)), lambda t: escape(t.text)).alias("parts"),
        ),
    )
    grouped = grouped.select("conv_id", blocks.alias("blocks"))
    written = F.transform("blocks", lambda b: F.concat(F.lit(START), escape(b.role), F.lit(SEP), F.array_join(b.parts, SEP), F.lit(END)))
    # One running position over all parts; each part knows what stands before it.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b.parts,
                lambda p, i: F.struct(
                    F.when(i == 0, F.length(escape(b.role)) + len(START + SEP)).otherwise(len(SEP)).alias("lead"),
                    F.length(p).alias("len"),
                    F.when(i == F.size(b.parts) - 1, len(END)).otherwise(0).alias("tail"),
                    (b.role == loss_role).alias("loss"),
                ),
            ),
        )
    )
    out = grouped.select("conv_id", F.array_join(written, "").alias("formatted"), pieces.alias("pieces"))
    out = out.withColumn("ends", running_sums(F.transform("pieces", lambda p: p.lead + p.len + p.tail)))
    spans = F.zip_with(
        "pieces", "ends", lambda p, end: F.struct(p.loss.alias("loss"), (end - p.tail - p.len).alias("start"), p.len.alias("length"))
    )
    said = F.filter(spans, lambda s: s.loss)
    return out.select("conv_id", "formatted", F.transform(said, lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct<role, text>, in order."""
    blocks = F.split(formatted, _END_RE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    split_blocks = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), _SEP_RE, -1))
    return F.flatten(
        F.transform(
            split_blocks,
            lambda parts: F.transform(
                F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(p).alias("text"))
            ),
        )
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them alone."""
    read = formatted.select(
        "conv_id",
        "formatted",
        parse_formatted(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s.start + 1, s.length))), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
