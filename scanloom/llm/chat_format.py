"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation:

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline

Inside role and text a backslash starts an escape: \\b is a backslash, \\l is "<", \\h is "#", \\c is ":". The parser is
deterministic: it cuts at the turn's end mark, cuts off the opening mark, cuts at the first ": " and resolves escapes.
Rendering is a ladder: a turn is written as it is, parsed again and compared with its source; if they differ, the
conflicting control strings are escaped; if they still differ, every special character is. The last rung always parses
back. Turns end at their first end mark, so a conversation parses into exactly its turns.

Work is per row until the end; a conversation is then put together in two steps, of BLOCK turns and of blocks, so that
a conversation with very many turns is not gathered row by row in one task. The loss mask is a list of (start, length)
in code points over the rendered text, one span for each assistant turn.

Defined results: a null text or role is empty; a null turn comes first; equal turns are ordered by role and text; a null
conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: Turns that are put together in the first step.
BLOCK = 64


def escape(c: Column, rung: int) -> Column:
    """The text as rung 0 (as it is), 1 (control strings) or 2 (every special character) writes it."""
    if rung == 0:
        return c
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    if rung == 1:
        return F.replace(F.replace(F.replace(c, F.lit("</turn>"), F.lit("\\l/turn>")), F.lit("### "), F.lit("\\h## ")), F.lit(": "), F.lit("\\c "))
    return F.replace(F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h")), F.lit(":"), F.lit("\\c"))


def unescape(c: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    pieces = F.split(formatted, END)

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
        at = F.instr(body, SEP)
        return F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + len(SEP), F.length(body))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def rendered_turns(turns: DataFrame) -> DataFrame:
    """Each row with out_role and out_text: the first rung of the ladder that parses back to its source."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")

    def written(rung: int) -> Column:
        return F.struct(escape(role, rung).alias("role"), escape(text, rung).alias("text"))

    def same(rung: int) -> Column:
        w = written(rung)
        return parse(render(w["role"], w["text"])) == F.array(F.struct(role.alias("role"), text.alias("text")))

    special = role.contains("\\") | text.contains("\\") | text.contains("<") | role.contains("<") | role.contains(":") | role.contains("#")
    plain = ~special  # nothing for the parser to trip over: no need to try
    out = F.when(plain, written(0)).when(same(0), written(0)).when(same(1), written(1)).otherwise(written(2))
    return rows.withColumn("out", out).select("conv_id", "turn", "role", "text", F.col("out.role").alias("out_role"), F.col("out.text").alias("out_text"))


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def _starts(name: str) -> Column:
    """The sums of what comes before each number of an array, inside runs of BLOCK numbers and then of runs: rows without
    a turn number fall into one block however many they are."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(name) - 1) / BLOCK).cast("int")), lambda k: F.slice(F.col(name), k * BLOCK + 1, F.lit(BLOCK)))
    both = F.transform(F.array(runs), lambda r: F.struct(r.alias("runs"), F.transform(r, _sum).alias("sums")))[0]
    before = F.transform(F.array(both), lambda b: F.struct(b["runs"].alias("runs"), F.transform(F.sequence(F.lit(1), F.size(b["runs"])), lambda k: _sum(F.slice(b["sums"], F.lit(1), k - 1))).alias("at")))[0]
    inside = lambda run, at: F.transform(F.sequence(F.lit(1), F.size(run)), lambda k: at + _sum(F.slice(run, F.lit(1), k - 1)))
    return F.transform(F.array(before), lambda b: F.flatten(F.zip_with(b["runs"], b["at"], inside)))[0]


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask of each conversation."""
    rows = rendered_turns(turns).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    head = F.length("out_role") + F.lit(len(OPEN) + len(SEP))
    turn = F.struct("turn", "role", "text", render(F.col("out_role"), F.col("out_text")).alias("r"), head.alias("head"), F.length("out_text").alias("n"))
    parts = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # prefix sums of lengths inside a block, then of blocks
    sizes = F.transform("t", lambda x: F.length(x["r"]))
    starts = _starts("sizes")
    spans = F.filter(F.zip_with("t", "starts", lambda x, s: F.struct(x["role"].alias("role"), (s + x["head"]).cast("long").alias("start"), x["n"].cast("long").alias("length"))), lambda x: x["role"] == ASSISTANT)
    parts = parts.withColumn("sizes", sizes).withColumn("starts", starts).select("conv_id", "block", F.array_join(F.transform("t", lambda x: x["r"]), "").alias("r"), F.transform(spans, lambda x: F.struct(x["start"], x["length"])).alias("spans"))
    parts = parts.withColumn("size", F.length("r").cast("long"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "r", "size", "spans"))).alias("b"))
    shifts = F.aggregate(F.transform("b", lambda x: x["size"]), F.struct(F.array().cast("array<bigint>").alias("s"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.concat(a["s"], F.array(a["n"])).alias("s"), (a["n"] + x).alias("n")))["s"]
    mask = F.flatten(F.zip_with("b", "shifts", lambda x, s: F.transform(x["spans"], lambda y: F.struct((y["start"] + s).alias("start"), y["length"].alias("length")))))
    return whole.withColumn("shifts", shifts).select("conv_id", F.array_join(F.transform("b", lambda x: x["r"]), "").alias("formatted"), mask.alias("loss_mask"))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the op8 contract, read back from the rendered text and its mask."""
    f = F.col("formatted")
    back = formatted.withColumn("t", parse(f)).withColumn("loss", F.array_join(F.transform("loss_mask", lambda x: unescape(F.substring(f, (x["start"] + 1).cast("int"), x["length"].cast("int")))), ""))
    told = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length(f).cast("long").alias("formatted_chars"))
