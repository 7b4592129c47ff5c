"""Chat formatting: prefix-target expansion, in DataFrame expressions only.

A conversation is written once as a string of marked turns. Every assistant
turn then becomes an example: all turns before it are its context, and only
its reply is under the loss mask. An example is kept as three positions in
that string (`context_end`, `loss_start`, `loss_end`), so a long conversation
is shuffled in proportion to its length and not to its square;
`explode_examples` then writes the texts out, a row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character references for what starts or ends a control string, in the order they are written.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"), ("|", "&#124;"))
END = "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant"
) -> DataFrame:
    """One row a conversation: conv_id, formatted, examples.

    examples is an array of (context_end, loss_start, loss_end, end), all counted
    in characters from 0 with exclusive ends; an example is the string up to end. Turns after the last reply, or a
    conversation without any, make one more example without loss (loss_start =
    loss_end), so that the output holds every turn.

    Turns are ordered by turn, then role and text, nulls first; ties and
    repeated rows stay. Null roles and texts are empty. Rows without conv_id
    are a conversation of their own. Other columns are ignored. The turns of a
    conversation meet in one task: its string is one value.
    """
    t = df.select(
        df[conv_id].alias("conv_id"),
        F.struct(df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text")).alias("t"),
    )
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    g = g.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda x: F.struct(
                F.concat(F.lit("<|"), escape(x["role"]), F.lit("|>\n")).alias("head"),
                escape(x["text"]).alias("body"),
                (x["role"] == target_role).alias("target"),
            ),
        ),
    )
    g = g.withColumns(
        {
            "formatted": F.array_join(F.flatten(F.transform("parts", lambda p: F.array(p["head"], p["body"], F.lit(END)))), ""),
            "sizes": F.transform(
                "parts", lambda p: F.struct(F.length(p["head"]).cast("long").alias("h"), F.length(p["body"]).cast("long").alias("b"), p["target"].alias("target"))
            ),
        }
    )
    # positions by one pass over the turns; an element is added only for a target
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<context_end:bigint,loss_start:bigint,loss_end:bigint,end:bigint>>").alias("out"))

    def step(a, p):
        start = a["at"] + p["h"]
        end = start + p["b"] + len(END)
        one = F.struct(a["at"].alias("context_end"), start.alias("loss_start"), (start + p["b"]).alias("loss_end"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["target"], F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

    g = g.withColumn("pos", F.aggregate("sizes", state, step))
    rest = F.col("pos")["at"]
    tail = F.struct(rest.alias("context_end"), rest.alias("loss_start"), rest.alias("loss_end"), rest.alias("end"))
    last = F.element_at("sizes", -1)["target"]
    return g.select("conv_id", "formatted", F.when(last, F.col("pos")["out"]).otherwise(F.array_append(F.col("pos")["out"], tail)).alias("examples"))


def explode_examples(formatted: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end, last: each example written out; the last one of a conversation holds all its turns."""
    e = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    return e.select(
        "conv_id",
        "example",
        F.substring("formatted", F.lit(1), F.col("e")["end"].cast("int")).alias("text"),
        F.col("e")["loss_start"].alias("loss_start"),
        F.col("e")["loss_end"].alias("loss_end"),
        (F.col("e")["end"] == F.length("formatted")).alias("last"),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """What read_back() gives, from the rows of explode_examples(): losses and lengths of every example's own text."""
    loss = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    e = examples.select(
        "conv_id", F.struct("example", unescape(loss).alias("loss")).alias("loss"), F.length("text").cast("long").alias("chars"), F.when(F.col("last"), F.col("text")).alias("whole")
    )
    g = e.groupBy("conv_id").agg(F.array_sort(F.collect_list("loss")).alias("losses"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("formatted"))
    return g.select("conv_id", _turns("formatted").alias("turns"), F.col("losses.loss").alias("losses"), "formatted_chars")


def _turns(formatted: str) -> Column:
    pieces = F.split(formatted, F.lit("<\\|end\\|>\n"), -1)
    cut = lambda p: F.instr(p, "|>\n")
    return F.transform(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(3), cut(p) - 3)).alias("role"),
            unescape(F.substring(p, cut(p) + 3, F.length(p))).alias("text"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text>>, losses array<string>, formatted_chars: parsed from the output.

    formatted_chars counts the characters of all examples, contexts included.
    """
    return formatted.select(
        "conv_id",
        _turns("formatted").alias("turns"),
        F.transform(
            "examples", lambda e: unescape(F.substring("formatted", (e["loss_start"] + 1).cast("int"), (e["loss_end"] - e["loss_start"]).cast("int")))
        ).alias("losses"),
        F.aggregate("examples", F.lit(0).cast("long"), lambda a, e: a + e["end"]).alias("formatted_chars"),
    )
