"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become one block by array aggregation; blocks are concatenated.

Template of a block: ``<s>[INST] role [/INST]`` + texts joined by ``<s>`` +
``</s>``. Within roles and texts a backslash is doubled and every control
string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash after its
first character, so markers occur in the output only where the template put
them, and removing one backslash of each pair restores the text.

The loss mask covers the texts of assistant turns: the output comes as
segments (loss, text) whose texts concatenate to ``formatted``.

Defined cases: null text or role counts as empty; null turns sort first; ties
of turn are ordered by role, then text; a null conv_id is a conversation of
its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows to one row a conversation: conv_id, segments, formatted."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    # runs of one role: positions at which the role changes, then slices between them
    c = c.withColumn("cut", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", i - 2)["role"])))
    c = c.withColumn(
        "blocks",
        F.transform(
            "cut",
            lambda at, k: F.struct(
                F.get("t", at - 1)["role"].alias("role"),
                F.transform(
                    F.slice("t", at, F.coalesce(F.get("cut", k + 1), F.size("t") + 1) - at), lambda x: escape(x["text"])
                ).alias("texts"),
            ),
        ),
    )

    def marked(b):
        loss = b["role"] == loss_role
        mark = lambda s: F.struct(F.lit(False).alias("loss"), s.alias("text"))
        head = F.concat(F.lit("<s>[INST] "), escape(b["role"]), F.lit(" [/INST]"))
        body = F.transform(
            b["texts"], lambda x, k: F.array(mark(F.when(k == 0, head).otherwise(F.lit("<s>"))), F.struct(loss.alias("loss"), x.alias("text")))
        )
        return F.concat(F.flatten(body), F.array(mark(F.lit("</s>"))))

    c = c.withColumn("segments", F.flatten(F.transform("blocks", marked)))
    return c.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")

    def turns(b):
        # "<s>[INST] role [/INST]text<s>text..."
        parts = F.split(F.substring(b, 4, 2**31 - 1), "<s>")
        role = unescape(F.regexp_extract(parts[0], r"(?s)^\[INST\] (.*?) \[/INST\](.*)$", 1))
        first = F.regexp_extract(parts[0], r"(?s)^\[INST\] (.*?) \[/INST\](.*)$", 2)
        texts = F.concat(F.array(first), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it: turns and the text under the loss mask."""
    t = formatted.withColumn("__t", read_back(F.col("formatted")))
    said = F.array_join(F.transform("__t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    t = t.withColumn("__loss", loss)
    return t.select(
        "conv_id",
        F.size("__t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
