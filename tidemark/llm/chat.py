"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own training example: all turns before it are context, and only its reply (with the end
mark that closes it) may be trained on.  A conversation whose last turn is not an assistant's also gives one example with
nothing to train on, so that the formatted table holds every turn.

Template.  A turn is ``[INST] role``, a line break, the text and ``</s>``; the assistant's differs in its opening mark
``[/INST]``.  Inside roles and texts a backslash breaks every control string after its first character, and backslashes
are doubled, so a formatted example can always be taken apart again.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
USER_MARK, REPLY_MARK, END_MARK, START_MARK = "[INST]", "[/INST]", "</s>", "<s>"
ASSISTANT = "assistant"
_TURN = re.compile(r"\[(/?)INST\] (?:((?:[^\n\\]|\\.)*))\n(.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """Doubles backslashes, breaks control strings, and writes line breaks in roles and texts as they are."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(text, r"([<\[])(?=/?(?:s>|INST\]))", r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: Column) -> Column:
    """A null role is empty; a line break in a role is written as backslash and line break."""
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\\n"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, target (number of its last turn from 0), n_turns, text, loss_start, loss_end, last.

    ``text[loss_start:loss_end]`` in characters (code points) is the escaped reply; both are null where nothing is to be
    trained on.  Turns are ordered by turn, then role and text; nulls come first.  A null text or role is empty; rows with
    a null conv_id form one conversation; repeated rows are repeated turns; other columns are ignored, whatever their names.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    mark = lambda t: F.when(t["role"] == ASSISTANT, REPLY_MARK).otherwise(USER_MARK)
    head = lambda t: F.concat(mark(t), F.lit(" "), _role(t["role"]), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("reply")))
    whole = whole.select("conv_id", F.size("turns").alias("n"), parts.alias("parts"))
    each = whole.select("conv_id", "n", "parts", F.posexplode("parts").alias("target", "part"))
    each = each.where(F.col("part.reply") | (F.col("target") == F.col("n") - 1))
    before = F.array_join(F.transform(F.slice("parts", 1, F.col("target")), lambda p: F.concat(p["head"], p["body"], F.lit(END_MARK))), "")
    each = each.withColumn("context", F.concat(F.lit(START_MARK), before, F.col("part.head")))
    start = F.when(F.col("part.reply"), F.length("context"))
    return each.select(
        "conv_id", "target", F.col("n").alias("n_turns"),
        F.concat("context", "part.body", F.lit(END_MARK)).alias("text"),
        start.alias("loss_start"), (start + F.length("part.body")).alias("loss_end"),
        (F.col("target") == F.col("n") - 1).alias("last"),
    )


def parse(example: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    out, at = [], len(START_MARK)
    while at < len(example):
        found = _TURN.match(example, at)
        out.append((unescape(found[2]), unescape(found[3])))
        at = found.end()
    return out


def digest(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them: one row per conversation."""

    @F.pandas_udf("turns long, sha string, loss string")
    def read(text: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = []
        for x, s, e, whole in zip(text, start, end, last):
            turns = parse(x) if whole else []
            sha = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest() if whole else None
            rows.append((len(turns), sha, unescape(x[int(s) : int(e)]) if pd.notna(s) else None))
        return pd.DataFrame(rows, columns=["turns", "sha", "loss"])

    back = read("text", "loss_start", "loss_end", "last")
    rows = examples.select("conv_id", "target", F.length("text").cast("long").alias("chars"), back.alias("r"))
    out = rows.groupBy("conv_id").agg(
        F.max("r.turns").alias("n_turns"), F.max("r.sha").alias("turns_sha256"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("r.loss").isNotNull(), F.struct("target", "r.loss"))))["loss"], "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
