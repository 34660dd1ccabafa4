"""Chat formatting with a declarative template and a finite-state machine over roles; DataFrame functions only.

The template gives each role an opening and a closing mark and says whether its
text counts for the loss; TRANSITIONS says which role may follow which. Control
strings inside texts get one ``#`` after their bracket, which :func:`unescaped`
takes off again, so a mark in the output is always the template's own.

A conversation becomes one row, so one conversation has to fit one row; nothing
else is gathered. Defined results: null text counts as empty; null and unknown
roles are written as a ``[TURN]`` with the role in base64 and make the
conversation invalid; null turns come first; ties in ``turn`` go by role, then
text; repeated rows stay; null ``conv_id`` is one conversation; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: role -> opening, closing, in the loss
TEMPLATE = {
    "system": ("[SYS] ", " [/SYS]\n", False),
    "user": ("[INST] ", " [/INST]\n", False),
    "assistant": ("<s> ", " </s>\n", True),
}
START = "start"
TRANSITIONS = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: The mark of any other role.
TURN = ("[TURN] ", " [/TURN]\n")

CONTROL = r"SYS\]|INST\]|TURN\]|s>"
TURNS = r"(?s)(\[SYS\]|\[INST\]|\[TURN\]|<s>) (.*?) (?:\[/SYS\]|\[/INST\]|\[/TURN\]|</s>)\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<]/?)(#*(?:{CONTROL}))", "$1#$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<]/?)#(#*(?:{CONTROL}))", "$1$2")


def by_role(part: int, other) -> Column:
    """The template's part for the column ``role``."""
    out = F.when(F.lit(False), F.lit(other))
    for role, spec in TEMPLATE.items():
        out = out.when(F.col("role") == role, F.lit(spec[part]))
    return out.otherwise(F.lit(other))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments, loss_spans, valid`` for ``turns(conv_id, turn, role, text)``.

    ``segments`` are ``(role, text, loss)`` with the text as it stands in the
    output; ``loss_spans`` are ``(start, length)`` in code points from 0.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    known = F.col("role").isin(list(TEMPLATE))
    state = F.coalesce(F.lag("role").over(order), F.lit(START))
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        allowed = allowed | ((F.col("state") == before) & F.col("role").isin(list(after)))
    opening = F.concat(by_role(0, TURN[0]), F.when(known, "").otherwise(F.concat(F.base64(F.encode("role", "UTF-8")), F.lit(" "))))
    parts = (
        rows.withColumn("ix", F.row_number().over(order)).withColumn("state", state).withColumn("ok", allowed & known)
        .withColumn("open", opening).withColumn("body", escaped(F.col("text"))).withColumn("close", by_role(1, TURN[1])).withColumn("loss", by_role(2, False))
        .withColumn("chars", F.length("open") + F.length("body") + F.length("close"))
    )
    begin = F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("chars") + F.length("open")
    parts = parts.withColumn("begin", begin.cast("int"))
    one = F.struct("ix", "role", "open", "body", "close", "loss", F.col("begin").alias("start"), F.length("body").alias("length"))
    conv = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("x"), F.bool_and("ok").alias("valid"))
    return conv.select(
        "conv_id",
        F.array_join(F.transform("x", lambda s: F.concat(s["open"], s["body"], s["close"])), "").alias("formatted"),
        F.transform("x", lambda s: F.struct(s["role"].alias("role"), s["body"].alias("text"), s["loss"].alias("loss"))).alias("segments"),
        F.transform(F.filter("x", lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        "valid")


def read_back(out: DataFrame) -> DataFrame:
    """``conv_id, turns, losses, formatted, valid``: roles and texts parsed from ``formatted``, texts under the loss mask."""
    marks, bodies = (F.regexp_extract_all("formatted", F.lit(TURNS), F.lit(n)) for n in (1, 2))
    role = lambda mark, body: F.when(mark == "[SYS]", "system").when(mark == "[INST]", "user").when(mark == "<s>", "assistant").otherwise(F.decode(F.unbase64(F.substring_index(body, " ", 1)), "UTF-8"))
    text = lambda mark, body: unescaped(F.when(mark == "[TURN]", F.substring(body, F.locate(" ", body) + 1, F.length(body))).otherwise(body))
    return out.select(
        "conv_id", F.zip_with(marks, bodies, lambda m, b: F.struct(role(m, b).alias("role"), text(m, b).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("losses"),
        "formatted", "valid")
