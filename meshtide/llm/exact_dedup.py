"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text: first by a
short head, then by ever longer chunks. A group that has shrunk to one document
is unique and leaves; a group whose texts have all ended is a set of equal
texts. Groups are told apart by the bytes themselves; no digest decides.

Each round is one count per (group, chunk), combined before the shuffle, and one
equi-join back, which adaptive execution splits where one group is hot. Only
groups of two and more go on, so after the head little but real copies moves.
Rounds grow with the logarithm of the longest text (linearly beyond MAX_CHUNK).

Defined results: null text counts as empty and equals empty texts; repeated rows
are copies of each other, one of which stays; of rows that share the smallest
id, one stays; null ids come last (an all-null group keeps a row with null id);
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.session import checkpointed, written

HEAD, GROWTH, MAX_CHUNK = 32, 8, 1 << 20
NUMBER = "_meshtide_row_number"
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text_col: str = "text"):
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def split_rounds(rows: DataFrame, head: int = HEAD, growth: int = GROWTH) -> DataFrame | None:
    """Groups of equal ``body`` in ``rows(rid long, id, body binary)``.

    Returns ``rid, low, n, first`` for every row of a group of two and more
    (``low``: the group's smallest id, ``first``: the first row that has it).
    """
    state, pos, size, found, old = rows.withColumn("gid", F.lit(0).cast("long")), 1, head, None, None
    while True:
        chunk = F.substring("body", pos, size)
        cut = state.select("rid", "id", "gid", "body", chunk.alias("chunk"), (F.length("body") < pos + size).alias("ended"))
        sizes = cut.groupBy("gid", "chunk", "ended").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best")).where("n > 1")
        sizes = checkpointed(sizes)  # both sides of the join then have an exchange of their own, which a hot group may split
        on = cut.join(sizes, ["gid", "chunk", "ended"])
        state = written(on.select("rid", "id", F.col("best.rid").alias("gid"), F.col("best.id").alias("low"), "n", "ended", F.when(~F.col("ended"), F.col("body")).alias("body")), "radix")
        done = state.where("ended").select("rid", "low", "n", F.col("gid").alias("first"))
        found = done if found is None else found.union(done)
        state = state.where("not ended").select("rid", "id", "body", "gid")
        if state.isEmpty():
            return found
        pos, size = pos + size, min(size * growth, MAX_CHUNK)


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id, keep_id, group_size, kept, text_sha256, rid``.

    ``number_col`` names a column of stable, distinct row numbers, if there is one.
    """
    rid = F.col(number_col) if number_col else F.monotonically_increasing_id()
    base = written(docs.select(rid.alias("rid"), F.col(id_col).alias("id"), normalised(text_col).alias("body")), "bodies")
    groups = split_rounds(base.withColumn("body", F.encode("body", "UTF-8")))
    groups = groups.select("rid", "low", "n", (F.col("rid") == F.col("first")).alias("stays"))  # of rows that share a group's smallest id, the first stays
    all_rows = base.select("rid", "id", F.sha2(F.encode("body", "UTF-8"), 256).alias("text_sha256"))
    alone = F.col("n").isNull()
    return all_rows.join(groups, "rid", "left").select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("low")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("stays", F.lit(True)).alias("kept"), "text_sha256", "rid")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay, one of each group of equal texts."""
    numbered = written(docs.withColumn(NUMBER, F.monotonically_increasing_id()), "numbered")
    gone = equal_groups(numbered, id_col, text_col, NUMBER).where("not kept").select(F.col("rid").alias(NUMBER))
    return numbered.join(gone, NUMBER, "left_anti").select(*docs.columns)
