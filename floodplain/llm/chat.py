"""Multi-party perspective rotation of dialogues, with loss masks; DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as `assistant` and all others as named users; speakers in `context`
(system by default) stay as they are and are no participants. A rendering is
one row for each turn: its segment, whether the segment is trained on, and the
span of it that is (the text and the closing mark, in code points). Segments in
the order of (turn, role, text) are the whole rendering, so a conversation of
any length is never gathered in one task.

Names are made safe for the header: other characters than letters, digits,
`_`, `.`, `-` become `_`, and a name that changes gets eight digits of its MD5, so
names stay distinct. Marks that occur in a text are broken with a space.

Defined cases: a null text is empty; a turn with a null role is by `unknown`;
rows without conv_id are dropped; conversations of context turns alone have no
participant and give no row; repeated rows are repeated turns; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def safe_name(role: Column) -> Column:
    clean = F.regexp_replace(role, r"[^A-Za-z0-9_.\-]", "_")
    return F.when(clean == role, role).otherwise(F.concat(clean, F.lit("_"), F.substring(F.md5(role), 1, 8)))


def rotate(turns: DataFrame, context: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, segment, trained, mask_start, mask_end."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    people = rows.where(~F.col("speaker").isin(*context)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own, aside = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*context)
    chat_role = F.when(own, "assistant").when(aside, F.col("speaker")).otherwise("user")
    header = F.concat(F.lit(START), chat_role, F.when(own | aside, F.lit("")).otherwise(F.concat(F.lit(" name="), safe_name(F.col("speaker")))), F.lit("\n"))
    trained = F.concat(F.col("body"), F.lit(END))
    out = rows.join(people, "conv_id")
    return out.select(
        "conv_id", "perspective", "turn", "speaker", chat_role.alias("chat_role"), F.concat(header, trained, F.lit("\n")).alias("segment"), own.alias("trained"),
        F.when(own, F.length(header)).otherwise(0).cast("long").alias("mask_start"), F.when(own, F.length(header) + F.length(trained)).otherwise(0).cast("long").alias("mask_end"),
    )


def joined(segments: DataFrame) -> DataFrame:
    """Whole renderings, (conv_id, perspective, text), for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "speaker", "segment")))
    return segments.groupBy("conv_id", "perspective").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("text"))
