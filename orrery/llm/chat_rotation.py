"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant; every other participant is a named user, and system turns stay system turns (system is
no participant). The masks name the character spans that the model is trained on: the turns of the
speaker whose perspective it is, end mark included.

A dialogue is returned in parts of `PART_TURNS` turn numbers each; its parts in order, joined by
nothing, are the whole dialogue, and mask spans count from the start of their part. Parts keep every
task bounded however long one conversation is: turns are grouped by (conversation, part), and only
whole parts meet the participants.

A null role is the participant named `unknown`; a null text is empty; turns without a number come
in a part of their own (null) after the others. Turns of equal number are ordered by role, then
text; repeated rows are rendered as often as they come. A conversation with system turns only has
no participant and no row. Rows without a conversation id form one conversation (null). Only the
four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 64
END = "<|end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, dialogue, masks array<struct<start, end>>)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.floor(F.col(turn) / part_turns).alias("part"),
        F.struct(
            F.col(turn).isNull().alias("last"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    roles = rows.where("t.role <> 'system'").select("conv_id", F.col("t.role").alias("speaker")).distinct()
    met = parts.join(roles.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    rendered = F.expr(
        "transform(ts, t -> concat(case when t.role = speaker then '<|assistant|>\\n' when t.role = 'system' then '<|system|>\\n'"
        f" else concat('<|user:', t.role, '|>\\n') end, t.text, '{END[:-1]}\\n'))"
    )
    sized = met.withColumn("pieces", rendered).withColumn("sizes", F.expr("transform(pieces, p -> length(p))"))
    ends = F.expr("aggregate(sizes, cast(array() as array<int>), (a, n) -> concat(a, array(n + if(size(a) = 0, 0, element_at(a, -1)))))")
    head = len("<|assistant|>\n")
    masks = F.expr(f"filter(transform(ends, (e, i) -> if(ts[i].role = speaker, struct(e - sizes[i] + {head} as start, e as end), null)), s -> s is not null)")
    return sized.withColumn("ends", ends).select("conv_id", "speaker", "part", F.size("ts").alias("n_turns"), F.concat_ws("", "pieces").alias("dialogue"), masks.alias("masks"))
