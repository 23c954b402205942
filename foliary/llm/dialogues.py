"""Chat formatting: a dialogue rendered once for every participant, with that speaker as the assistant.

The turns of a conversation are numbered in order (turn, null last; then role and text). For every
speaker other than `system`, the dialogue is rendered with that speaker's turns as `assistant`, the
others' as `user name=<speaker>` and system turns as `system`; the mask covers what the assistant
says with its end marker, as spans of code points of the whole rendered dialogue.

A dialogue is cut into blocks of `BLOCK_TURNS` turns, one row each with its own start, so that no group
grows with a conversation: turns are numbered inside runs of turn numbers and only the counts of the
runs meet, and a block gathers at most `BLOCK_TURNS` turns. All of it is DataFrame functions.

Cases: a null role speaks as `unknown`; a null or empty text is an empty turn; a null conv_id is one
conversation of its own; repeated turns are all kept; a conversation with system turns alone has no
participant and gives no row; an empty table gives an empty result; further columns are ignored.
A start or end marker inside a text is broken up (`<|im_` becomes `<|im-`), so no turn can be forged,
and `<`, `|`, `>` and line breaks are taken out of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.operators.sizing import number_rows, settled

BLOCK_TURNS = 64
SYSTEM, UNKNOWN = "system", "unknown"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _header(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == speaker, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), role))
    )


def perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, block, n_turns, start, text, spans: each block of each participant's dialogue.

    `start` is the block's place in the whole dialogue, `spans` the masked parts as start:end, by comma.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce(F.translate(F.col("role"), "<|>\n\r", ""), F.lit(UNKNOWN)).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<|im-")).alias("said"),
    ).withColumns({"_conv": F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")), "_late": F.col("turn").isNull()})
    run = F.when(F.col("_late"), F.lit((1 << 62))).otherwise(F.floor(F.col("turn").cast("double") / block_turns).cast("long"))
    numbered = settled(number_rows(said, ["_conv"], ["_late", "turn", "role", "said"], run, "_n"))
    people = numbered.filter(F.col("role") != SYSTEM).select("_conv", F.col("role").alias("speaker")).distinct()
    pieces = numbered.join(people, "_conv").withColumn("_head", F.concat(F.lit(BEGIN), _header(F.col("role"), F.col("speaker")), F.lit("\n")))
    pieces = pieces.select(
        "_conv", "conv_id", "speaker", "_n", F.floor((F.col("_n") - 1) / block_turns).cast("int").alias("block"),
        (F.col("role") == F.col("speaker")).alias("own"), F.char_length("_head").alias("head"), F.char_length("said").alias("body"),
        F.concat("_head", "said", F.lit(f"{END}\n")).alias("piece"),
    )
    blocks = pieces.groupBy("_conv", "conv_id", "speaker", "block").agg(
        F.sort_array(F.collect_list(F.struct("_n", "piece", "own", "head", "body"))).alias("turns")
    ).withColumn("text", F.concat_ws("", "turns.piece"))
    before = Window.partitionBy("_conv", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum(F.char_length("text").cast("long")).over(before), F.lit(0)).cast("long"))
    # A fold over one block: the running place and the spans so far.
    spans = F.aggregate(
        "turns", F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["piece"])).alias("at"),
            F.when(t["own"], F.concat(acc["out"], F.array(F.concat_ws(
                ":", (acc["at"] + t["head"]).cast("string"), (acc["at"] + t["head"] + t["body"] + len(END)).cast("string")
            )))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat_ws(",", acc["out"]),
    )
    return placed.select("conv_id", "speaker", "block", F.size("turns").alias("n_turns"), "start", "text", spans.alias("spans"))
