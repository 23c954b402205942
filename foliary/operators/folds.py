"""Ordered packing and budgets: rules where each row depends on what was taken before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliary.functions.text import evidence_tokens, strip
from foliary.params import (
    BATCH_CHARS, BATCH_PARTS, HISTORY_CHARS, HISTORY_MESSAGE_CHARS, HISTORY_MESSAGES, SCHEMA_OVERHEAD_TOKENS,
    SMALL_DOCUMENT_CHARS,
)

BLOCK = 4_096


def _reach(sizes: list[int], own: int, limit: int, most: int) -> list[int]:
    """For each own item, the index after the last item of a batch that starts with it."""
    ends = [0] * own
    stop, total = len(sizes), sum(sizes[own:])
    for start in range(own - 1, -1, -1):
        total += sizes[start]
        while stop - start > 1 and (total > limit or stop - start > most):
            stop -= 1
            total -= sizes[stop]
        ends[start] = stop
    return ends


def next_fit(
    items: DataFrame, group: list[str], pos: str, size: str, limit: int, most: int, out: str = "batch_no"
) -> DataFrame:
    """Adds the 1-based batch of each item: fill a batch while it holds, else open the next.

    `pos` numbers the items of a group densely from 1; a batch has at most `most` items and a total
    of at most `limit`, except that an item over the limit stands alone.

    A group may be of any length. It is cut into blocks of items, each with the few items that follow
    it. For every item of a block where a batch might begin, the block tells where the first batch
    beyond it begins and how many batches lie between; chaining these small tables gives each block
    its starting point, and only then are batches numbered, block by block.
    """
    block_size = max(BLOCK, 2 * most)
    index = F.col(pos) - 1
    home = F.floor(index / block_size).cast("long")
    homes = F.when(
        (index % block_size < most) & (home > 0), F.array(home - 1, home)
    ).otherwise(F.array(home))
    blocks = (
        items.select(*group, F.explode(homes).alias("_block"), F.col(pos).cast("long").alias("_pos"), F.col(size).cast("long").alias("_size"))
        .groupBy(*group, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_size"))).alias("_items"))
        .select(*group, "_block", F.transform("_items", lambda i: i["_size"]).alias("_sizes"))
    )

    @F.pandas_udf("leap array<int>, passed array<int>")
    def leaps(sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for values in sizes:
            own = min(len(values), block_size)
            ends = _reach(list(values), own, limit, most)
            leap, passed = [0] * own, [0] * own
            for start in range(own - 1, -1, -1):
                end = ends[start]
                leap[start] = end - own if end >= own else leap[end]
                passed[start] = 1 if end >= own else passed[end] + 1
            rows.append((leap[:most], passed[:most]))
        return pd.DataFrame(rows, columns=["leap", "passed"])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(sizes: pd.Series, entry: pd.Series, base: pd.Series) -> pd.Series:
        result = []
        for values, begin, batch in zip(sizes, entry, base):
            own = min(len(values), block_size)
            ends = _reach(list(values), own, limit, most)
            found = [int(batch)] * min(int(begin), own)
            start = int(begin)
            while start < own:
                batch += 1
                end = ends[start]
                found.extend([int(batch)] * (min(end, own) - start))
                start = end
            result.append(found)
        return pd.Series(result)

    state = F.struct(F.lit(0).alias("entry"), F.lit(0).alias("base"), F.array().cast("array<struct<block:bigint,entry:int,base:int>>").alias("seen"))

    def step(done, block):
        entry = done["entry"]
        return F.struct(
            F.coalesce(F.try_element_at(block["leap"], entry + 1), F.lit(0)).alias("entry"),
            (done["base"] + F.coalesce(F.try_element_at(block["passed"], entry + 1), F.lit(0))).alias("base"),
            F.concat(done["seen"], F.array(F.struct(block["_block"].alias("block"), entry.alias("entry"), done["base"].alias("base")))).alias("seen"),
        )

    starts = (
        blocks.withColumn("_leaps", leaps("_sizes"))
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_leaps.leap", "_leaps.passed"))).alias("_chain"))
        .select(*group, F.explode(F.aggregate("_chain", state, step)["seen"]).alias("_start"))
        .select(*group, F.col("_start.block").alias("_block"), F.col("_start.entry").alias("_entry"), F.col("_start.base").alias("_base"))
    )
    numbered = (
        blocks.join(starts, [*group, "_block"])
        .select(*group, "_block", F.posexplode(numbers("_sizes", "_entry", "_base")).alias("_offset", out))
        .select(*group, (F.col("_block") * block_size + F.col("_offset") + 1).alias(pos), out)
    )
    return items.join(numbered, [*group, pos])


def batch_index_parts(parts: DataFrame) -> DataFrame:
    """Parts with their batch inside the document: at most 24 parts and 30000 characters."""
    sized = parts.select("document_id", "part_no", F.length("markdown").alias("chars"))
    return next_fit(sized, ["document_id"], "part_no", "chars", BATCH_CHARS, BATCH_PARTS)


def part_char_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("document_id").agg(
        F.sum(F.length("markdown")).alias("chars"), F.count("*").alias("part_count")
    )


def document_plan(parts: DataFrame) -> DataFrame:
    """Per document: whether it is summarised hierarchically, and in how many batches."""
    plan = part_char_totals(parts).withColumn(
        "hierarchical", (F.col("chars") > SMALL_DOCUMENT_CHARS) | (F.col("part_count") > BATCH_PARTS)
    )
    large = parts.join(plan.filter("hierarchical").select("document_id"), "document_id", "left_semi")
    batches = batch_index_parts(large).groupBy("document_id").agg(F.max("batch_no").alias("_batches"))
    return plan.join(batches, "document_id", "left").select(
        "document_id", "chars", "part_count", "hierarchical", F.coalesce("_batches", F.lit(1)).alias("batches")
    )


def pack_batches(
    items: DataFrame, group: list[str], pos: str, item_bytes: str, fixed_bytes: int, schema_tokens: int, budget: int,
    smallest_item: int = 16,
) -> DataFrame:
    """Batch of each routing entry such that every request stays within its token budget.

    A request has `fixed_bytes` around the comma-separated entries. An entry that fits no request is
    flagged. Entries are JSON objects of at least `smallest_item` bytes, which bounds a batch.
    """
    room = 3 * (budget - schema_tokens - SCHEMA_OVERHEAD_TOKENS) - fixed_bytes + 1
    sized = items.withColumn("_cost", F.col(item_bytes) + 1)
    most = max(1, room // (smallest_item + 1) + 1)
    packed = next_fit(sized, group, pos, "_cost", room, most)
    return packed.withColumn("fits", F.col("_cost") <= room).drop("_cost")


def empty_batches(groups: DataFrame, packed: DataFrame, group: list[str]) -> DataFrame:
    """One empty batch for each group without entries."""
    return groups.join(packed.select(*group).distinct(), group, "left_anti").withColumn("batch_no", F.lit(1))


def evidence_budget(selected: DataFrame, budgets: DataFrame) -> DataFrame:
    """Which selected parts fit the evidence budget, in document and part order.

    A part that does not fit is skipped and later, smaller ones may still fit. The fold runs over the
    capped selection of a question (at most 200 parts by the parameter bounds) and holds only sizes.
    `selected` has question_id, doc_order, part_order, document_id, part_id and content; `budgets` has
    question_id and evidence_budget.
    """
    tokens = selected.withColumn("estimated_tokens", evidence_tokens(F.col("content")))
    line = F.struct("doc_order", "part_order", "estimated_tokens")
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("flags"))

    def take(done, item, budget):
        fits = done["used"] + item["estimated_tokens"] <= budget
        return F.struct(
            (done["used"] + F.when(fits, item["estimated_tokens"]).otherwise(F.lit(0))).alias("used"),
            F.concat(done["flags"], F.array(fits)).alias("flags"),
        )

    folded = (
        tokens.groupBy("question_id").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
        .join(budgets.select("question_id", "evidence_budget"), "question_id")
    )
    flags = folded.select(
        "question_id", "_lines",
        F.aggregate("_lines", state, lambda d, i: take(d, i, F.col("evidence_budget")))["flags"].alias("_flags"),
    ).select("question_id", F.inline(F.arrays_zip("_lines", "_flags"))).select(
        "question_id", "_lines.doc_order", "_lines.part_order", F.col("_flags").alias("within_evidence_budget")
    )
    return tokens.join(flags, ["question_id", "doc_order", "part_order"]).withColumn(
        "content", F.when(F.col("within_evidence_budget"), F.col("content"))
    )


def eligible_evidence(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("within_evidence_budget") & F.col("content").isNotNull())


def recent_history(messages: DataFrame) -> DataFrame:
    """Newest 12 user and assistant messages, trimmed to 12000 characters each and 48000 in all.

    Counting from the newest, a message gets what the newer ones left, so the running sum of capped
    lengths decides every cut.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        messages.filter(F.col("role").isin("user", "assistant"))
        .withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= HISTORY_MESSAGES)
        .withColumn("text", F.substring(strip(F.col("text")), 1, HISTORY_MESSAGE_CHARS))
    )
    before = F.coalesce(
        F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    left = F.greatest(F.lit(0), HISTORY_CHARS - before).cast("int")
    return (
        recent.withColumn("_left", left)
        .withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("_left")))
        .filter(F.length("text") > 0)
        .select("conv_id", "turn", "role", "text")
    )


def lexical_query_text(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """Search text of a question: the last three user messages before it, then the question."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = (
        messages.filter((F.col("role") == "user") & (F.length(strip(F.col("text"))) > 0))
        .withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= 3)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", strip(F.col("text")).alias("text")))).alias("_said"))
    )
    joined = questions.join(said, "conv_id", "left")
    lines = F.coalesce(F.transform("_said", lambda m: m["text"]), F.array().cast("array<string>"))
    return joined.select("conv_id", F.array_join(F.concat(lines, F.array(F.col("question"))), "\n").alias("text"))
