"""From ranked candidates and router choices to the selected documents and parts of each question.

All questions are processed together; `question_id` is the key throughout. Router outputs are untrusted
tables: ids outside the index are dropped and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.bounded import unique_non_blank
from foliary.functions.text import strip
from foliary.params import Params

LEXICAL_REASON = "Local lexical recall found matching indexed terms."
FALLBACK_REASON = "Local lexical fallback selected an exact-term match."
PART = ["folder_id", "document_id", "part_id"]


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("question_id").agg(F.count("*").alias(name))


def folder_whitelist(candidates: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates in the root's folders, number of the others per question)."""
    folders = root.select("folder_id")
    return candidates.join(folders, "folder_id", "left_semi"), _counts(
        candidates.join(folders, "folder_id", "left_anti"), "invalid_lexical"
    )


def part_whitelist(candidates: DataFrame, card_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates that exist as card parts, number of the others per question)."""
    known = card_parts.select(*PART)
    return candidates.join(known, PART, "left_semi"), _counts(candidates.join(known, PART, "left_anti"), "invalid_lexical")


def consensus_intent(responses: DataFrame) -> DataFrame:
    """(question_id, intent): most frequent over the responses, ties to the first seen."""
    votes = responses.groupBy("question_id", "intent").agg(F.count("*").alias("n"), F.min("response_no").alias("first"))
    return votes.groupBy("question_id").agg(F.max_by("intent", F.struct("n", -F.col("first"))).alias("intent"))


def _mentions(responses: DataFrame) -> DataFrame:
    clean = responses.withColumn("_ids", unique_non_blank(F.col("selected_folders"))["value"])
    return clean.select(
        "question_id", "response_no", strip(F.col("display_reason")).alias("display_reason"),
        F.posexplode("_ids").alias("pos", "folder_id"),
    )


def select_folders(candidates: DataFrame, responses: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected folders in order, number of unknown folder ids per question).

    Folders of candidates come first, by rank, then the router's, by response; the first mention
    gives the reason.
    """
    lexical = candidates.select(
        "question_id", "folder_id", F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).alias("_at"),
        F.lit(LEXICAL_REASON).alias("display_reason"),
    )
    mentions = _mentions(responses)
    routed = mentions.select(
        "question_id", "folder_id",
        F.struct(F.lit(1).alias("a"), F.col("response_no").alias("b"), F.col("pos").alias("c")).alias("_at"), "display_reason",
    )
    firsts = lexical.unionByName(routed).groupBy("question_id", "folder_id").agg(
        F.min("_at").alias("_at"), F.min_by("display_reason", "_at").alias("display_reason")
    )
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("_at"))
    chosen = firsts.join(root.select("folder_id", "source_directory", "summary"), "folder_id").withColumn("folder_order", order)
    unknown = mentions.join(root.select("folder_id"), "folder_id", "left_anti")
    return chosen.drop("_at"), _counts(unknown, "invalid_folders")


def need_more_information(responses: DataFrame, folders: DataFrame) -> DataFrame:
    """(question_id, flag): no folder was selected and some response asked for more."""
    asked = responses.groupBy("question_id").agg(F.bool_or("need_more_information").alias("asked"))
    has = folders.select("question_id", F.lit(True).alias("has")).distinct()
    return asked.join(has, "question_id", "left").select(
        "question_id", (F.col("asked") & F.col("has").isNull()).alias("need_more_information")
    )


def cap_folders(folders: DataFrame, limit: int) -> DataFrame:
    """The first `limit` selected folders are routed."""
    return folders.filter(F.col("folder_order") <= limit)


def best_rank_per_document(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("question_id", "folder_id", "document_id").agg(F.min("rank").alias("best_rank"))


def document_card_join(folders: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents offered to the router: those with candidates, or all where a folder has none."""
    keys = ["question_id", "folder_id"]
    ranked = best_rank_per_document(candidates)
    wanted = folders.select(*keys)
    hit = wanted.join(ranked, keys).join(documents, ["folder_id", "document_id"])
    bare = wanted.join(ranked.select(*keys).distinct(), keys, "left_anti").join(documents, "folder_id")
    return hit.unionByName(bare.withColumn("best_rank", F.lit(None).cast("int")))


def order_folder_documents(routing: DataFrame) -> DataFrame:
    """Routing documents by best rank inside their folder, else by path and id."""
    order = [F.col("best_rank").asc_nulls_last(), "source_path", F.col("document_id").cast("long")]
    return routing.orderBy("question_id", "folder_id", *order)


def neighbour_context(card_parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Direct hits with the part before and after each; only hits carry a rank."""
    places = card_parts.select(*PART, "part_no")
    hits = candidates.join(places, PART)
    near = hits.select(
        "question_id", "folder_id", "document_id",
        F.explode(F.array(F.col("part_no") - 1, F.col("part_no"), F.col("part_no") + 1)).alias("part_no"),
    ).distinct()
    shown = near.join(card_parts, ["folder_id", "document_id", "part_no"])
    ranks = hits.select("question_id", *PART, F.col("rank").alias("lexical_rank"))
    return shown.join(ranks, ["question_id", *PART], "left")


def _selections(responses: DataFrame) -> DataFrame:
    """One row per selected document of a response, with its distinct part ids."""
    rows = responses.select("question_id", "folder_id", "response_no", F.posexplode("selected_documents").alias("doc_pos", "_doc"))
    return rows.select(
        "question_id", "folder_id", "response_no", "doc_pos", strip(F.col("_doc.document_id")).alias("document_id"),
        unique_non_blank(F.col("_doc.part_ids"))["value"].alias("part_ids"), strip(F.col("_doc.display_reason")).alias("display_reason"),
    )


def selection_whitelist(
    responses: DataFrame, routing: DataFrame, card_parts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(valid documents, their valid parts, invalid documents, invalid parts) of router responses.

    A document counts if it was offered for this question and folder; its parts count if its card has
    them. Invalid rows keep question and folder, because only folders that are reached are counted.
    """
    keys = ["question_id", "folder_id", "document_id"]
    picked = _selections(responses)
    offered = routing.select(*keys)
    documents = picked.join(offered, keys, "left_semi")
    parts = documents.select(*keys, "response_no", "doc_pos", F.posexplode("part_ids").alias("part_pos", "part_id"))
    known = card_parts.select(*PART)
    return (
        documents.drop("part_ids"),
        parts.join(known, PART, "left_semi"),
        picked.join(offered, keys, "left_anti").select("question_id", "folder_id"),
        parts.join(known, PART, "left_anti").select("question_id", "folder_id"),
    )


def merge_selections(documents: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, parts) over all responses: first mention orders, first non-empty reason names.

    Parts come out as rows numbered within their document.
    """
    keys = ["question_id", "folder_id", "document_id"]
    at = F.struct("response_no", "doc_pos")
    said = F.when(F.length("display_reason") > 0, at)
    merged = documents.groupBy(*keys).agg(
        F.min(at).alias("_at"), F.coalesce(F.min_by("display_reason", said), F.lit("")).alias("display_reason")
    )
    first = parts.groupBy(*keys, "part_id").agg(F.min(F.struct("response_no", "doc_pos", "part_pos")).alias("_part_at"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_part_at"))
    return merged, first.withColumn("part_order", order).drop("_part_at")


def cap_documents(documents: DataFrame, folders: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(documents within the limit, folders with `reached` and the question's `limit_reached`).

    Folders are taken in order. Once the limit is full no further folder is reached; a folder that is
    not reached contributes neither documents nor confidence nor invalid counts.
    """
    keys = ["question_id", "folder_id"]
    per_folder = documents.groupBy(*keys).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("question_id").orderBy("folder_order").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("question_id")
    counted = folders.select(*keys, "folder_order").join(per_folder, keys, "left").fillna(0, ["n"])
    reached = counted.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(
        *keys, "folder_order", (F.col("_before") < limit).alias("reached"),
        (F.bool_or(F.col("_before") >= limit).over(whole) | (F.sum("n").over(whole) > limit)).alias("limit_reached"),
    )
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("folder_order", "_at"))
    kept = documents.join(reached.select(*keys, "folder_order"), keys).withColumn("doc_order", order).filter(F.col("doc_order") <= limit)
    return kept.drop("_at"), reached


def min_confidence(responses: DataFrame, reached: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, confidence): the lowest over responses of reached folders, 0 without any."""
    seen = responses.join(reached.filter("reached").select("question_id", "folder_id"), ["question_id", "folder_id"], "left_semi")
    lowest = seen.groupBy("question_id").agg(F.min("confidence").alias("confidence"))
    return questions.select("question_id").join(lowest, "question_id", "left").fillna(0.0, ["confidence"])


def cap_parts_round_robin(documents: DataFrame, parts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(kept parts, omitted per question): first parts of every document, then second parts, …"""
    keys = ["question_id", "folder_id", "document_id"]
    placed = parts.join(documents.select(*keys, "doc_order"), keys)
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy("part_order", "doc_order"))
    kept = placed.withColumn("_turn", turn).filter(F.col("_turn") <= limit).drop("_turn")
    totals = placed.groupBy("question_id").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted_parts"))
    return kept, totals


def lexical_fallback(
    documents: DataFrame, parts: DataFrame, candidates: DataFrame, intents: DataFrame, confidence: DataFrame, params: Params
) -> DataFrame:
    """Parts added where routing was empty or unsure: best candidates not selected yet.

    A candidate of a document that is not selected needs a free document slot; slots go to new
    documents by their first rank. Gives rows with `fallback_order`.
    """
    doc_keys = ["question_id", "folder_id", "document_id"]
    selected = parts.groupBy("question_id").agg(F.count("*").alias("n_parts"))
    counts = documents.groupBy("question_id").agg(F.count("*").alias("n_docs"))
    low = min(100, params.navigation_low_confidence_percent) / 100
    unsure = (
        intents.filter("intent = 'answer'")
        .join(confidence, "question_id")
        .join(selected, "question_id", "left")
        .join(counts, "question_id", "left")
        .fillna(0, ["n_parts", "n_docs"])
        .filter((F.col("n_parts") == 0) | (F.col("confidence") < low))
    )
    slots = unsure.select(
        "question_id",
        F.least(F.greatest(F.lit(0), params.navigation_max_selected_parts - F.col("n_parts")), F.lit(params.lexical_fallback_parts)).alias("_parts"),
        (params.navigation_max_selected_documents - F.col("n_docs")).alias("_docs"),
    )
    open_ = candidates.join(slots, "question_id").join(parts.select("question_id", *PART), ["question_id", *PART], "left_anti")
    held = documents.select(*doc_keys, F.lit(True).alias("_held"))
    marked = open_.join(held, doc_keys, "left")
    first = F.min("rank").over(Window.partitionBy(*doc_keys))
    fresh = F.when(F.col("_held").isNull(), F.col("_first"))
    place = F.dense_rank().over(Window.partitionBy("question_id", F.col("_held").isNull()).orderBy("_first"))
    allowed = marked.withColumn("_first", first).withColumn("_place", F.when(fresh.isNotNull(), place)).filter(
        F.col("_held").isNotNull() | (F.col("_place") <= F.col("_docs"))
    )
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    return (
        allowed.withColumn("fallback_order", order)
        .filter(F.col("fallback_order") <= F.col("_parts"))
        .select("question_id", *PART, "rank", "fallback_order", F.col("_held").isNull().alias("new_document"))
    )


def add_fallback(documents: DataFrame, parts: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected documents and parts with the fallback parts appended in rank order."""
    keys = ["question_id", "folder_id", "document_id"]
    last = documents.groupBy("question_id").agg(F.max("doc_order").alias("_last"))
    new = added.filter("new_document").groupBy(*keys).agg(F.min("rank").alias("_first"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("_first"))
    fresh = new.join(last, "question_id", "left").select(
        *keys, F.lit(FALLBACK_REASON).alias("display_reason"), (F.coalesce("_last", F.lit(0)) + place).cast("int").alias("doc_order")
    )
    all_documents = documents.select(*keys, "display_reason", "doc_order").unionByName(fresh)
    tail = parts.groupBy(*keys).agg(F.max("part_order").alias("_tail"))
    behind = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    appended = (
        added.join(tail, keys, "left")
        .select(*keys, "part_id", (F.coalesce("_tail", F.lit(0)) + behind).cast("int").alias("part_order"))
        .join(all_documents.select(*keys, "doc_order"), keys)
    )
    columns = [*keys, "part_id", "part_order", "doc_order"]
    return all_documents, parts.select(*columns).unionByName(appended.select(*columns))


def evidence_content_join(parts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Selected parts with their Markdown as `content`."""
    texts = artifacts.select(F.col("document_id").cast("string").alias("document_id"), "part_id", F.col("markdown").alias("content"))
    return parts.join(texts, ["document_id", "part_id"])


def source_record_join(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Selected documents with their inventory record, if the id is canonical and known."""
    from foliary.functions.text import canonical_document_id, source_modified_at

    records = files.select("id", "filename", "relative_path", "source_status", source_modified_at(F.col("mtime_ns")).alias("source_modified_at"))
    return documents.withColumn("_id", canonical_document_id(F.col("document_id"))).join(
        records, F.col("_id") == F.col("id"), "left"
    ).drop("_id", "id")


def selection_counters(
    questions: DataFrame, reached: DataFrame, invalid_documents: DataFrame, invalid_parts: DataFrame, per_question: list[DataFrame]
) -> DataFrame:
    """All counters per question; frames in `per_question` are (question_id, counter)."""
    keys = ["question_id", "folder_id"]
    open_ = reached.filter("reached").select(*keys)
    out = questions.select("question_id")
    frames = [
        _counts(invalid_documents.join(open_, keys, "left_semi"), "invalid_documents"),
        _counts(invalid_parts.join(open_, keys, "left_semi"), "invalid_parts"),
        *per_question,
    ]
    for frame in frames:
        out = out.join(frame, "question_id", "left")
    return out.fillna(0)


def split_routing_document(routing: DataFrame, budget_bytes: Column | int) -> DataFrame:
    """Routing records of documents, split where a document exceeds its byte room.

    `routing` has question_id, folder_id, document_id, head_bytes (record without parts), bare_bytes
    (head with summary, topics and entities left out) and `parts` as array of
    struct(part_id, bytes, bare_bytes). A document that fits is one record. Else the head is reduced and
    its parts spread over records; a part that fails even alone loses its summary, and if it still fails
    the record is flagged. The parts of one card are few and carried as sizes only.
    """
    room = budget_bytes if isinstance(budget_bytes, Column) else F.lit(budget_bytes)
    room = room.cast("long")
    parts = F.col("parts")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + p["bytes"] + 1)
    whole = F.col("head_bytes") + total <= room
    left = room - F.col("bare_bytes")
    state = F.struct(
        F.lit(0).alias("no"), F.lit(0).cast("long").alias("used"),
        F.array().cast("array<struct<record_no:int,part_id:string,reduced:boolean,fits:boolean>>").alias("out"),
    )

    def place(done, part):
        full = part["bytes"] + 1
        holds = (done["no"] > 0) & (done["used"] + full <= left)
        reduced = ~holds & (full > left)
        cost = F.when(reduced, part["bare_bytes"] + 1).otherwise(full)
        number = F.when(holds, done["no"]).otherwise(done["no"] + 1)
        return F.struct(
            number.alias("no"), F.when(holds, done["used"] + full).otherwise(cost).alias("used"),
            F.concat(
                done["out"],
                F.array(F.struct(number.alias("record_no"), part["part_id"].alias("part_id"), reduced.alias("reduced"), (cost <= left).alias("fits"))),
            ).alias("out"),
        )

    one = F.transform(
        parts, lambda p: F.struct(F.lit(1).alias("record_no"), p["part_id"].alias("part_id"), F.lit(False).alias("reduced"), F.lit(True).alias("fits"))
    )
    empty = F.array(F.struct(F.lit(1).alias("record_no"), F.lit(None).cast("string").alias("part_id"), F.lit(False).alias("reduced"), (F.lit(0) <= left).alias("fits")))
    placed = F.when(whole & (F.size(parts) > 0), one).when(F.size(parts) == 0, empty).otherwise(F.aggregate(parts, state, place)["out"])
    return routing.select("question_id", "folder_id", "document_id", (~whole).alias("compressed"), F.inline(placed))
