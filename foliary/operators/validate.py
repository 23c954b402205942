"""Data-quality checks. Each gives rows (key…, rule) for what is wrong, or splits valid from rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import params as P
from foliary.functions.bounded import bounded_string_list, bounded_text, required_text, string_list_error
from foliary.functions.paths import is_safe_index_path
from foliary.functions.text import is_blank, strip


def broken_rules(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for every rule that does not hold; null counts as not holding."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return rows.select(*keys, F.explode(broken).alias("rule"))


def first_error(checks: dict[str, Column]) -> Column:
    """Name of the first check that does not hold, else null."""
    error = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        error = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(error)
    return error


def has_keys(json_text: Column, *keys: str) -> Column:
    """The JSON object has exactly these keys."""
    return F.array_sort(F.json_object_keys(json_text)) == F.array(*[F.lit(k) for k in sorted(keys)])


def _text_field(value: Column, name: str) -> Column:
    """A field of a variant if it is a JSON string, else null."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind.startswith("STRING"), F.try_variant_get(value, f"$.{name}", "string"))


def _list_field(value: Column, name: str) -> Column:
    """A field of a variant if it is a list of JSON strings, else null."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(value, f"$.{name}", "array<string>"))


def _manifest(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part_id", "path", "anchors"))), lambda p: p).alias("_manifest")
    )


def _with_model_parts(rows: DataFrame, json: str) -> DataFrame:
    """Adds the parsed reply and its parts as variants."""
    parsed = F.try_parse_json(F.col(json))
    return rows.withColumn("_value", parsed).withColumn("_parts", F.try_variant_get(parsed, "$.parts", "array<variant>"))


def _part_checks(summary_limit: int) -> dict[str, Column]:
    ids = F.transform("_manifest", lambda m: m["part_id"])
    return {
        "part count": F.size("_parts") == F.size("_manifest"),
        "part shape": F.forall("_parts", lambda p: has_keys(F.to_json(p), "part_id", "label", "summary")),
        "part id": F.transform("_parts", lambda p: _text_field(p, "part_id")) == ids,
        "part text": F.forall(
            "_parts",
            lambda p: bounded_text(_text_field(p, "label"), P.TITLE_CHARS)["error"].isNull()
            & bounded_text(_text_field(p, "summary"), summary_limit)["error"].isNull(),
        ),
    }


def _clean_part(part: Column, summary_limit: int) -> list[Column]:
    return [
        _text_field(part, "part_id").alias("part_id"),
        bounded_text(_text_field(part, "label"), P.TITLE_CHARS)["value"].alias("label"),
        bounded_text(_text_field(part, "summary"), summary_limit)["value"].alias("summary"),
    ]


def normalize_cards(replies: DataFrame, parts: DataFrame, updated_at: str) -> tuple[DataFrame, DataFrame]:
    """(cards, rejects) of model card replies: document_id, source_path, card_json."""
    rows = _with_model_parts(replies.join(_manifest(parts, ["document_id"]), "document_id", "left"), "card_json")
    title = bounded_text(_text_field(F.col("_value"), "title"), P.TITLE_CHARS)
    kind = bounded_text(_text_field(F.col("_value"), "document_type"), P.TYPE_CHARS)
    summary = bounded_text(_text_field(F.col("_value"), "summary"), P.CARD_SUMMARY_CHARS)
    topics = bounded_string_list(_list_field(F.col("_value"), "topics"), P.CARD_TOPICS, P.TOPIC_CHARS)
    entities = bounded_string_list(_list_field(F.col("_value"), "entities"), P.CARD_ENTITIES, P.ENTITY_CHARS)
    checks = {
        "shape": has_keys(F.col("card_json"), "title", "document_type", "summary", "topics", "entities", "parts"),
        **_part_checks(P.PART_SUMMARY_CHARS),
        "title": title["error"].isNull(),
        "document_type": kind["error"].isNull(),
        "summary": summary["error"].isNull(),
        "topics": topics["error"].isNull(),
        "entities": entities["error"].isNull(),
    }
    checked = rows.withColumn("error", first_error(checks))
    doc = F.col("document_id").cast("string")
    card_parts = F.zip_with(
        "_parts", "_manifest",
        lambda p, m: F.struct(
            *_clean_part(p, P.PART_SUMMARY_CHARS),
            F.concat(F.lit("md/"), doc, F.lit("/"), m["path"]).alias("md_path"), F.array(m["anchors"]).alias("source_anchors"),
        ),
    )
    cards = checked.filter("error is null").select(
        doc.alias("document_id"), "source_path", title["value"].alias("title"), kind["value"].alias("document_type"),
        summary["value"].alias("summary"), topics["value"].alias("topics"), entities["value"].alias("entities"),
        F.lit(updated_at).alias("updated_at"), card_parts.alias("parts"),
    )
    return cards, checked.filter("error is not null").select("document_id", "error")


def normalize_part_batches(replies: DataFrame, parts: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, rejects) of model batch replies: document_id, batch_no, batch_json."""
    keys = ["document_id", "batch_no"]
    members = parts.join(batches.select("document_id", "part_no", "batch_no"), ["document_id", "part_no"])
    rows = _with_model_parts(replies.join(_manifest(members, keys), keys, "left"), "batch_json")
    summary = bounded_text(_text_field(F.col("_value"), "batch_summary"), 1_500)
    checks = {"shape": has_keys(F.col("batch_json"), "batch_summary", "parts"), **_part_checks(600), "summary": summary["error"].isNull()}
    checked = rows.withColumn("error", first_error(checks))
    clean = checked.filter("error is null").select(
        *keys, summary["value"].alias("batch_summary"), F.transform("_parts", lambda p: F.struct(*_clean_part(p, 600))).alias("parts")
    )
    return clean, checked.filter("error is not null").select(*keys, "error")


def merge_batch_cards(metadata: DataFrame, batches: DataFrame) -> DataFrame:
    """Card replies of hierarchical documents: the metadata with the parts of all batches in order."""
    joined = batches.groupBy("document_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", "parts"))), lambda b: b["parts"])).alias("parts")
    )
    return metadata.join(joined, "document_id")


def validate_cards(cards: DataFrame, parts: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, rule) for stored cards that do not match their manifest or caps."""
    manifest = _manifest(parts, ["document_id"]).withColumn("document_id", F.col("document_id").cast("string"))
    known = files.select(F.col("id").cast("string").alias("document_id"), F.col("relative_path").alias("_path"))
    rows = cards.join(manifest, "document_id", "left").join(known, "document_id", "left")
    doc = F.col("document_id")
    rules = {
        "source path": F.col("source_path") == F.col("_path"),
        "title": required_text(F.col("title"), P.TITLE_CHARS).isNull(),
        "document_type": required_text(F.col("document_type"), P.TYPE_CHARS).isNull(),
        "summary": required_text(F.col("summary"), P.CARD_SUMMARY_CHARS).isNull(),
        "topics": string_list_error(F.col("topics"), P.CARD_TOPICS, P.TOPIC_CHARS).isNull(),
        "entities": string_list_error(F.col("entities"), P.CARD_ENTITIES, P.ENTITY_CHARS).isNull(),
        "updated_at": F.col("updated_at").try_cast("timestamp").isNotNull() & (F.length("updated_at") <= 64),
        "part ids": F.transform("parts", lambda p: p["part_id"]) == F.transform("_manifest", lambda m: m["part_id"]),
        "part text": F.forall(
            "parts",
            lambda p: required_text(p["label"], P.TITLE_CHARS).isNull() & required_text(p["summary"], P.PART_SUMMARY_CHARS).isNull(),
        ),
        "part paths": F.transform("parts", lambda p: p["md_path"])
        == F.transform("_manifest", lambda m: F.concat(F.lit("md/"), doc, F.lit("/"), m["path"])),
        "part anchors": F.transform("parts", lambda p: F.to_json(p["source_anchors"]))
        == F.transform("_manifest", lambda m: F.to_json(F.array(m["anchors"]))),
    }
    return broken_rules(rows, ["document_id"], rules)


def validate_folders(folders: DataFrame, documents: DataFrame, root: DataFrame) -> DataFrame:
    """(folder_id, rule) for folder indexes; `documents` holds their compact cards as rows."""
    entry_rules = (
        required_text(F.col("source_path"), 2_000).isNull()
        & required_text(F.col("title"), P.TITLE_CHARS).isNull()
        & required_text(F.col("document_type"), P.TYPE_CHARS).isNull()
        & required_text(F.col("summary"), P.FOLDER_DOCUMENT_SUMMARY_CHARS).isNull()
        & string_list_error(F.col("topics"), P.COMPACT_TOPICS, P.TOPIC_CHARS).isNull()
        & string_list_error(F.col("entities"), P.COMPACT_ENTITIES, P.ENTITY_CHARS).isNull()
        & required_text(F.col("updated_at"), 64).isNull()
    )
    path = F.col("card_path") == F.concat(F.lit("md/"), "document_id", F.lit("/card.json"))
    per_document = documents.groupBy("folder_id", "document_id").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce(entry_rules, F.lit(False))).alias("entry"), F.bool_and(F.coalesce(path, F.lit(False))).alias("path")
    )
    per_folder = per_document.groupBy("folder_id").agg(
        F.sum("n").alias("_n"), F.max("n").alias("_most"), F.bool_and("entry").alias("_entry"), F.bool_and("path").alias("_path")
    )
    entries = root.select("folder_id", F.struct("source_directory", "summary", "document_count").alias("_root"))
    rows = folders.join(per_folder, "folder_id", "left").join(entries, "folder_id", "left")
    rules = {
        "source directory": required_text(F.col("source_directory"), 2_000).isNull(),
        "summary": required_text(F.col("summary"), P.FOLDER_SUMMARY_CHARS).isNull(),
        "document count": F.col("document_count") == F.coalesce("_n", F.lit(0)),
        "unique ids": F.coalesce("_most", F.lit(1)) == 1,
        "entries": F.coalesce("_entry", F.lit(True)),
        "card paths": F.coalesce("_path", F.lit(True)),
        "root agrees": F.col("_root") == F.struct("source_directory", "summary", "document_count"),
    }
    return broken_rules(rows, ["folder_id"], rules)


def validate_root(root: DataFrame) -> DataFrame:
    """(folder_id, rule) for root entries."""
    limits = {"document_types": P.TYPE_CHARS, "topics": P.TOPIC_CHARS, "entities": P.ENTITY_CHARS, "representative_titles": P.TITLE_CHARS}
    repeated = root.groupBy("folder_id").agg(F.count("*").alias("_n"))
    rules = {
        "folder id": required_text(F.col("folder_id"), 100).isNull(),
        "unique id": F.col("_n") == 1,
        "source directory": required_text(F.col("source_directory"), 2_000).isNull(),
        "summary": required_text(F.col("summary"), P.FOLDER_SUMMARY_CHARS).isNull(),
        "document count": F.col("document_count") >= 0,
        **{name: string_list_error(F.col(name), P.ROOT_MAX[name], limit).isNull() for name, limit in limits.items()},
        "index path": is_safe_index_path(F.col("index_path")),
    }
    return broken_rules(root.join(repeated, "folder_id"), ["folder_id"], rules)


def id_set_equal(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (missing, unexpected, duplicated, equal) comparing two sets of key rows."""
    keys = expected.columns
    both = expected.distinct().withColumn("_e", F.lit(1)).join(
        actual.groupBy(*keys).agg(F.count("*").alias("_a")), keys, "full"
    )
    counts = both.agg(
        F.count_if(F.col("_a").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"),
        F.count_if(F.col("_a") > 1).alias("duplicated"),
    )
    return counts.withColumn("equal", (F.col("missing") + F.col("unexpected") + F.col("duplicated")) == 0)


def validate_lexical_index(indexed: DataFrame, metadata: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: version, part count and id set of the stored index against the expected parts."""
    sets = id_set_equal(expected, indexed.select(*expected.columns))
    total = expected.distinct().agg(F.count("*").alias("_expected"))
    one = F.lit(1).alias("_one")
    joined = sets.select("*", one).join(metadata.select("*", one), "_one").join(total.select("*", one), "_one")
    return joined.select(
        (F.col("schema_version") == P.LEXICAL_VERSION).alias("version_ok"),
        (F.col("part_count") == F.col("_expected")).alias("count_ok"), F.col("equal").alias("ids_ok"), "missing", "unexpected", "duplicated",
    )


def validate_generation(root: DataFrame, documents: DataFrame, eligible: DataFrame, indexed: DataFrame, expected_parts: DataFrame) -> DataFrame:
    """(rule, broken): number of violations of each rule of a whole generation."""
    ids = documents.groupBy("document_id").agg(F.count("*").alias("n"))
    wanted = eligible.select(F.col("id").cast("string").alias("document_id"), F.lit(1).alias("_w"))
    compared = wanted.join(ids, "document_id", "full")
    members = compared.agg(
        F.count_if(F.col("n") > 1).alias("one folder per document"), F.count_if(F.col("_w").isNull()).alias("only eligible documents"),
        F.count_if(F.col("n").isNull()).alias("all eligible documents"),
    )
    counted = root.agg(F.coalesce(F.sum("document_count"), F.lit(0)).alias("_root"))
    total = eligible.agg(F.count("*").alias("_eligible"))
    parts = id_set_equal(expected_parts, indexed.select(*expected_parts.columns)).select(
        (F.col("missing") + F.col("unexpected") + F.col("duplicated")).alias("search index parts")
    )
    one = F.lit(1).alias("_one")
    row = members.select("*", one).join(counted.select("*", one), "_one").join(total.select("*", one), "_one").join(parts.select("*", one), "_one")
    row = row.withColumn("root document count", F.abs(F.col("_root") - F.col("_eligible")))
    names = ("one folder per document", "only eligible documents", "all eligible documents", "root document count", "search index parts")
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("broken")) for n in names])))


def validate_answer_contract(answers: DataFrame) -> DataFrame:
    """(question_id, rule) for raw answer replies that break their contract."""
    value = F.try_parse_json(F.col("answer_json"))
    rows = answers.withColumn("_v", value)

    def items(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "array<variant>")

    def texts(item: Column, *names: str) -> Column:
        ok = F.lit(True)
        for name in names:
            ok = ok & ~is_blank(_text_field(item, name))
        return ok

    def objects(name: str, *fields: str) -> Column:
        return F.forall(items(name), lambda i: has_keys(F.to_json(i), *fields) & texts(i, *fields))

    def conflict(item: Column) -> Column:
        values = F.try_variant_get(item, "$.values", "array<variant>")
        fields = ("value", "document_id", "anchor")
        return (
            has_keys(F.to_json(item), "subject", "values", "analysis") & texts(item, "subject", "analysis") & (F.size(values) >= 2)
            & F.forall(values, lambda v: has_keys(F.to_json(v), *fields) & texts(v, *fields))
        )

    handoff = F.try_variant_get("_v", "$.research_handoff", "variant")
    missing = _list_field(handoff, "missing_information")
    known = _list_field(handoff, "known_information")
    rules = {
        "keys": has_keys(F.col("answer_json"), "answer_markdown", "citations", "conflicts", "downloads", "research_handoff"),
        "answer": ~is_blank(_text_field(F.col("_v"), "answer_markdown")),
        "citations": objects("citations", "document_id", "part_id", "anchor", "label"),
        "conflicts": F.forall(items("conflicts"), conflict),
        "downloads": objects("downloads", "document_id"),
        "handoff": handoff.isNull() | F.is_variant_null(handoff) | (
            has_keys(F.to_json(handoff), "reason", "known_information", "missing_information", "prompt")
            & texts(handoff, "reason", "prompt") & (F.size(missing) >= 1)
            & F.forall(missing, lambda x: ~is_blank(x)) & F.forall(known, lambda x: ~is_blank(x))
        ),
    }
    return broken_rules(rows, ["question_id"], rules)


def validate_router_contract(folder_selection: DataFrame, document_selection: DataFrame) -> DataFrame:
    """(question_id, response_no, rule) for router responses of both phases."""
    keys = ["question_id", "response_no"]
    filled = lambda ids: F.forall(ids, lambda x: ~is_blank(x))
    first = {
        "intent": F.col("intent").isin(*P.INTENTS),
        "folder ids": filled("selected_folders"),
        "reason": F.length("display_reason") <= P.REASON_CHARS,
        "need_more_information": F.col("need_more_information").isNotNull(),
    }
    second = {
        "confidence": F.col("confidence").between(0.0, 1.0),
        "documents": F.forall(
            "selected_documents",
            lambda d: ~is_blank(d["document_id"]) & filled(d["part_ids"]) & (F.length(d["display_reason"]) <= P.REASON_CHARS),
        ),
    }
    return broken_rules(folder_selection, keys, first).unionByName(broken_rules(document_selection, keys, second))


def validate_messages(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """(conv_id, rule) for histories and questions outside the request limits."""
    text = strip(F.col("text"))
    per_conversation = messages.groupBy("conv_id").agg(
        F.bool_and(F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).alias("_roles"),
        F.bool_and(~is_blank(F.col("text")) & (F.length("text") <= P.HISTORY_MESSAGE_CHARS)).alias("_content"),
        F.count("*").alias("_n"), F.sum(F.length(text)).alias("_chars"),
    )
    rows = questions.join(per_conversation, "conv_id", "left")
    rules = {
        "roles": F.coalesce("_roles", F.lit(True)),
        "content": F.coalesce("_content", F.lit(True)),
        "message count": F.coalesce("_n", F.lit(0)) <= P.HISTORY_MESSAGES,
        "total size": F.coalesce("_chars", F.lit(0)) <= P.HISTORY_CHARS,
        "question": ~is_blank(F.col("question")) & (F.length("question") <= P.QUESTION_CHARS),
    }
    return broken_rules(rows, ["conv_id"], rules)


def validate_inventory(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """(kind, id, rule) for inventory and job rows outside their value sets."""
    repeated = files.groupBy("relative_path").agg(F.count("*").alias("_n"))
    file_rules = {
        "source status": F.col("source_status").isin(P.PRESENT, P.MISSING),
        "conversion status": F.col("conversion_status").isin(*P.CONVERSION_STATUSES),
        "index status": F.col("index_status").isin(*P.INDEX_STATUSES),
        "size": F.col("size") >= 0,
        "mtime": F.col("mtime_ns") >= 0,
        "unique path": F.col("_n") == 1,
    }
    job_rules = {
        "status": F.col("status").isin(*P.JOB_STATUSES),
        "control": F.col("control_state").isin(*P.JOB_CONTROLS),
        "counts": (F.col("completed_items") >= 0) & (F.col("failed_items") >= 0) & (F.col("completed_items") + F.col("failed_items") <= F.col("total_items")),
    }
    a = broken_rules(files.join(repeated, "relative_path").withColumn("kind", F.lit("file")), ["kind", "id"], file_rules)
    b = broken_rules(jobs.select("*", F.lit("job").alias("kind"), F.col("job_id").alias("id")), ["kind", "id"], job_rules)
    return a.unionByName(b)
