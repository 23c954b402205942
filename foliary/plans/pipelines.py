"""End-to-end plans: ingest, build, search, navigate, assemble."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.paths import folder_id_of, source_directory_of
from foliary.operators import answers as W, folds, hierarchy as H, inventory as I, lexical as L, navigation as N, validate as V
from foliary.operators.chunking import bound_drafts, chunk_sections, number_parts
from foliary.operators.sizing import number_sorted, settled
from foliary.operators.tables import empty_table_marker, table_rows_to_parts
from foliary.params import LEXICAL_VERSION, Params
from foliary.sources import artifacts, files as S, segments


#: Routes whose files are per-file codecs without an extractor here.
NO_EXTRACTOR = ("workbook", "slides", "word", "pdf", "image")


@dataclass(frozen=True)
class Ingest:
    """Result of `ingest`: the new inventory, the parts of converted documents, and what failed."""

    inventory: DataFrame
    changes: DataFrame
    parts: DataFrame
    rejects: DataFrame


def assign_ids(changes: DataFrame) -> DataFrame:
    """Gives new inventory rows the ids after the highest one, in path order."""
    highest = changes.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = number_sorted(changes.filter("change = 'new'"), ["relative_path"], "_no")
    numbered = fresh.withColumn("id", (highest + F.col("_no")).cast("long")).drop("_no")
    return changes.filter("change <> 'new'").unionByName(numbered)


def ingest(previous: DataFrame, listing: DataFrame, contents: DataFrame, converted_at: str, params: Params) -> Ingest:
    """Scan diff, then parts and final status of every new or changed document.

    `listing` is a scan with hashes where `scan_candidates` asked for them; `contents` has
    relative_path and content bytes. The diff is written once, and so are the contents of the files to
    convert, by route: each route reads its own files from there, and contents are moved once.

    Every converted file ends in the parts or in the rejects, never in both: READY with its parts,
    FAILED with its first error or `no text`, or UNSUPPORTED where there is no extractor. The inventory
    has these statuses, so a second run converts nothing and `build_index` finds the READY files.
    """
    changes = settled(assign_ids(I.scan_diff(previous, listing)))
    inventory = I.inventory_after(changes)
    todo = I.dispatch_by_extension(inventory.filter("source_status = 'PRESENT' AND conversion_status IN ('NEW', 'CHANGED')")).select(
        F.col("id").alias("document_id"), "relative_path", F.col("sha256").alias("source_sha256"), F.lit(converted_at).alias("converted_at"), "extension",
        F.when(~F.col("extractor").isin(*NO_EXTRACTOR), F.col("extractor")).alias("extractor"),
    )
    source = settled(todo.filter("extractor IS NOT NULL").join(contents.select("relative_path", "content"), "relative_path"))
    texts, undecoded = S.read_text_documents(source)
    keys = ["document_id", "relative_path", "source_sha256", "converted_at"]

    def of(kind: str) -> DataFrame:
        return texts.filter(F.col("extractor") == kind).select(*keys, "text")

    sections = chunk_sections(of("text"), params.document_text_chars_per_part)
    pages = S.html_pages_to_parts(of("html").withColumnRenamed("text", "html"), params.document_text_chars_per_part)
    json_drafts, json_rejects = S.read_json_documents(of("json"))
    xml_drafts, xml_rejects = S.read_xml_documents(of("xml"))
    drafts = sections.unionByName(pages).unionByName(json_drafts).unionByName(xml_drafts)
    refused = [undecoded, json_rejects, xml_rejects]
    for delimiter, extension in ((",", ".csv"), ("\t", ".tsv")):
        tables = texts.filter(F.col("extension") == extension).select(*keys, "text")
        rows, table_rejects = S.read_delimited_tables(tables, delimiter)
        batches = table_rows_to_parts(rows, params.document_excel_rows_per_part)
        sheets = tables.select("document_id", F.lit(None).cast("string").alias("sheet"))
        whole = batches.unionByName(empty_table_marker(batches, sheets)).withColumn("draft_no", (F.col("batch_no") + 1).cast("int"))
        drafts = drafts.unionByName(whole.join(tables.select(*keys), "document_id").select(*keys, "draft_no", "anchors", "body"))
        refused.append(table_rejects)
    bounded = bound_drafts(drafts, params.document_text_chars_per_part)
    errors = reduce(DataFrame.unionByName, [r.select("document_id", "error") for r in refused]).groupBy("document_id").agg(F.min("error").alias("error"))
    errors = settled(errors)
    parts = settled(number_parts(bounded, ("draft_no", "segment_no")).join(errors.select("document_id"), "document_id", "left_anti"))

    status = (
        F.when(F.col("extractor").isNull(), F.lit("UNSUPPORTED")).when(F.col("has_parts"), F.lit("READY")).otherwise(F.lit("FAILED"))
    )
    failed = F.coalesce("error", F.when(F.col("read"), F.lit("no text")).otherwise(F.lit("file cannot be read")))
    outcome = settled(
        todo.select("document_id", "extractor")
        .join(parts.select("document_id").distinct().withColumn("has_parts", F.lit(True)), "document_id", "left")
        .join(source.select("document_id").distinct().withColumn("read", F.lit(True)), "document_id", "left")
        .join(errors, "document_id", "left")
        .select("document_id", status.alias("status"), F.when(status == "UNSUPPORTED", F.lit("no extractor")).when(status == "FAILED", failed).alias("error"))
    )
    final = inventory.join(outcome.withColumnRenamed("document_id", "id"), "id", "left").withColumns({
        "conversion_status": F.coalesce("status", "conversion_status"),
        "last_error": F.when(F.col("status").isNull(), F.col("last_error")).otherwise(F.col("error")),
    }).select(*inventory.columns)
    return Ingest(final, changes, parts, outcome.filter("status <> 'READY'").select("document_id", "error"))


@dataclass(frozen=True)
class Index:
    """A generation before it is published: compact cards, card parts and postings.

    After `update_index` the postings are those of changed and new documents; `earlier` has the segments they are added
    to and `gone` the documents (document_id long) whose earlier postings are dead.
    """

    documents: DataFrame
    card_parts: DataFrame
    postings: DataFrame
    params: Params
    signatures: DataFrame | None = None
    earlier: segments.Stored | None = None
    gone: DataFrame | None = None

    def base(self) -> dict[str, DataFrame]:
        frames = {"documents": self.documents, "card_parts": self.card_parts, "postings": self.postings}
        return frames if self.signatures is None else frames | {"signatures": self.signatures}

    def derive(self, base: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
        """Frames that follow from the base frames; given the written ones, nothing is computed twice."""
        spark = self.documents.sparkSession
        counts, names, dead = segments.term_counts(base["postings"]), [folder], segments.no_dead(spark)
        if self.earlier is not None:
            live = self.earlier.postings()
            lost = live.join(self.gone, "document_id", "left_semi")
            counts = segments.merged_counts(self.earlier.counts, lost, counts)
            names = [*self.earlier.segments, folder]
            dead = self.earlier.dead.unionByName(segments.dead_rows(live, self.gone))
        counts = settled(counts)
        total = counts.filter(F.col("term") == L.EVERY_PART).select(F.col("parts").alias("part_count"))
        return {
            "root": H.build_root(base["documents"], self.params),
            "folders": H.folder_summary(base["documents"], self.params.folder_summary_topics),
            "term_counts": counts,
            "term_stats": segments.stats_of(counts),
            "metadata": total.select(F.lit(LEXICAL_VERSION).alias("schema_version"), "part_count"),
            "segments": spark.createDataFrame([(n,) for n in names], "segment string"),
            "dead": dead,
        }

    @property
    def root(self) -> DataFrame:
        return H.build_root(self.documents, self.params)


def stored_index(spark: SparkSession, path: str) -> segments.Stored | None:
    """Segments, dead rows and sums of the active generation; None before the first one."""
    frames = artifacts.read_current_generation(spark, path, ("segments", "dead", "term_counts"))
    if not frames:
        return None
    names = [r[0] for r in frames["segments"].collect()]
    return segments.Stored(path, names, frames["dead"], frames["term_counts"])


def _eligible(files: DataFrame, parts: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eligible documents, their cards and their parts."""
    eligible = I.eligible_documents(files)
    chosen = cards.join(eligible.select(F.col("id").cast("string").alias("document_id")), "document_id", "left_semi")
    return eligible, chosen, parts.join(eligible.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def build_index(
    files: DataFrame, parts: DataFrame, cards: DataFrame, params: Params, current: DataFrame | None = None, changed: DataFrame | None = None
) -> Index:
    """Folder, root and search index of the eligible documents.

    With `current` (the compact cards of the active generation) the rows of folders whose documents and
    cards did not change are taken over as they are; `changed` has ids of documents that did beside those whose
    status says so.
    """
    eligible, chosen, own = _eligible(files, parts, cards)
    documents = H.group_cards_by_folder(eligible, chosen)
    if current is not None:
        refreshed = eligible.filter("index_status <> 'INDEXED'").select(F.col("id").cast("string").alias("document_id"))
        reuse = H.folder_reuse_set(documents, current, refreshed if changed is None else refreshed.unionByName(changed).distinct())
        kept = reuse.filter("reuse").select("folder_id")
        documents = current.join(kept, "folder_id", "left_semi").unionByName(documents.join(kept, "folder_id", "left_anti"))
    records = H.cards_with_artifacts(chosen, own)
    directory = source_directory_of(F.col("source_path"))
    card_parts = H.explode_card_parts(chosen).withColumn("folder_id", folder_id_of(directory))
    return Index(documents, card_parts, L.part_postings(L.part_search(records)), params, segments.signatures(chosen, own))


def update_index(spark: SparkSession, path: str, files: DataFrame, parts: DataFrame, cards: DataFrame, params: Params) -> Index:
    """The next generation of a stored index, to be given to `publish`.

    Documents are compared with the active generation by their signatures. Only changed and new ones are
    tokenised; their postings become a segment of their own, and earlier postings of changed and removed documents
    are dead. With too many segments or dead documents all live postings are written as one segment (see
    `segments`). Before the first generation this is `build_index`.
    """
    earlier = stored_index(spark, path)
    if earlier is None:
        return build_index(files, parts, cards, params)
    stored = artifacts.read_current_generation(spark, path, ("documents", "signatures"))
    _, chosen, own = _eligible(files, parts, cards)
    now = settled(segments.signatures(chosen, own))
    changed = settled(segments.changes(stored["signatures"], now))
    gone = settled(changed.filter("known").select(F.col("document_id").cast("long").alias("document_id")))
    fresh = changed.filter("fresh").select("document_id")
    whole = build_index(files, parts, cards, params, stored["documents"], fresh)
    own = own.join(fresh.select(F.col("document_id").cast("long").alias("document_id")), "document_id", "left_semi")
    chosen = chosen.join(fresh, "document_id", "left_semi")
    delta = L.part_postings(L.part_search(H.cards_with_artifacts(chosen, own)))
    dead = earlier.dead.count() + gone.count()
    if len(earlier.segments) >= segments.MOST_SEGMENTS or dead > segments.MOST_DEAD * (dead + now.count()):
        kept = earlier.postings().join(gone, "document_id", "left_anti")
        return replace(whole, postings=kept.select(*delta.columns).unionByName(delta), signatures=now)
    return replace(whole, postings=delta, signatures=now, earlier=earlier, gone=gone)


def _live(written: dict[str, DataFrame], path: str) -> DataFrame:
    names = [r[0] for r in written["segments"].collect()]
    return segments.Stored(path, names, written["dead"], written["term_counts"]).postings()


def generation_violations(written: dict[str, DataFrame], eligible: DataFrame) -> DataFrame:
    """Broken rules of a written generation; empty when it may be activated."""
    keys = ["folder_id", "document_id", "part_id"]
    indexed = L.indexed_parts(written["postings"]).withColumn("document_id", F.col("document_id").cast("string"))
    whole = V.validate_generation(written["root"], written["documents"], eligible, indexed, written["card_parts"].select(*keys))
    return whole.filter("broken > 0").select("rule").unionByName(V.validate_root(written["root"]).select("rule"))


def publish(spark: SparkSession, index: Index, eligible: DataFrame, path: str) -> int | None:
    """Writes, checks and activates a generation; its number, or None if a check failed."""
    return artifacts.publish_generation(
        spark, index.base(), path, index.derive, lambda written: generation_violations(written | {"postings": _live(written, path)}, eligible)
    )


def search(spark: SparkSession, path: str, questions: DataFrame, params: Params) -> DataFrame | None:
    """Candidates of a batch of questions from the active generation; None before the first one."""
    stored = stored_index(spark, path)
    return L.search_index(questions, stored.postings(), segments.stats_of(stored.counts), params) if stored else None


def assemble_answers(evidence: DataFrame, answers: DataFrame, documents: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Validated citations with their sources, conflicts and downloads.

    `evidence` has question_id, document_id, part_id, label and source_anchors; `documents` has
    question_id, document_id, source_path and title.
    """
    allowed = W.evidence_anchors(evidence)
    return {
        "citations": W.citation_source_join(W.validate_citations(answers, allowed), documents),
        "conflicts": W.validate_conflicts(answers, allowed),
        "downloads": W.validate_downloads(answers, documents, files),
    }


@dataclass(frozen=True)
class Navigation:
    """Result frames of `navigate`, all keyed by question_id."""

    intents: DataFrame
    folders: DataFrame
    need: DataFrame
    routing: DataFrame
    candidates: DataFrame
    reached: DataFrame
    documents: DataFrame
    parts: DataFrame
    added: DataFrame
    confidence: DataFrame
    counters: DataFrame


def navigate(
    candidates: DataFrame, root: DataFrame, folder_documents: DataFrame, card_parts: DataFrame,
    folder_selection: DataFrame, document_selection: DataFrame, params: Params,
) -> Navigation:
    """Selected documents and parts of every question from search candidates and router responses.

    Social questions keep only their intent. The few frames that most later steps read (folders,
    candidates inside them, valid choices) are written once to the checkpoint folder; otherwise every
    step would repeat all steps before it. Nothing passes through the driver.
    """
    key = ["question_id"]
    pair = ["question_id", "folder_id"]
    intents = N.consensus_intent(folder_selection)
    active = intents.filter("intent <> 'small_talk'")
    limit = params.navigation_max_selected_documents

    responses = folder_selection.join(active.select(*key), key, "left_semi")
    kept, foreign = N.folder_whitelist(candidates.join(active.select(*key), key, "left_semi"), root)
    folders, unknown = N.select_folders(kept, responses, root)
    folders = settled(folders)
    need = N.need_more_information(responses, folders)
    routed = N.cap_folders(folders, limit)
    inside = settled(kept.join(routed.select(*pair), pair, "left_semi"))
    routing = N.document_card_join(routed, folder_documents, inside)
    valid, missing = N.part_whitelist(inside, card_parts)

    choices = document_selection.join(routed.select(*pair), pair, "left_semi")
    documents, parts, bad_documents, bad_parts = N.selection_whitelist(choices, routing, card_parts)
    documents, parts = settled(documents), settled(parts)
    merged, merged_parts = N.merge_selections(documents, parts)
    chosen, reached = N.cap_documents(merged, routed, limit)
    chosen, reached = settled(chosen), settled(reached)
    confidence = N.min_confidence(choices, reached, active)
    held, omitted = N.cap_parts_round_robin(chosen, merged_parts, params.navigation_max_selected_parts)
    held = settled(held)
    added = N.lexical_fallback(chosen, held, valid, active, confidence, params)
    added = settled(added)
    all_documents, all_parts = N.add_fallback(chosen, held, added)

    invalid = foreign.unionByName(missing).groupBy("question_id").agg(F.sum("invalid_lexical").alias("invalid_lexical"))
    fallback = added.groupBy("question_id").agg(F.count("*").alias("fallback_parts"))
    counters = N.selection_counters(active, reached, bad_documents, bad_parts, [unknown, invalid, omitted, fallback])
    return Navigation(
        intents, folders, need, routing, valid, reached, all_documents, all_parts, added, confidence, counters
    )


def evidence(nav: Navigation, artifacts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Parts of a navigation with their content and whether they fit the evidence budget."""
    return folds.evidence_budget(N.evidence_content_join(nav.parts, artifacts), budgets)
