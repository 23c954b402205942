"""Tables to Markdown parts: physical row batches, rendered natively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.anchors import anchor
from foliary.functions.cells import spreadsheet_column_name, table_cell_render
from foliary.operators.sizing import same_keys


def render_row(frame: DataFrame, columns: list[str]):
    """Array of rendered cells from typed columns."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    return F.array(*[table_cell_render(F.col(c), types[c]) for c in columns])


def table_rows_to_parts(rows: DataFrame, rows_per_part: int) -> DataFrame:
    """Drafts (document_id, sheet, batch_no, anchors, body) of Markdown tables.

    `rows` holds document_id, sheet, the physical row_no from 1 and the rendered cells. Grouping is
    by (document, sheet, batch), so a group never exceeds `rows_per_part` rows. All-empty rows and
    batches are dropped, but the anchor counts physical rows.
    """
    batch = F.floor((F.col("row_no") - 1) / rows_per_part).cast("long")
    filled = F.exists("cells", lambda c: c.isNotNull() & (c != ""))
    batches = (
        rows.select("document_id", "sheet", "row_no", "cells", filled.alias("_filled"))
        .groupBy("document_id", "sheet", batch.alias("batch_no"))
        .agg(
            F.min("row_no").alias("_first"),
            F.max("row_no").alias("_last"),
            F.max(F.when(F.col("_filled"), F.size("cells"))).alias("_width"),
            F.sort_array(
                F.collect_list(F.when(F.col("_filled"), F.struct("row_no", "cells")))
            ).alias("_rows"),
        )
        .filter(F.col("_width").isNotNull())
    )

    def line(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    letters = F.transform(F.sequence(F.lit(1), F.col("_width")), spreadsheet_column_name)
    heading = line(F.concat(F.array(F.lit("Row")), letters))
    rule = line(F.array_repeat(F.lit("---"), F.col("_width") + 1))
    body_lines = F.transform(
        "_rows",
        lambda r: line(
            F.concat(
                F.array(r["row_no"].cast("string")),
                F.transform(r["cells"], lambda c: F.coalesce(c, F.lit(""))),
                F.array_repeat(F.lit(""), F.col("_width") - F.size(r["cells"])),
            )
        ),
    )
    span = F.concat(F.col("_first").cast("string"), F.lit("-"), F.col("_last").cast("string"))
    title = F.when(
        F.col("sheet").isNotNull(), F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n\n"))
    ).otherwise(F.lit(""))
    body = F.concat(
        title, F.lit("Rows "), span, F.lit("\n\n"),
        F.array_join(F.concat(F.array(heading, rule), body_lines), "\n"),
    )
    return batches.select(
        "document_id",
        "sheet",
        "batch_no",
        anchor(rows=span, sheet=F.col("sheet")).alias("anchors"),
        body.alias("body"),
    )


def empty_table_marker(drafts: DataFrame, sheets: DataFrame) -> DataFrame:
    """A placeholder draft for each sheet or file that produced no draft."""
    seen = drafts.select("document_id", "sheet").distinct()
    empty = sheets.join(seen, same_keys(sheets, seen, ["document_id", "sheet"]), "left_anti")
    body = F.when(F.col("sheet").isNull(), F.lit("_Empty delimited file._")).otherwise(
        F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n\n_Empty sheet._"))
    )
    return empty.select(
        "document_id",
        "sheet",
        F.lit(0).cast("long").alias("batch_no"),
        anchor(rows=F.lit("empty"), sheet=F.col("sheet")).alias("anchors"),
        body.alias("body"),
    )
