"""Source anchors: canonical JSON and the place they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions.text import json_string, normalize_markdown, strip

# Alphabetical, so that to_json gives the canonical string; nulls are left out.
ANCHOR = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("rows", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("slide", T.IntegerType()),
    ]
)
FRONT_MATTER_ORDER = ("page", "slide", "sheet", "rows", "section", "segment")
UNKNOWN_PLACE = "原文相关位置"


def anchor(**parts: Column) -> Column:
    """Anchor struct from the given fields; the others are null."""
    return F.struct(
        *[
            (parts[f.name] if f.name in parts else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ANCHOR.fields
        ]
    )


def with_segment(base: Column, segment: Column) -> Column:
    return anchor(**{f.name: base[f.name] for f in ANCHOR.fields} | {"segment": segment})


def canonical_anchor(value: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(value)


def human_source_location(anchor_json: Column) -> Column:
    """Readable place of a canonical anchor string, with a fallback for anything else."""
    parsed = F.try_parse_json(anchor_json)

    def typed(name: str, kind: str, prefix: str) -> Column:
        field = F.try_variant_get(parsed, f"$.{name}", "variant")
        return F.when(
            F.schema_of_variant(field).startswith(prefix), F.try_variant_get(parsed, f"$.{name}", kind)
        )

    def number(name: str) -> Column:
        return typed(name, "bigint", "BIGINT")

    def words(name: str) -> Column:
        value = strip(typed(name, "string", "STRING"))
        return F.when(value != "", value)

    def around(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value.cast("string"), F.lit(after))

    rows, section, segment = words("rows"), words("section"), words("segment")
    numbered = F.regexp_extract(section, r"(?i)^section-(\d+)$", 1)
    places = F.array(
        around("第 ", number("page"), " 页"),
        around("第 ", number("slide"), " 张幻灯片"),
        around("工作表“", words("sheet"), "”"),
        F.when(rows != "empty", around("第 ", rows, " 行")),
        F.when(numbered != "", around("第 ", numbered, " 部分"))
        .when(section == "document", F.lit("全文"))
        .when(section == "image", F.lit("图片内容"))
        .otherwise(around("章节“", section, "”")),
        F.when(segment.rlike(r"^\d+/\d+$"), around("片段 ", segment, "")),
    )
    joined = F.array_join(F.array_compact(places), "·")
    return F.when(joined == "", F.lit(UNKNOWN_PLACE)).otherwise(F.coalesce(joined, F.lit(UNKNOWN_PLACE)))


def part_front_matter(
    document_id: Column,
    source_path: Column,
    source_sha256: Column,
    part_id: Column,
    converted_at: Column,
    anchors: Column,
    version: str,
) -> Column:
    """YAML header of a part: six fixed keys, then the anchor fields that are present."""
    lines = [
        F.lit("---"),
        F.concat(F.lit("document_id: "), document_id.cast("string")),
        F.concat(F.lit("source_path: "), json_string(source_path)),
        F.concat(F.lit("source_sha256: "), json_string(source_sha256)),
        F.concat(F.lit("part_id: "), json_string(part_id)),
        F.concat(F.lit("converted_at: "), json_string(converted_at)),
        F.lit(f'converter_version: "{version}"'),
    ]
    for name in FRONT_MATTER_ORDER:
        value = anchors[name]
        shown = value.cast("string") if name in ("page", "slide") else json_string(value)
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), shown)))
    lines.append(F.lit("---"))
    return F.concat_ws("\n", *lines)


def render_part(front_matter: Column, body: Column) -> Column:
    """Full Markdown of a part."""
    return F.concat(front_matter, F.lit("\n\n"), normalize_markdown(body), F.lit("\n"))
