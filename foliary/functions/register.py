"""SQL names for the column functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliary.functions import text as X
from foliary.operators.chunking import register_chunk_text
from foliary.functions.text import CJK, LATIN


def register_functions(spark: SparkSession) -> None:
    """Registers native functions as SQL functions, and the Python ones beside them.

    `lexical_runs` gives the term runs of folded text: lexical_runs(lexical_normalize(x)).
    """
    define = {
        "estimate_tokens(x STRING) RETURNS INT": "CAST(ceil(octet_length(x) / 3) AS INT)",
        "evidence_tokens(x STRING) RETURNS INT": "CAST(ceil((octet_length(to_json(named_struct('v', x))) - 6) / 3) AS INT)",
        "folder_id_of(directory STRING) RETURNS STRING": "concat('folder-', substring(sha2(directory, 256), 1, 16))",
        "canonical_document_id(x STRING) RETURNS BIGINT": "CASE WHEN x RLIKE '^[1-9][0-9]{0,18}$' THEN try_cast(x AS BIGINT) END",
        "lexical_runs(folded STRING) RETURNS ARRAY<STRING>": (
            f"regexp_extract_all(folded, '([{LATIN}]{{2,200}}|[0-9]|[{CJK}]+)(?:(?<=[{LATIN}])[{LATIN}]+)?', 1)"
        ),
        "canonical_anchor(a STRUCT<page: INT, rows: STRING, section: STRING, segment: STRING, sheet: STRING, slide: INT>) RETURNS STRING": "to_json(a)",
    }
    for head, body in define.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("lexical_normalize", X._fold_python)
    register_chunk_text(spark)
