"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the table folder (default sf0.1), BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from tests.session import local_session  # noqa: E402

# navigate and the queries after it start from the stored candidates, which are searched once before
# the clock starts for them; top_candidates itself is timed from the raw documents.
HEADLINES = (
    "top_candidates", "lexical_terms", "chunk_sections", "number_parts", "table_rows_to_parts", "scan_diff", "folder_tree_rollup",
    "batch_index_parts", "build_root", "normalize_cards", "build_index", "ingest", "navigate", "eligible_evidence", "validate_citations",
)
NEEDS_CANDIDATES = {"navigate", "eligible_evidence", "validate_citations"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    # Warm the JVM and the Python workers on the smallest tables.
    queries["lexical_terms"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        if name in NEEDS_CANDIDATES:
            from foliary.plans import adapter

            adapter.candidates(spark, sf_dir)
            adapter.card_parts(spark, sf_dir)
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
