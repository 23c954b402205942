"""Registered queries against their SQL at the smallest scale.

The quick areas always run; FOLIARY_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
import catalog
from catalog import inventory_queries, scalar_queries
from tests.compare import difference, oracle

SF = "/root/testdata/sf0.001"
QUICK = [*scalar_queries.SQL, *inventory_queries.SQL, "top_candidates", "build_root", "navigate", "validate_citations", "ingest", "ingest_inventory",
         "read_delimited_tables", "write_folder_index", "write_root_index", "stream_job_progress"]
NAMES = list(catalog.statements()) if os.environ.get("FOLIARY_ALL") else QUICK


@pytest.fixture(scope="module")
def connection():
    return oracle(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    text, _, _ = difference(entry.queries()[name], entry.oracle_sql()[name], spark, connection, SF)
    assert text == ""


def test_plans_stay_distributed(spark):
    plan = entry.queries()["top_candidates"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "folder_id", "document_id", "part_id", "rank", "score"]
