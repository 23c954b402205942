"""Registered queries against their SQL where every eighth document has no text."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import difference, oracle
from tests.test_queries import SF

NAMES = ["incremental_index", "read_current_generation", "search", "publish_generation", "build_index", "validate_generation", "write_folder_index", "write_root_index", "group_cards_by_folder", "chunk_text", "chunk_markdown", "chunk_text_udtf", "chunk_texts_udtf", "bound_drafts", "refresh_plan", "validate_cards"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("blank")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    blank = F.when(F.col("doc_id") % 16 == 3, F.lit("")).when(F.col("doc_id") % 16 == 11, F.lit(" \n ")).otherwise(F.col("text"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", blank)
    docs.toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    text, _, _ = difference(entry.queries()[name], entry.oracle_sql()[name], spark, oracle(tables), tables)
    assert text == ""


def test_a_card_for_every_document(spark, tables):
    from foliary.plans import adapter as A

    cards = A.cards(spark, tables)
    assert cards.count() == 200
    assert cards.filter("size(parts) = 0").count() == cards.filter("title = ''").count() == 25
