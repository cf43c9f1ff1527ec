"""The pipeline against its stages, and every registered query on small data."""

import pytest

import corpus_pipeline
from check import compare, database
from veilmark.llm.catalog import ORACLES, QUERIES
from veilmark.llm.common import read, stored


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, sf_dir))
        assert after.columns == columns, name
        ids = before.select("doc_id")
        assert after.select("doc_id").subtract(ids).count() == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.filter("piece = 0").count() == before.count()
    assert before.filter("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(database(sf_dir), QUERIES[name](spark, sf_dir).toArrow(), ORACLES[name]) == ""
