"""The registered queries and the pipeline on the smallest tables."""

import pytest
from oracle import TABLES, database, rows_of

import corpus_pipeline
from cellwise.llm.queries import ORACLES, QUERIES
from cellwise.session import read_table


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, TABLES).toPandas()
    if name in ORACLES:
        assert rows_of(found) == rows_of(db.sql(ORACLES[name]).df())
    else:
        assert len(found)


def test_stages_hand_on_documents(spark):
    docs = read_table(spark, TABLES, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, TABLES)
        assert after.schema.names == docs.schema.names
        docs = spark.createDataFrame(after.collect(), docs.schema)
        assert docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).collect()
    assert {r.doc_id for r in packed} == set(text)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, TABLES).collect()) == sorted(r.doc_id for r in packed)


def test_stages_on_an_empty_table_and_odd_rows(spark):
    docs = read_table(spark, TABLES, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), TABLES).count() == 0
        stage(spark, odd, TABLES).collect()
