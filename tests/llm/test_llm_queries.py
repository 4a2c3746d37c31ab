"""The queries with SQL against DuckDB, and the pipeline's contract."""
import duckdb
import pytest

import corpus_pipeline
from winnowry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=repr)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr) == expected


def test_pipeline(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(spark, lambda stage=stage, docs=docs: stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0.5 * n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
