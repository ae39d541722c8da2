"""The stages in a row, as the driver runs them, against plain Python; and the SQL of the queries that have it."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pixelmill.llm import queries as Q
from pixelmill.llm import tokens
from pixelmill.llm.common import JSON_VOCAB

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = db.execute(Q.oracle_sql()[name]).fetch_df()
    got = Q.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].itertuples(index=False))) == sorted(map(tuple, want[columns].itertuples(index=False)))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    texts = {r.doc_id: r for r in before.collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values())
    enc = tokens.Encoder(JSON_VOCAB)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(texts)
    for r in pieces:
        ids = enc.encode([texts[r.doc_id].text])[0] + np.array([0], "<u4").tobytes()
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens == len(ids) // 4
