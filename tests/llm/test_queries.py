"""Queries that SQL can express against DuckDB, and the digests' contracts."""

import pytest
from conftest import DATA
from oracle import assert_same

from quillspark.llm.oracles import ORACLES
from quillspark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), DATA, ORACLES[name])


@pytest.mark.parametrize("name, label, threshold", [("op1_quality", "quality", 0.5), ("op6_toxicity", "toxic", 0.3)])
def test_held_out_accuracy(spark, name, label, threshold):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted == 1 for r in rows if r[label] == 1) >= 0.9 * sum(r[label] == 1 for r in rows)
