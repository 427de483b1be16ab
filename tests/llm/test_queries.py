import os

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, as_bag
from tests.llm import brute
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.session import configure


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](configure(spark), sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert as_bag(df.columns, df.collect()) == as_bag(columns, cursor.fetchall())


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage against a plain version of it, on what the stage before it kept."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text, r.source) for r in before.select("doc_id", "text", "source").collect()]
        if name != "encode":
            assert docs.columns == before.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(os.path.join(sf_dir, "labels.parquet")).collect()}
    good = {i for i, _, _ in kept["exact_dedup"]}
    assert len([i for i, q in labels.items() if q == 1 and i not in good]) <= 0.05 * len(labels)
    last = {}
    for i, t, _ in kept["exact_dedup"]:
        key = (t or "").translate(brute.LOWER)
        last[key] = max(i, last.get(key, -1))
    assert sorted(i for i, _, _ in kept["near_dedup"]) == sorted(last.values())
    groups = brute.jaccard_components([(i, t) for i, t, _ in kept["near_dedup"]])
    assert sorted(i for i, _, _ in kept["mix"]) == sorted(i for i in groups if groups[i] == i)
    assert {i for i, _, _ in kept["encode"]} <= {i for i, _, _ in kept["mix"]}
    assert docs.count() == len(kept["encode"])
