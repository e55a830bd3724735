"""The pipeline on planted cases, and the queries over the tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries, tokens

from . import brute
from .test_operators import SCHEMA, passage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    texts = [passage(r, 80).capitalize() + "." for _ in range(120)]
    texts += [" ".join(f"{w.upper()}!!" for w in passage(r, 60).split()) for _ in range(60)]
    item = passage(r, 30)
    texts += [texts[0], texts[1][:-30] + "changed", item + " " + passage(r, 40), passage(r, 50) + " write to a.b@mail.example.com now", None, "", texts[2]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).withColumn("k1", F.lit("kept")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages(spark, tables):
    folder, texts = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        docs = spark.createDataFrame(docs.collect(), before.schema)
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(set(range(120)) & set(left["quality"])) >= 118 and len(set(range(120, 180)) & set(left["quality"])) <= 2
    want = {i for i, (_, root) in brute.near_duplicates({i: texts[i] for i in left["quality"]}, 5).items() if i == root}
    assert set(left["near_duplicates"]) == want and not {180, 186} & want
    leaks = brute.contamination({i: texts[i] for i in want}, [(7, texts[182].split(".")[0])])
    assert 182 not in left["decontamination"] and set(left["decontamination"]) <= {i for i in want if i != 182} and len(leaks) == len(want)
    assert set(left["personal_data"]) == set(left["decontamination"])
    if 183 in left["personal_data"]:
        assert left["personal_data"][183].endswith("write to <EMAIL> now")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    ids = tokens.WordTokenizer(queries.vocabulary()).encode([t or "" for t in left["personal_data"].values()])
    assert packed.agg(F.sum("length")).first()[0] == sum(len(np.frombuffer(b, "<u2")) + 1 for b in ids)


def test_run_equals_the_stages(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= set(names)
