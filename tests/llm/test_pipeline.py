"""The pipeline's stages on small tables, each against what its input allows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from data import LICENSE
from test_dedup import fingerprint, roots
from test_models import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = labelled(400)
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, t.upper(), "en", "s1", len(t)) for i, t, _ in rows[:30]]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s9", 0), (2002, LICENSE, "en", None, 5), (2002, LICENSE, "en", None, 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int").write.parquet(os.path.join(path, "labels.parquet"))
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {i: y for i, _, y in labelled(400)}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, results[-1], folder)
        out.write.parquet(f"{folder}/{name}")
        results.append(spark.read.parquet(f"{folder}/{name}"))
        if name != "packing":
            assert results[-1].columns == docs.columns
    clean, single, apart, mixed, packed = (r.collect() for r in results[1:])
    ids = {r.doc_id for r in clean}
    assert sum(i in ids for i, y in truth.items() if y) <= 5 and sum(i not in ids for i, y in truth.items() if not y) <= 5
    assert {2000, 2001, 2002} <= ids
    lowered = {(r.text or "").lower() for r in clean}
    assert len(single) == len(lowered) and {(r.text or "").lower() for r in single} == lowered
    assert len(apart) == len(set(roots([fingerprint(r.text) for r in single], 4)))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in apart}
    assert all(sum(m.doc_id == r.doc_id for m in mixed) <= 2 for r in apart)
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in mixed)


def test_run_and_an_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").filter("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
