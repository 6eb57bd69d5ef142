"""The pipeline's stages, each judged on what the one before it kept."""

import re

import pytest

import corpus_pipeline
from premia.llm import host_rules, weak_labels

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    return set(zip(*(w[i:] for i in range(5)))) if len(w) > 4 else {tuple(w)} if w else set()


def near(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = [r.asDict() for r in docs.collect()]
        out.append(rows)
        docs = docs if stage is corpus_pipeline.STAGES[-1][1] else spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    return out


def test_quality_keeps_what_the_scorer_keeps(spark, stages):
    scored = weak_labels.score_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r["doc_id"] for r in stages[0]) == sorted(r["id"] for r in scored.where("kept").collect())
    assert 0 < len(stages[0]) < 200


def test_rules_reject_what_fails_them(spark, stages):
    judged = host_rules.judge_documents(spark.createDataFrame(stages[0], spark.read.parquet(f"{SF}/documents.parquet").schema))
    kept = {r["id"] for r in judged.collect() if r["verdict"]["kept"]}
    assert {r["doc_id"] for r in stages[1]} == kept


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))
    for _ in before:
        changed = False
        for i in range(len(before)):
            for j in range(i):
                if root[i] != root[j] and near(sets[i], sets[j]):
                    low, high = sorted((root[i], root[j]))
                    root = [low if x == high else x for x in root]
                    changed = True
        if not changed:
            break
    want = {min(before[i]["doc_id"] for i in range(len(before)) if root[i] == g) for g in set(root)}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)


def test_every_document_is_packed(spark, stages):
    assert {r["doc_id"] for r in stages[3]} == {r["doc_id"] for r in stages[2] if (r["text"] or "").split()}
