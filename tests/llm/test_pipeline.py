"""The corpus pipeline on odd input, and what each stage does to planted cases."""

import random

import pytest

import corpus_pipeline


def prose(rng, n):
    return " ".join(rng.choice("the of and to in a house river stone walked bright morning under light water".split()) + rng.choice(["", "", ",", "."]) + (f"x{rng.randrange(500)}" if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200)) for i in range(60)]
    copy, passage = rows[5][1], prose(rng, 60)
    near = copy.split()
    near[50] = "changed"
    rows += [(100, copy), (101, " ".join(near)), (102, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"), (103, f"{prose(rng, 90)} {passage} {prose(rng, 70)}")]
    rows += [(200, None), (201, ""), (202, "too short"), (203, "spam now " * 90), (None, prose(rng, 150))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string")


def test_stages(spark, docs, tmp_path):
    at, columns = docs, docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at.write.parquet(f"{tmp_path}/{k}")
        at = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), str(tmp_path))
        if k < 4:
            assert at.columns == columns
        seen[name] = at.collect()
    ids = lambda name: {r.doc_id for r in seen[name]}
    every = {*range(60), 100, 101, 102, 103, None}
    assert ids("quality rules") == every
    assert ids("language ID") == every
    near = ids("near duplicates")
    assert len(near & {5, 100, 101}) == 1
    assert near | {5, 100, 101} == every
    before, after = ({r.doc_id: r.text for r in seen[n]} for n in ("near duplicates", "repeated passages"))
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {103}
    assert len(before[103].split()) - len(after[103].split()) >= 60
    assert {r.doc_id for r in seen["packing"]} == near
    assert all(r.spans == "extra" for r in seen["repeated passages"])


def test_empty_corpus(spark, docs, tmp_path):
    at = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at.write.parquet(f"{tmp_path}/{k}")
        at = stage(spark, spark.read.schema(at.schema).parquet(f"{tmp_path}/{k}"), str(tmp_path))
    assert at.count() == 0
