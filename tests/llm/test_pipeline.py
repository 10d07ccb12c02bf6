"""The corpus pipeline: what each stage keeps, and the packed result."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from drawlog.llm.scratch import Scratch, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, scratch = table(spark, SF, "documents"), Scratch(spark, "test")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, SF))
        steps[name] = (before, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name in ("quality", "near_duplicates", "decontamination", "secrets"):
        assert steps[name][1].columns == steps[name][0].columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = {n: {r.doc_id: r for r in d.collect()} for n, (_, d) in steps.items() if n != "packing"}
    first = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    assert all(d in rows["quality"] for d in first if labels.get(d) == 1)
    assert sum(d in rows["quality"] for d in first if labels.get(d) == 0) <= 3
    groups = brute.similar_components([(d, r.text) for d, r in rows["quality"].items()])
    assert set(rows["near_duplicates"]) == set(groups.values())
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {d for d, r in brute.contamination_rows([(d, r.text) for d, r in rows["near_duplicates"].items()], items).items() if r[4]}
    assert bad and set(rows["decontamination"]) == set(rows["near_duplicates"]) - bad
    assert set(rows["secrets"]) == set(rows["decontamination"])
    changed = [d for d, r in rows["secrets"].items() if r.text != rows["decontamination"][d].text]
    assert all("<secret>" in rows["secrets"][d].text and rows["secrets"][d].n_chars == len(rows["secrets"][d].text) for d in changed)
    packed = steps["packing"][1]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows["secrets"])
    whole = corpus_pipeline.run(spark, SF)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(same).collect())) == sorted(map(tuple, packed.select(same).collect()))
    assert whole.select(F.countDistinct("sequence_id")).first()[0] == packed.select(F.countDistinct("sequence_id")).first()[0]
