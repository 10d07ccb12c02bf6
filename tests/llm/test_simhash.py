import random

import brute
import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from drawlog.llm import copies, simhash
from drawlog.llm.components import components
from drawlog.llm.scratch import Scratch


def rows_of(df):
    return simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()


def test_edges_equal_plain_reading(edge_docs, no_docs):
    got = rows_of(edge_docs)
    assert len(got) == len(EDGE)
    want = brute.simhash_components([(i, t) for i, t in EDGE if i is not None])
    assert {r.doc_id: (r.f, r.component_id) for r in got if r.doc_id is not None} == want
    assert {r.component_id for r in got if r.doc_id is None and r.f == "0" * 16} == {1}
    assert rows_of(no_docs) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.simhash_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.f, r.component_id) for r in rows_of(docs)} == want


@pytest.mark.parametrize("dense", [2, 1000])
def test_links_connect_exactly_the_near_fingerprints(spark, dense):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    scratch = Scratch(spark, "test")
    got = {r.u & (2**64 - 1): r.root for r in components(simhash.near_links(df, scratch, dense), scratch).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                parent[find(x)] = find(y)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(x for x in got if got[x] == r) for r in set(got.values())}


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components(edges, Scratch(spark, "test")).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


def test_representatives(make_docs):
    docs = make_docs([(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "other words stand in here"), (None, "a b c d e")])
    kept = copies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a b c d e"), (3, "a b c d e"), (9, "other words stand in here")]


def test_similar_documents_join_at_four_fifths(make_docs):
    """A group of near copies, some only linked to each other, against all pairs; dense bands and small ones."""
    rng = random.Random(12)
    docs = []
    for g in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 90, 200]))]
        for _ in range(60 if g < 2 else 3):
            ws = list(base)
            for at in rng.sample(range(len(ws)), rng.randrange(len(ws) // 40 + 2)):
                ws[at] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(ws)))
        docs += [(len(docs), " ".join(base))]
        docs += [(len(docs), " ".join(base).upper())]
    docs += [(len(docs), "a b"), (len(docs) + 1, "A B"), (len(docs) + 2, "a b c d e f")]
    groups = brute.similar_components(docs)
    got = {r.doc_id: r.component_id for r in copies.similar_documents(make_docs(docs)).collect()}
    assert got == groups


def test_one_id_with_two_texts(make_docs):
    """Texts that share a doc_id but are no near copies both stay; a near copy under the same id does not."""
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(60))
    docs = make_docs([(1, a), (1, b), (1, a), (2, a), (3, b), (4, a + " more"), (4, a), (5, None), (5, None), (None, "x")])
    kept = copies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (5, ""), (0, "x")])
