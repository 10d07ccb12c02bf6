import random

import brute
import numpy as np
from conftest import EDGE
from pyspark.sql import functions as F

from drawlog.llm import decontaminate


def rows_of(docs, items):
    found = decontaminate.contamination(docs, items)
    return {r.doc_id: tuple(r)[1:] for r in found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.array_join("items", ",").alias("ids")).collect()}


def plain(docs, items):
    return {d: (n, hit, k) for d, (n, hit, k, _, _) in brute.contamination_rows(docs, items).items()}


def test_random_texts_equal_plain_reading(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["Ä", "é1"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([25, 12, 10, 9, 5, 3, 2, 0])] + [(50, None), (51, "zz " * 30)]
    docs = []
    for i in range(150):
        own = text(rng.randrange(40))
        if i % 3 == 0:
            src = rng.choice(items[:4])[1].split(" ")
            at = rng.randrange(max(len(src) - 9, 1))
            own = own + " " + " ".join(src[at : at + rng.randrange(8, 14)]).upper() + " " + text(5)
        docs.append((i, own))
    docs += [(900, "zz " * 500), (901, None), (902, "")]
    got = rows_of(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {d: r[:3] for d, r in got.items()} == plain(docs, items)
    assert got[900][3] == "51"


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "Word0 word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (2, "one"), (None, "no name here at all")], "item_id long, text string")
    found = decontaminate.contamination(edge_docs, items).collect()
    assert len(found) == len(EDGE)
    hit = {(r.doc_id, r.n_hit > 0, tuple(r["items"])) for r in found}
    assert {(4, True, ("2",)), (5, True, ("2",)), (None, True, ()), (1, False, ())} <= hit
    assert [r["items"] for r in found if r.doc_id == 7] == [["1"]]
    assert decontaminate.contamination(no_docs, items).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.contamination(edge_docs, items.limit(0)).collect())
    kept = decontaminate.clean(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert kept.count() == len(EDGE) - 4


def test_blocks_of_a_long_text_join_up(monkeypatch, spark, make_docs):
    text = " ".join(f"x{i % 7}y{i % 11}" for i in range(400))
    docs, items = [(1, text)], [(1, text[600:900])]
    monkeypatch.setattr(decontaminate, "_STEP", 16)
    ws = decontaminate.words(text)
    kept = list(decontaminate._kept(ws, decontaminate.WordHashes(), 10, 5))
    whole = decontaminate.grams(np.array([decontaminate.WordHashes()[w] for w in ws], dtype=np.uint64), 5)
    assert [p for p, _ in kept] == decontaminate.winnow(whole, 6).tolist()
    got = rows_of(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got[1][:3] == plain(docs, items)[1]
