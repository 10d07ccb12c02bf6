import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import EDGE

from drawlog.llm import repeats


def rows_of(df, settings=repeats.Settings()):
    return Counter(tuple(r) for r in repeats.repeated_paragraphs(df, settings).collect())


def test_whole_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(docs) == Counter(brute.repeated_paragraphs(rows))


@pytest.mark.parametrize("dense", [1, 1000])
def test_variants_of_one_passage(make_docs, dense):
    """Many near copies under one band: blocks and pairs give the same classes as all pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = []
    for i in range(120):
        ws = list(base)
        for at in rng.sample(range(80), rng.randrange(4)):
            ws[at] = f"x{rng.randrange(10**6)}"
        own = " ".join(f"own{rng.randrange(10**6)}" for _ in range(60))
        docs.append((i, "\n".join([own, " ".join(ws), "short line"])))
    settings = repeats.Settings(dense=dense, block=16, bands=24)
    assert rows_of(make_docs(docs), settings) == Counter(brute.repeated_paragraphs(docs))


def test_edges(edge_docs, no_docs, make_docs):
    got = rows_of(edge_docs)
    assert set(got) == set()  # repeated rows hold under 50 words each
    assert rows_of(no_docs) == Counter()
    passage = " ".join(f"p{i}" for i in range(51))
    docs = [(4, f"a b c d e f\n{passage}"), (2, passage.upper()), (None, passage), (9, " ".join(passage.split()[:40])), (9, "lone words stand here alone now")]
    got = rows_of(make_docs(docs))
    assert {(r[0], r[4], r[6]) for r in got} == {(4, 2, True), (2, 2, False), (None, 2, True)}
    out = {r.doc_id: r.text for r in repeats.without_repeats(make_docs([d for d in docs if d[0] in (2, 4)])).collect()}
    assert out == {4: "a b c d e f\n", 2: passage.upper()}


def test_forest_spans_its_links():
    sets = [np.arange(0, 50), np.arange(2, 52), np.arange(100, 150), np.arange(101, 151), np.arange(4, 54)]
    offsets = np.cumsum([0, *map(len, sets)])
    u, v = repeats.forest(np.arange(5), np.ones(5, dtype=bool), offsets, np.concatenate(sets), 0.8)
    assert sorted(zip(u, v)) == [(0, 1), (0, 4), (2, 3)]


def places(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def shared_words(docs, passage=50):
    """(row, word) of every word in a window of ``passage`` words that another row has as well."""
    seen, own = {}, [brute.item_words(t) for _, t in docs]
    for uid, ws in enumerate(own):
        for i in range(len(ws) - passage + 1):
            seen.setdefault(tuple(ws[i : i + passage]), set()).add(uid)
    return {(uid, i + j) for uid, ws in enumerate(own) for i in range(len(ws) - passage + 1) if len(seen[tuple(ws[i : i + passage])]) > 1 for j in range(passage)}


def covered_words(docs, found):
    spans = {}
    for r in found:
        spans.setdefault(r[0], []).append((r[1], r[2]))
    return {(uid, n) for uid, (d, t) in enumerate(docs) for n, (a, b) in enumerate(places(t)) if any(x <= a and b <= y for x, y in spans.get(d, ()))}


def test_passages_off_the_lines(make_docs):
    rng = random.Random(3)
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    p = [f"é{i}" for i in range(60)]
    inside = " ".join(p)
    short = "\n".join(" ".join(p[i : i + 3]) for i in range(0, 60, 3))
    docs = [(1, f"{own(30)} {inside} {own(30)}"), (2, f"{own(9)}\n{own(7)} {inside[:150]}\n{inside[150:]} {own(8)}"), (3, f"{own(20)}\n{short}\n{own(5)}"), (4, f"{own(40)} {' '.join(p[:49])} {own(40)}"), (None, f"{own(3)} {' '.join(p[5:55])} x"), (6, None)]
    got = list(map(tuple, repeats.repeated_passages(make_docs(docs)).collect()))
    assert covered_words(docs, got) == shared_words(docs)
    assert {(r[0], r[3], r[4], r[6]) for r in got} == {(1, 60, 1, False), (2, 60, 1, True), (3, 60, 1, True), (None, 50, 1, True)}
    named = [d for d in docs if d[0]]
    out = {r.doc_id: r.text for r in repeats.without_repeats(make_docs(named)).collect()}
    assert out[1] == docs[0][1] and out[4] == docs[3][1] and "é" not in out[2] + out[3]
    assert len(brute.item_words(out[2])) == 24 and len(brute.item_words(out[3])) == 25


def test_all_shared_words_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert len({d for d, _ in rows}) == len(rows)
    got = list(map(tuple, repeats.repeated_passages(docs).collect()))
    lines = list(brute.repeated_paragraphs(rows))
    want = shared_words(rows)
    assert want - covered_words(rows, lines)  # what lines leave out
    assert want <= covered_words(rows, got)
    assert covered_words(rows, got) == want | covered_words(rows, lines)
