import random
from collections import Counter

import brute
from conftest import EDGE

from drawlog.llm import pii

BASE_COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def found(df):
    return pii.digests(pii.find_pii(df)).collect()


def test_edges_equal_plain_reading(edge_docs, no_docs):
    got = Counter((r.doc_id, *(r[c] for c in BASE_COLUMNS)) for r in found(edge_docs))
    want = Counter((i, *(x for part in brute.pii_row(t) for x in (part if isinstance(part, tuple) else (part,)))) for i, t in EDGE)
    assert got == want
    assert found(no_docs) == []


def test_random_texts_equal_plain_reading(make_docs):
    rng = random.Random(3)
    parts = ["4111", "1111", "42", " ", "-", ".", "@", "a", "b.c", "+1", "(2)", "255", "256", "é", "\n", "00", "7" * 5]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = {r.doc_id: tuple(r[c] for c in BASE_COLUMNS) for r in found(make_docs(list(enumerate(texts))))}
    for i, t in enumerate(texts):
        counts, digest = brute.pii_row(t)[:4], brute.pii_row(t)[4]
        assert got[i] == (*counts, digest), t


def test_added_kinds_need_checksum_or_context(make_docs):
    rows = [(1, "pay to IBAN DE89 3704 0044 0532 0130 00 now"), (2, "pay to DE89 3704 0044 0532 0130 01 now"), (3, "my SSN is 219-09-9999."), (4, "part 219-09-9999 of the plan"), (5, "GB82WEST12345698765432")]
    spans = {r.doc_id: r.spans for r in found(make_docs(rows))}
    assert spans == {1: "iban:12:39", 2: "", 3: "ssn:10:21", 4: "", 5: "iban:0:22"}


def test_many_matches_have_right_places(make_docs):
    text = " ".join(f"u{i}@h.io" for i in range(3000))
    (r,) = pii.find_pii(make_docs([(1, text)])).collect()
    assert [(s["start"], s["end"]) for s in r.spans] == [(a, b) for a, _, _, b in brute.base_spans(text)]


def test_no_python_in_the_plan(edge_docs):
    plan = pii.digests(pii.find_pii(edge_docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapIn"))
