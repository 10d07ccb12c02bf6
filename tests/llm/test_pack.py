import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import EDGE

from drawlog.llm import pack

EDGES = [x for x in EDGE if x[0] != 11] + [(20, "<|endoftext|> and more<|endoftext|>"), (21, " " * 3000), (22, "it's I'LL we'd\r\n\t  x")]


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def check(rows, docs, capacity=2048):
    want = Counter()
    for d, t in docs:
        ids = ids_of(t)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((d, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_edges(make_docs, no_docs):
    rows = pack.pack(make_docs(EDGES)).collect()
    check(rows, EDGES)
    assert pack.pack(no_docs).collect() == []


def test_whole_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack.pack(docs).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n == -(-sum(r.length for r in rows) // 2048)


def test_kept_ids(make_docs):
    docs = [(1, "some words to read"), (2, None)]
    for r in pack.pack(make_docs(docs), keep_ids=True).collect():
        assert r.ids == ids_of(dict(docs)[r.doc_id]).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 400) for _ in range(40)}
    plan = pack.best_fit(counts, 64)
    used = defaultdict(list)
    ranks = defaultdict(set)
    for length, low, high, seq, per, at in plan:
        for r in range(low, high):
            assert r not in ranks[length]
            ranks[length].add(r)
            used[seq + (r - low) // per].append((at + length * ((r - low) % per), length))
    assert {k: len(v) for k, v in ranks.items()} == counts
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    # Not worse than best fit decreasing one piece at a time.
    free = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(64 - length)
    assert len(used) == len(free)
