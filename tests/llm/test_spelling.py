import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from drawlog.llm import queries, spelling

LOW = {i: i + 32 for i in range(65, 91)}


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    """All pairs that share a word with one letter left out, each then compared in full."""
    by_part = {}
    for w in words:
        for part in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_part.setdefault(part, []).append(w)
    met = {w: set() for w in words}
    for group in by_part.values():
        for a in group:
            met[a] |= {b for b in group if b not in met[a] and near(a, b)}
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(met[w]), words.get(form[w])))
    return out


def got(df):
    assert [(c, k) for c, k in df.dtypes] == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_words(rng, many, letters, longest):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))): rng.choice([3, 4, 6, 8, 16, 40]) for _ in range(many)}


@pytest.mark.parametrize("shard", [20, 1 << 14])
def test_random_words_equal_all_pairs(spark, shard):
    rng = random.Random(shard)
    words = random_words(rng, 500, "abé", 8) | random_words(rng, 100, "abcdefghÿ", 6) | {"a" * 40: 5, "a" * 41: 9, "a" * 20 + "b" + "a" * 20: 3}
    df = spark.createDataFrame([(w, n, "k") for w, n in words.items()], "word string, n long, key string")
    assert got(spelling.variants(df, spelling.Settings(shard=shard, queries=64))) == plain_variants(words)


def test_one_index_against_all_pairs():
    rng = random.Random(3)
    words = sorted(random_words(rng, 300, "abc", 7))
    index = spelling.Index(words)
    every = np.arange(len(words))
    assert [words[i] for i in every] == ["".join(map(chr, index.points[index.codes[b : b + n]])) for b, n in zip(index.begin, index.length)]
    zero = np.zeros(len(words), dtype=np.int64)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
    for rightward in (True, False):
        assert set(zip(*map(np.ndarray.tolist, index.search(every, zero, zero, rightward)))) == want
    half = index.length // 2
    first = set(zip(*map(np.ndarray.tolist, index.search(every, half, zero, True))))
    second = set(zip(*map(np.ndarray.tolist, index.search(every, zero, half, False))))
    assert first == {(i, j) for i, j in want if words[i][: half[i]] == words[j][: half[i]] and near(words[i][half[i] :], words[j][half[i] :])}
    assert second <= want and first | second < want | {None}


def test_documents(spark, make_docs):
    rng = random.Random(5)
    stems = ["colour", "Behaviour", "têteÀ", "straightforward", "xx", "rôles", "×÷abc"]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(80)) + " 12colour_color-COLOR") for i in range(40)]
    rows += [(7, "color color color"), (None, "colour behavior " * 5), (None, None), (1, None), (2, ""), (3, "z" * 3_000), (4, "z" * 3_000), (5, "z" * 3_000), (5, "z" * 3_000)]
    rows += [rows[0], rows[0]]
    assert got(spelling.spelling_variants(make_docs(rows))) == plain_variants(plain_words(rows))


def test_edges(spark, make_docs, no_docs, edge_docs):
    assert got(spelling.spelling_variants(no_docs)) == set()
    assert got(spelling.spelling_variants(make_docs([(None, None), (1, "")]))) == set()
    assert got(spelling.spelling_variants(edge_docs))
    odd = spark.createDataFrame([("hello", 2), ("hello", 2), ("hallo", 9), (None, 5), ("abc", 9), ("he\x01llo", 9)], "word string, n long")
    assert got(spelling.variants(odd)) == {("hello", "hallo", "hallo", 4, 1, 9), ("hallo", None, "hallo", 9, 1, None)}


def test_whole_table(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op13_spelling"](spark, at)) == plain_variants(plain_words(rows))
