import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from drawlog.llm import align, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters():
    """The usual byte-level alphabet: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(c): b for b, c in [*zip(own, own), *zip(rest, range(256, 512))]}


class Plain:
    """Both tokenizers as the contract names them, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.letters = byte_letters()

    def groups(self, text):
        if not text:
            return []
        whole = (" " + text).encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return []
        out, left, right, na, nb = [], [], [], 0, 0
        while a or b:
            if na <= nb:
                i, x = a.pop(0)
                left.append(i)
                na += len(x)
            else:
                i, x = b.pop(0)
                right.append(i)
                nb += len(x)
            if na == nb:
                out.append((left, right))
                left, right = [], []
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, rows):
    cut = [(i, plain.groups(t)) for i, t in rows]
    held, links = Counter(), []
    for _, groups in cut:
        mine = Counter((x, y) for left, right in groups for x in left for y in right)
        links.append(mine)
        held.update(mine.keys())
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, groups), mine in zip(cut, links):
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(mine.values()), sum(n for p, n in mine.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in mine.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return Counter(out)


def got(df):
    assert [(c, k) for c, k in df.dtypes] == [(c, "string" if c == "groups_sha256" else "bigint") for c in COLUMNS]
    return Counter(tuple(r) for r in df.collect())


ODD = [
    "<|endoftext|> and </s> <unk> <0x41> <s>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "zwei  Leerzeichen\n\nZeile\tTab ",
    " vorn",
    "naïve façade 東京 😀 ▁ x",
    "👩‍👩‍👧‍👦🇩🇪 漢字かな交じり文",
    " 　ﬁ Å",
    "x\x00y",
    "=" * 700 + "-" * 333,
    "the cat the dog",
    "the cat the dog",
]


@pytest.mark.parametrize("settings", [align.Settings(), align.Settings(chunk=3, held=50, links=4), align.Settings(chunk=40, held=20)])
def test_equals_token_by_token(spark, make_docs, plain, settings):
    rows = list(enumerate(ODD)) + [(100, None), (101, ""), (None, "no name the cat"), (9, "the cat the dog"), (9, "the cat the dog")]
    assert got(align.align(make_docs(rows), settings)) == expected(plain, rows)


def test_edges(spark, no_docs, edge_docs, plain):
    assert got(align.align(no_docs)) == Counter()
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if t is None or len(t) < 50_000]
    found = got(align.align(edge_docs))
    assert sum(found.values()) == len(rows)
    assert {r[0]: r[7] for r in found if r[0] in (3, 4, 6, 8, 9)} == {r[0]: r[7] for r in expected(plain, short) if r[0] in (3, 4, 6, 8, 9)}


def test_bitmaps():
    rng = np.random.default_rng(1)
    for chunk in (8, 100, 1 << 13):
        for n in {1, 2, chunk // 20 + 1, chunk // 2, chunk}:
            docs = np.sort(rng.permutation(chunk)[:n])
            times = rng.integers(1, 1 << rng.integers(1, 20), n)
            assert (align.unpack_docs(align.pack_docs(docs, chunk), chunk) == docs).all()
            assert (align.unpack_planes(align.pack_planes(times), n) == times).all()


def test_pairs_of_the_corpus(spark, make_docs, plain):
    rows = list(enumerate(ODD))
    held, links = Counter(), Counter()
    for _, t in rows:
        mine = Counter((x, y) for left, right in plain.groups(t) for x in left for y in right)
        held.update(mine.keys())
        links.update(mine)
    found = {(r.a, r.b): (r["count"], r.links) for r in align.alignments(make_docs(rows), align.Settings(chunk=4)).collect()}
    assert found == {p: (n, links[p]) for p, n in held.items()}


def test_whole_table(spark, plain):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op11_alignment"](spark, at)) == expected(plain, rows)
