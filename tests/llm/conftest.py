import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string, kind long, n string, k1 string, pid string, rank string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns that clash with the operators' own names."""

    def make(rows):
        full = [(i, t, "en", "src1", None if t is None else len(t), "u", "f", 1, "n", "k", "p", "r") for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


LONG = " ".join(f"word{i % 977} mail{i}@host.example.org" if i % 1000 == 0 else f"word{i % 977}" for i in range(120_000))

EDGE = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one"),
    (6, "Ünï çødé 😀 😀 mail a.b@c.de ip 10.0.0.1, 4111 1111 1111 1111 and +49 (30) 1234-5678"),
    (6, "Ünï çødé 😀 😀 mail a.b@c.de ip 10.0.0.1, 4111 1111 1111 1111 and +49 (30) 1234-5678"),
    (7, LONG),
    (8, "a@b.c.d@e.f x@y@z.w 1.2.3.4.5.6.7.8 999.1.1.1.2.3 0000255.1.1.1 +1 2 3 4 5 6 7 8 9 0 - (+2 34567890123456"),
    (None, "no name here at all"),
    (None, None),
    (9, "4000-0000-0000-0002 40000000000000020 1234567890123456789012 5105 1051 0510 5100"),
    (10, "@.+-%" * 2000),
    (11, "9" * 20_000),
    (12, "1." * 20_000),
]


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
