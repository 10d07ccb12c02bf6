"""Quality classifier by co-training of two views.

One classifier sees the text, the other the page's metadata.  In every round
each labels the unlabelled documents it is surest of for the other; at the end
both are calibrated on held-out folds, combined, and score all documents.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.logistic import Logistic

_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_LANGS, _SOURCES = 8, 32


@dataclass(frozen=True)
class Settings:
    """``labelled`` and ``pool`` bound the documents (with a label, without one) on which the classifiers are fitted.

    Both are taken by the smallest hash of doc_id.  Per round, each view hands
    over at most ``handed`` documents of which its chance is beyond ``sure``.
    Documents with a combined chance below ``least`` are rejected.
    """

    labelled: int = 8_000
    pool: int = 8_000
    rounds: int = 3
    handed: int = 500
    sure: float = 0.97
    folds: int = 4
    least: float = 0.5


def text_features(text: str | None) -> list[float]:
    """Shape of a text: lengths, repetition, case, digits and signs.  A null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits, lines = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[10]
    again = sum(map(operator.eq, words, words[1:]))
    skipping = sum(map(operator.eq, words, words[2:]))
    distinct = len(set(words))
    rows = raw.split(b"\n")
    return [
        np.log1p(len(words)),
        np.log1p(len(raw) / n),
        distinct / n,
        np.log1p(distinct) / np.log1p(n),
        again / n,
        skipping / n,
        upper / max(upper + lower, 1),
        digits / size,
        counts[128:].sum() / size,
        np.log1p(1000 * lines / size),
        len(set(rows)) / len(rows),
        max(map(len, words), default=0) ** 0.5,
        *np.log1p(1000 * counts[_SIGNS] / size).tolist(),
    ]


def _slot(value: str | None, n: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (n - 1)


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Language and source hashed to slots (slot 0: null), and the stated length."""
    out = [0.0] * (_LANGS + _SOURCES + 2)
    out[_slot(lang, _LANGS)] = 1.0
    out[_LANGS + _slot(source, _SOURCES)] = 1.0
    known = n_chars is not None and n_chars == n_chars
    out[-2], out[-1] = float(not known), float(np.log1p(max(n_chars, 0))) if known else 0.0
    return out


class Model:
    """Two calibrated views and their combination; without labels of both kinds every document scores 1."""

    def __init__(self, text: Logistic | None, meta: Logistic | None, joint: Logistic | None, accuracy: float | None):
        self.text, self.meta, self.joint, self.accuracy = text, meta, joint, accuracy

    def chances(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.joint is None:
            one = np.ones(len(text))
            return one, one, one
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _sig(a), _sig(b), self.joint.chance(np.stack([a, b], axis=1))


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], s: Settings) -> list[Logistic]:
    """The two classifiers after all rounds of exchange."""
    given: list[dict[int, float]] = [{}, {}]
    models: list[Logistic] = []
    for turn in range(s.rounds + 1):
        models = []
        for v in (0, 1):
            rows = np.array(sorted(given[v]), dtype=np.int64)
            x = np.vstack([views[v], pool[v][rows]])
            models.append(Logistic.fit(x, np.concatenate([y, [given[v][r] for r in rows]])))
        if turn == s.rounds or not len(pool[0]):
            break
        for v in (0, 1):
            p = models[v].chance(pool[v])
            sure = np.flatnonzero((p > s.sure) | (p < 1 - s.sure))
            # The surest of each kind, in the proportion of the labels, for the other view.
            for label in (0.0, 1.0):
                own = sure[(p[sure] > 0.5) == bool(label)]
                share = int(s.handed * (y.mean() if label else 1 - y.mean()))
                for i in own[np.argsort(-np.abs(p[own] - 0.5), kind="stable")][:share].tolist():
                    given[1 - v].setdefault(i, label)
    return models


def train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, s: Settings = Settings()) -> Model:
    """``y``: 1 good, 0 bad; rows without a label are in the pools."""
    if len(y) < 2 * s.folds or len(set(y.tolist())) < 2:
        return Model(None, None, None, None)
    fold = np.arange(len(y)) % s.folds
    logits = np.zeros((len(y), 2))
    for f in range(s.folds):
        own = fold != f
        if len(set(y[own].tolist())) < 2:
            return Model(None, None, None, None)
        for v, m in enumerate(_cotrain((text[own], meta[own]), y[own], (pool_text, pool_meta), s)):
            logits[~own, v] = m.logit((text, meta)[v][~own])
    joint = Logistic.fit(logits, y)
    models = _cotrain((text, meta), y, (pool_text, pool_meta), s)
    return Model(models[0], models[1], joint, float(((joint.chance(logits) > 0.5) == y).mean()))


_META = ("lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars")]


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cols = [b.column(c).to_pylist() for c in ("text", *_META)]
    text = np.array([text_features(t) for t in cols[0]], dtype=np.float64).reshape(b.num_rows, -1)
    return text, np.array([meta_features(*m) for m in zip(*cols[1:])], dtype=np.float64).reshape(b.num_rows, -1)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on bounded samples of ``docs``; ``labels`` holds ``doc_id, quality``.

    A document with several labels takes their majority (ties: good); null
    labels and ids are left out.
    """
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("pick")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("pick"))
    first = lambda df, n: df.orderBy(F.xxhash64("pick"), "pick").limit(n)
    known = first(votes.join(ids, "pick", "left_semi"), settings.labelled)
    free = first(ids.join(votes, "pick", "left_anti").distinct(), settings.pool).withColumn("y", F.lit(None).cast("double"))
    picks = known.union(free)  # at most labelled + pool rows of 16 bytes: small on every executor
    rows = docs.select(F.col("doc_id").cast("long").alias("pick"), *_columns(docs)).join(F.broadcast(picks), "pick")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, meta = _features(b)
            both = np.hstack([text, meta]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("pick"), b.column("y"), pa.array(list(both), pa.list_(pa.float32()))], ["pick", "y", "x"])

    found = rows.mapInArrow(run, "pick long, y double, x array<float>").dropDuplicates(["pick"]).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["pick"]).encode()), r["pick"]))
    wide = len(text_features(None))
    x = np.array([r["x"] for r in found], dtype=np.float64).reshape(len(found), wide + len(meta_features(None, None, None)))
    y = np.array([np.nan if r["y"] is None else r["y"] for r in found])
    has = ~np.isnan(y)
    return train(x[has][:, :wide], x[has][:, wide:], y[has], x[~has][:, :wide], x[~has][:, wide:], settings)


def scorer(model: Model):
    """Column function ``(text, lang, source, n_chars) -> (p_text, p_meta, quality)``."""

    @F.pandas_udf("p_text double, p_meta double, quality double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in batches:
            a = np.array([text_features(t) for t in text], dtype=np.float64)
            b = np.array([meta_features(*m) for m in zip(lang, source, n_chars)], dtype=np.float64)
            yield pd.DataFrame(dict(zip(("p_text", "p_meta", "quality"), model.chances(a, b) if len(a) else ([], [], []))))

    return score


def score(docs: DataFrame, model: Model, into: str = "__drawlog_score") -> DataFrame:
    """``docs`` with a column of both views' chances and the combined one; a row for every row.

    Null text, lang, source and n_chars have features of their own; whole texts
    are read; repeated rows are scored one by one and alike; an empty table
    gives no row; further columns stay, one named as ``into`` is replaced.
    """
    return docs.withColumn(into, scorer(model)(*_columns(docs)))


def good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that the classifier rejects.

    Where the labels name fewer than two documents a fold, or a fold's rest has
    only one label, nothing is fitted and all rows stay.  A chance equal to
    ``least`` stays.  Nulls, repeated rows, empty tables and further columns as
    in :func:`score`; columns and their order stay.
    """
    name = "__drawlog_score"
    return score(docs, fit(docs, labels, settings), name).where(F.col(f"{name}.quality") >= settings.least).drop(name)
