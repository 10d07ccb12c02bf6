"""Secrets in text: patterns propose candidates, a random forest removes the false ones.

The forest sees a candidate's length, its character transitions, how much of
it ordinary words could spell, the path it stands in and its neighbouring
words.  It is trained from labelled findings.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.logistic import Forest
from drawlog.llm.scratch import Scratch

#: Candidates: key blocks, values assigned to a telling name, and long tokens.
_CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
    r"|(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)(?P<value>[^\s\"'<>,;]{6,})"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
)
#: Formats whose issuers state them: findings of these are labelled as secrets.
_STATED = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN .*)$", re.S)
_NAMES = re.compile(r"(?i)(password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|bearer|authorization)")
_CLASSES = np.array([0] * 48 + [1] * 10 + [0] * 7 + [2] * 26 + [0] * 6 + [3] * 26 + [0] * 133)
_WINDOW = 24


@dataclass(frozen=True)
class Settings:
    """``labelled`` bounds the findings on which the forest is fitted (smallest hashes, half of each kind); ``least`` is the chance from which a candidate counts as a secret."""

    labelled: int = 8_000
    trees: int = 30
    depth: int = 8
    least: float = 0.5


def candidates(text: str | None) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, value, text before, text after), leftmost first and not overlapping."""
    if not text:
        return
    for m in _CANDIDATE.finditer(text):
        start, end = m.span("value") if m.group("value") else m.span()
        yield start, end, text[start:end], text[max(start - _WINDOW, 0) : start], text[end : end + _WINDOW]


def rule_label(value: str, before: str) -> float | None:
    """Label of a finding whose kind is beyond doubt: a stated format is a secret, letters of one case without an assignment are not."""
    if _STATED.match(value):
        return 1.0
    core = value.strip("-_+/=")
    if _NAMES.search(before) and re.search("[0-9]", core) and len(set(core)) >= 6:
        return 1.0
    letters = re.sub(r"[^A-Za-z]", "", core)
    if not re.search("[0-9]", core) and len(letters) >= 0.8 * len(core) and (letters[1:].islower() or letters.isupper()) and not _NAMES.search(before):
        return 0.0
    return None


class Spelling:
    """Counts of neighbouring letters over all documents: how words of the corpus are spelt."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray):
        pairs = pairs.reshape(27, 27) + 0.5
        self.step = np.log(pairs / pairs.sum(axis=1, keepdims=True))
        order = np.sort(triples)[::-1]
        enough = int(np.searchsorted(order.cumsum(), 0.98 * order.sum())) if order.sum() else 0
        # The triples that make up nearly all of the corpus are its dictionary.
        self.usual = triples >= max(order[min(enough, len(order) - 1)], 1)


def letters_of(raw: bytes) -> np.ndarray:
    """Letters as 1 to 26, everything else as 0."""
    b = np.frombuffer(raw, dtype=np.uint8) | 0x20
    return np.where((b >= 97) & (b <= 122), b - 96, 0).astype(np.int64)


def triple_codes(letters: np.ndarray) -> np.ndarray:
    return (letters[:-2] * 27 + letters[1:-1]) * 27 + letters[2:] if len(letters) > 2 else np.zeros(0, dtype=np.int64)


def features(value: str, before: str, after: str, source: str | None, spelling: Spelling) -> list[float]:
    raw = value.encode("utf-8", "surrogatepass")
    kinds = _CLASSES[np.frombuffer(raw, dtype=np.uint8)]
    n = len(raw)
    share = np.bincount(kinds, minlength=4) / n
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8))
    p = counts[counts > 0] / n
    letters = letters_of(raw)
    steps = spelling.step[letters[:-1], letters[1:]] if n > 1 else np.zeros(1)
    codes = triple_codes(letters)
    inner = codes[(letters[:-2] > 0) & (letters[1:-1] > 0) & (letters[2:] > 0)] if len(codes) else codes
    spelt = float(spelling.usual[inner].sum()) / max(n - 2, 1)
    return [
        math.log(n),
        *share.tolist(),
        float(-(p * np.log2(p)).sum()),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(steps.mean()),
        float(steps.min()),
        spelt,
        float(len(counts[counts > 0])) / n,
        # Path: where the candidate or its document comes from.
        float(value.count("/")),
        float("://" in before or before.endswith(("/", "\\", "@"))),
        float(bool(source) and bool(re.search(r"(?i)(config|secret|env|key|test|doc)", source))),
        # Neighbouring words.
        float(bool(_NAMES.search(before))),
        float(before.rstrip("\"' ").endswith(("=", ":"))),
        float(before.endswith(('"', "'"))),
        float(after.startswith(('"', "'"))),
        float(before[-1:].isspace() or not before),
    ]


def _scan(settings: Settings):
    half = settings.labelled // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples = np.zeros(27 * 27, dtype=np.int64), np.zeros(27**3, dtype=np.int64)
        kept: dict[float, list] = {0.0: [], 1.0: []}
        seen: dict[float, set] = {0.0: set(), 1.0: set()}
        for b in batches:
            for text, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                letters = letters_of(text.encode("utf-8", "surrogatepass"))
                pairs += np.bincount(letters[:-1] * 27 + letters[1:], minlength=27 * 27)
                triples += np.bincount(triple_codes(letters), minlength=27**3)
                for _, _, value, before, after in candidates(text):
                    label = rule_label(value, before)
                    if label is None:
                        continue
                    rank = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) >> 1
                    heap = kept[label]
                    if rank in seen[label] or (len(heap) == half and -heap[0][0] <= rank):
                        continue
                    seen[label].add(rank)
                    heapq.heappush(heap, (-rank, value, before, after, source or ""))
                    if len(heap) > half:
                        seen[label].discard(-heapq.heappop(heap)[0])
        rows: list[tuple] = [("pair", int(i), int(pairs[i]), None, None, None, None) for i in np.flatnonzero(pairs)]
        rows += [("triple", int(i), int(triples[i]), None, None, None, None) for i in np.flatnonzero(triples)]
        rows += [("finding", -r, int(label), v, x, y, z) for label, heap in kept.items() for r, v, x, y, z in heap]
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "key", "n", "value", "before", "after", "source"])

    return run


def _text(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")]


class Model:
    """Spelling of the corpus and the forest; without findings of both kinds the rules alone decide.

    A finding in a stated format is confirmed; the forest judges all others,
    each by its whole text, however long.
    """

    def __init__(self, spelling: Spelling, forest: Forest | None, settings: Settings):
        self.spelling, self.forest, self.settings = spelling, forest, settings

    def find(self, texts: list[str | None], sources: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """Per text all candidates as (start, end, chance)."""
        spots: list[list[tuple[int, int]]] = []
        rows: list[list[float]] = []
        rule: list[float] = []
        stated: list[bool] = []
        for text, source in zip(texts, sources):
            own = []
            for start, end, value, before, after in candidates(text):
                own.append((start, end))
                rule.append(rule_label(value, before) or 0.0)
                stated.append(bool(_STATED.match(value)))
                rows.append(features(value, before, after, source, self.spelling))
            spots.append(own)
        if not rows:
            return [[] for _ in texts]
        judged = self.forest.chance(np.array(rows)) if self.forest else np.array(rule)
        chance = iter(np.where(stated, 1.0, judged).tolist())  # a stated format needs no vote
        return [[(a, b, next(chance)) for a, b in own] for own in spots]


def fit(docs: DataFrame, settings: Settings = Settings(), findings: DataFrame | None = None) -> Model:
    """Letter counts over all documents, and a forest from labelled findings.

    ``findings``: ``value, before, after, source, label`` (1 secret, 0 not);
    without it, findings of ``docs`` that ``rule_label`` is sure of.  Both are
    cut to the bounded sample.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = docs.select(*_text(docs)).mapInArrow(_scan(settings), "kind string, key long, n long, value string, before string, after string, source string")
    found = scratch.put(found)  # one pass over the texts for counts and findings
    counts = found.where("kind <> 'finding'").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    half = settings.labelled // 2
    own = found.where("kind = 'finding'")
    if findings is not None:
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("value", "before", "after", "source")]
        key = F.xxhash64("value").bitwiseAND(F.lit((1 << 63) - 1))
        own = findings.where("value <> '' and label is not null").select(F.lit("finding").alias("kind"), key.alias("key"), F.col("label").cast("long").alias("n"), *text)
    label = lambda n: own.where(F.col("n") == n).dropDuplicates(["key"]).orderBy("key").limit(half)
    rows = counts.select("kind", "key", "n", *(F.lit(None).cast("string").alias(c) for c in ("value", "before", "after", "source"))).union(label(0)).union(label(1)).collect()
    scratch.drop(found)
    tables = {"pair": np.zeros(27 * 27), "triple": np.zeros(27**3)}
    for r in rows:
        if r["kind"] != "finding":
            tables[r["kind"]][r["key"]] = r["n"]
    spelling = Spelling(tables["pair"], tables["triple"])
    marked = sorted((r["key"], r["n"], r["value"], r["before"], r["after"], r["source"]) for r in rows if r["kind"] == "finding")
    if len({m[1] for m in marked}) < 2:
        return Model(spelling, None, settings)
    x = np.array([features(*m[2:], spelling) for m in marked])
    return Model(spelling, Forest.fit(x, np.array([float(m[1]) for m in marked]), settings.trees, settings.depth), settings)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__drawlog_found``: all candidates ``(start, end, chance)`` of a text, in order; code points, end exclusive.

    Null or empty text has an empty list; whole texts are read; a row for every
    row, repeated ones alike; further columns stay.
    """

    @F.pandas_udf("array<struct<start:bigint,end:bigint,chance:double>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, source in batches:
            yield pd.Series([[{"start": a, "end": b, "chance": c} for a, b, c in own] for own in model.find(text.tolist(), source.tolist())], dtype=object)

    return docs.withColumn("__drawlog_found", found(*_text(docs)))


def find_secrets(docs: DataFrame, settings: Settings = Settings(), findings: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_candidates, n_secrets, secrets``: a row per row of ``docs``.

    ``secrets`` are the candidates whose chance reaches ``settings.least``.
    Null or empty text has none; repeated rows stay; only ``doc_id``, ``text``
    and ``source`` are read; an empty table gives no row.
    """
    model = fit(docs, settings, findings)
    found = scan(docs.select("doc_id", "text", "source"), model)
    secret = F.filter("__drawlog_found", lambda s: s["chance"] >= settings.least)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("__drawlog_found").cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"), secret.alias("secrets"))


def redact(docs: DataFrame, settings: Settings = Settings(), findings: DataFrame | None = None, mask: str = "<secret>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` and ``n_chars`` set to the new length where that changed; all rows and columns stay.

    Null, empty and clean texts and their ``n_chars`` stay as they are;
    repeated rows are changed alike; an empty table gives no row.  A chance
    equal to ``settings.least`` counts as a secret.
    """
    model = fit(docs, settings, findings)
    least = settings.least

    @F.pandas_udf("string")
    def masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, source in batches:
            out = []
            for t, own in zip(text, model.find(text.tolist(), source.tolist())):
                parts, at = [], 0
                for start, end, chance in own:
                    if chance >= least:
                        parts += [t[at:start], mask]
                        at = end
                out.append("".join([*parts, t[at:]]) if parts else None)
            yield pd.Series(out, dtype=object)

    new = "__drawlog_text"
    out = docs.withColumn(new, masked(*_text(docs)))
    changed = F.col(new).isNotNull()
    out = out.withColumn("n_chars", F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.when(changed, F.col(new)).otherwise(F.col("text"))).select(*docs.columns)
