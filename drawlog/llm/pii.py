"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust the score.

Built-in column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal start are listed.  A pattern
#: cannot step back over what it has read, so no text makes it slow.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: Cheap tests that a text with the kind must pass.
_HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
#: Score of a span whose form alone is known, and what its context words add.
_FORM = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
_CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|credit|payment|mastercard)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer|konto)\b",
    "ssn": r"(?i)\b(ssn|social security|tax id)\b",
}
_BONUS, _REACH, BASE = 0.3, 40, ("email", "ip", "card", "phone")
_BLOCK = 256


@dataclass(frozen=True)
class Settings:
    """``threshold``: least score of spans that the method adds to the base kinds, which always stay once confirmed."""

    threshold: float = 0.5


def _prefix_sums(values: Column) -> Column:
    """Sum of all earlier elements, for every element; two levels of blocks keep very long arrays cheap."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    count = F.ceil(F.size(values) / _BLOCK).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    sums = F.transform(numbers, lambda b: total(F.slice(values, b * _BLOCK + 1, _BLOCK)))
    inside = lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK)
    return F.flatten(F.transform(numbers, lambda b: F.transform(inside(b), lambda _, i: total(F.slice(sums, 1, b)) + total(F.slice(inside(b), 1, i)))))


def _luhn(text: Column) -> Column:
    """The digits of ``text`` pass the Luhn test."""
    digits = F.reverse(F.translate(text, " -", ""))
    value = lambda i: F.substring(digits, i, 1).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    spots = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(spots, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _mod97(text: Column) -> Column:
    """The account number in ``text`` passes the mod-97 test."""
    flat = F.translate(text, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    if kind == "ip":
        return text.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)){3}$")
    if kind == "card":
        return F.when((digits >= 14) & (digits <= 19), _luhn(text)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    if kind == "iban":
        size = F.length(F.translate(text, " ", ""))
        return F.when(size.between(15, 34), _mod97(text)).otherwise(False)
    if kind == "ssn":
        return ~text.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Adds ``_<kind>``: the confirmed spans ``(start, end, score)`` of one kind."""
    pattern = PATTERNS[kind]
    hit = F.col(text).rlike(_HINTS[kind])
    none = F.array().cast("array<string>")
    df = df.withColumn(f"_m_{kind}", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(f"_m_{kind}") > 0
    df = df.withColumn(f"_g_{kind}", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    # A match starts after all earlier gaps and matches and its own gap.
    gaps, found = F.col(f"_g_{kind}"), F.col(f"_m_{kind}")
    df = df.withColumn(f"_p_{kind}", F.when(some, _prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long")))))

    def span(m: Column, i: Column) -> Column:
        start = F.col(f"_p_{kind}")[i] + F.length(gaps[i])
        near = F.concat_ws(" ", F.right(gaps[i], F.lit(_REACH)), F.left(gaps[i + 1], F.lit(_REACH)))
        score = F.lit(_FORM[kind]) + F.when(near.rlike(_CONTEXT[kind]), _BONUS).otherwise(0.0)
        ok = _confirmed(kind, m)
        return F.struct(start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), F.least(F.lit(1.0), score).alias("score"), ok.alias("ok"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,score:double,ok:boolean>>")
    df = df.withColumn(f"_s_{kind}", F.when(some, F.transform(found, span)).otherwise(empty))
    return df.withColumn(f"_{kind}", F.filter(f"_s_{kind}", lambda s: s["ok"])).drop(f"_m_{kind}", f"_g_{kind}", f"_p_{kind}", f"_s_{kind}")


def _labelled(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["score"].alias("score"))


def find_pii(docs: DataFrame, settings: Settings = Settings(), column: str = "text") -> DataFrame:
    """``doc_id, text, spans`` with ``spans`` an array of ``(start, rank, kind, end, score)`` in order.

    Offsets are code points, ``end`` exclusive.  Within a kind, matches are
    leftmost and do not overlap, and a match that its checksum refuses is
    dropped without another try.  Context is the text up to 40 characters
    before and after, as far as the next match of the kind.  Null text counts
    as empty; every input row gives one row; other columns are not read.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    kinds = list(PATTERNS)
    for kind in kinds:
        df = _spans(df, kind, "text")
    parts = []
    for rank, kind in enumerate(kinds):
        good = F.col(f"_{kind}") if kind in BASE else F.filter(f"_{kind}", lambda s: s["score"] >= settings.threshold)
        parts.append(F.transform(good, _labelled(rank, kind)))
    return df.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_pii``'s spans."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["rank"] < len(BASE)), label), ",")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"))
