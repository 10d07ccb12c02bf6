"""URL filter rules, indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z0-9]+")
#: Characters of all patterns together; the index goes to every executor, so its size is bounded here.
MAX_RULE_CHARS = 16_000_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path written one after the other; ``tokens`` are the whole words that every match holds.

    Of the fitting rules the one with the highest ``(level, weight)`` decides,
    ties by name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    level: int = 0
    weight: int = 0
    stated: bool = False


def prefix_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host with all its subdomains, and the paths that start with the given one."""
    host, slash, rest = name.partition("/")
    # A token counts only if nothing can lengthen it: the last one of an open path may be the start of a word.
    closed = name if not name or not name[-1].isalnum() else re.sub(r"[a-zA-Z0-9]+$", "", name)
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}", tuple(_TOKEN.findall(closed.lower())), 1, len(name), True)


#: The rules of the registered query.
STATED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words that, alone between separators in a host, mark pages no corpus wants.
UNWANTED = ("adult", "bet", "bets", "casino", "escort", "gambling", "jackpot", "lottery", "nude", "pills", "poker", "porn", "sex", "slots", "viagra", "warez", "xxx")


def default_rules() -> list[Rule]:
    words = [Rule(f"word:{w}", "block", rf"^(?:[^/]*[.-])?{w}(?:[.-][^/]*)?(?:/|\Z)", (w,)) for w in UNWANTED]
    return [prefix_rule(v, n) for v, n in STATED] + words


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), _UPPER, _LOWER)
    return F.when(known, host).otherwise(""), F.when(known, F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)).otherwise("")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs; at most one number per rule token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    of_rules = F.array_intersect(_tokens(F.concat("host", "path")), F.array(*map(F.lit, wanted)))
    rows = urls.select(F.explode(of_rules).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by the token that the fewest urls have (ties by token), and those without a token, which every url must try."""
    index: dict[str, list[Rule]] = {}
    always = []
    for r in rules:
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
        else:
            always.append(r)
    return index, always


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, column: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with ``host, path, rule, verdict, stated``, a row for every row of ``pages``.

    Candidate rules come from the url's tokens, and only their patterns run.
    ``rule`` is the name of the deciding rule; without one it is null and the
    verdict is ``allow``.  A null url or one without ``://`` has empty host
    and path; repeated rows stay; other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    if sum(len(r.pattern) for r in rules) > MAX_RULE_CHARS:
        raise ValueError(f"the rules hold over {MAX_RULE_CHARS} characters: split them and judge in turn")
    host, path = split_url(F.col(column).cast("string"))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    index, always = rule_index(rules, token_counts(parts, rules))
    plain = lambda rs: [((r.level, r.weight), r.name, r.verdict, r.pattern, r.stated) for r in rs]
    shared = pages.sparkSession.sparkContext.broadcast(({t: plain(rs) for t, rs in index.items()}, plain(always)))

    @F.pandas_udf("rule string, verdict string, stated boolean")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by_token, untied = shared.value
        compiled: dict[str, re.Pattern] = {}
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths):
                best = None
                fetched = [r for t in dict.fromkeys(_TOKEN.findall(ascii_lower(h + p))) for r in by_token.get(t, ())]
                for r in fetched + untied:
                    if best and (best[0], r[1]) >= (r[0], best[1]):
                        continue
                    pattern = compiled.get(r[3]) or compiled.setdefault(r[3], re.compile(r[3]))
                    if pattern.search(h + p):
                        best = r
                out.append((best[1], best[2], best[4]) if best else (None, "allow", False))
            yield pd.DataFrame(out, columns=["rule", "verdict", "stated"])

    return parts.withColumn("_d", decide("host", "path")).select(*keep, "host", "path", F.col("_d.rule").alias("rule"), F.col("_d.verdict").alias("verdict"), F.col("_d.stated").alias("stated"))


def ascii_lower(text: str) -> str:
    return text.translate(_TO_LOWER)


_TO_LOWER = str.maketrans(_UPPER, _LOWER)
