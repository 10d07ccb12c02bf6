"""Text, number formatting, names, links, emails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fmt4(v: Column) -> Column:
    """Up to four decimals, half away from zero, no trailing zeros, no -0."""
    v = v.cast("double")
    whole = (F.abs(v) < 1e15) & (F.rint(v) == v)
    text = F.regexp_replace(F.format_string("%.4f", F.round(v * 10000.0, 0) / 10000.0), r"\.?0+$", "")
    # Whole numbers, the most frequent ones, need no formatting.
    return F.when(whole, v.cast("bigint").cast("string")).when(v.isNotNull(), F.regexp_replace(text, "^(-0|-?Infinity|NaN)$", "0"))


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def xml_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def close_for_fill(d: Column) -> Column:
    """End every subpath (text between literal `` M ``) with ``Z``."""
    def close(part: Column) -> Column:
        bare = strip(part)
        return F.when(bare.endswith("Z") | (bare == ""), part).otherwise(F.concat(part, F.lit(" Z")))

    return F.array_join(F.transform(F.split(d, " M "), close), " M ")


def safe_filename(name: Column, fmt: str = "svg", chosen: bool = False) -> Column:
    """A name that can be stored: last path part, no reserved characters, right ending.

    With ``chosen`` the format was picked by the user and replaces either
    ending; otherwise ``.eps`` replaces ``.svg`` and ``.svg`` is appended.
    """
    default = F.lit(f"vectorized-result.{fmt}")
    if chosen:
        name = F.concat(F.regexp_replace(name, r"(?i)\.(svg|eps)$", ""), F.lit(f".{fmt}"))
    trimmed = F.regexp_replace(F.coalesce(name, default), r"(/+\.?)+$", "")
    base = F.substring_index(trimmed, "/", -1)
    base = F.when((base == "") | base.isin(".", ".."), default).otherwise(base)
    safe = F.regexp_replace(base, r'[\x00-\x1f\x7f-\x{9f}<>:"/\\|?*]', "_")
    if fmt == "eps":
        safe = F.regexp_replace(safe, r"(?i)\.svg$", "")
    return F.when(F.lower(safe).endswith(f".{fmt}"), safe).otherwise(F.concat(safe, F.lit(f".{fmt}")))


def override_filename(name: Column) -> Column:
    """A user-given file name, or null when nothing usable is left of it."""
    last = strip(F.regexp_extract(strip(name), r"([^\\/]*)$", 1))
    safe = F.regexp_replace(last, r'[\x00-\x1f<>:"/\\|?*]', "_")
    return F.when((safe == "") | (safe == "."), None).when(F.lower(safe).endswith(".svg"), safe).otherwise(
        F.concat(safe, F.lit(".svg"))
    )


def _url(u: Column, schemes: str) -> Column:
    s = strip(u)
    pattern = rf"(?is)^({schemes})://([^/?#\s]+)([^\s]*)$"
    host = F.lower(F.regexp_extract(s, pattern, 2))
    rest = F.regexp_extract(s, pattern, 3)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(
        host != "", F.concat(F.lower(F.regexp_extract(s, pattern, 1)), F.lit("://"), host, path)
    )


def https_url(u: Column) -> Column:
    """The normalized link when it is https with a host, else null."""
    return _url(u, "https")


def http_url(u: Column) -> Column:
    return _url(u, "https?")


def url_scheme_filter(df: DataFrame, link: str = "link") -> DataFrame:
    return df.withColumn("https_link", https_url(F.col(link))).withColumn("target_url", http_url(F.col(link)))


def frame_prefix(canvas_id: Column) -> Column:
    """Text before the last ``-canvas-``; null without one."""
    cut = F.regexp_extract(canvas_id, r"(?s)^(.*)-canvas-", 1)
    return F.when(F.instr(canvas_id, "-canvas-") > 0, cut)


def normalize_email(s: Column) -> Column:
    return F.lower(strip(s))


def activation_window(issued_at: Column, days: Column | int) -> Column:
    """End of the window: start of the issue day in UTC+7 plus (days + 1) days."""
    days = F.lit(days) if isinstance(days, int) else days
    shift, day = 7 * 3600, 86_400
    seconds = F.unix_seconds(issued_at.cast("timestamp"))
    start = F.floor((seconds + shift) / F.lit(day)) * day - shift
    return F.timestamp_seconds(start + (days + 1) * day)
