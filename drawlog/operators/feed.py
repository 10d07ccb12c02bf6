"""News feed and device admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: order of an item without one (largest exact JSON integer).
NO_ORDER = 9_007_199_254_740_991


def feed_dedup(feed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First valid row per id; rows without a usable id or a title are skipped."""
    keys = keys or []
    rest = [c for c in feed.columns if c not in (*keys, "id")]
    valid = feed.where(F.col("id").rlike(r"\S") & F.col("title").isNotNull())
    return (
        valid.groupBy(*keys, "id")
        .agg(F.min_by(F.struct(*rest), F.col("position")).alias("_r"))
        .select(*keys, "id", "_r.*")
    )


def feed_order(feed: DataFrame) -> DataFrame:
    """sort_order (missing last), then newest, then position."""
    return feed.orderBy(
        F.coalesce("sort_order", F.lit(NO_ORDER)), F.coalesce("created_at", F.lit("")).desc(), "position"
    )


def unseen_items(feed: DataFrame, seen: DataFrame, announced: DataFrame | None = None) -> DataFrame:
    """Rows whose id was neither seen nor announced."""
    out = feed.join(seen.select("id").distinct(), "id", "left_anti")
    return out if announced is None else out.join(announced.select("id").distinct(), "id", "left_anti")


def unread_badge(feed: DataFrame, seen: DataFrame) -> DataFrame:
    """Unseen count as text, ``9+`` above nine; hidden at zero."""
    n = unseen_items(feed, seen).agg(F.count(F.lit(1)).alias("unread"))
    return n.select(
        "unread",
        F.when(F.col("unread") > 9, "9+").otherwise(F.col("unread").cast("string")).alias("badge"),
        (F.col("unread") == 0).alias("hidden"),
    )


def device_admission(uses: DataFrame, max_devices: int = 1) -> DataFrame:
    """Add ``admitted``: the first ``max_devices`` devices of a license are let in, others refused.

    ``uses``: license_key, device_id, ts, event_id.  First uses are aggregated
    per device before devices are ranked, and the rank keeps only the first
    few per task before the shuffle.
    """
    first = uses.groupBy("license_key", "device_id").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    w = Window.partitionBy("license_key").orderBy("_first")
    let_in = (
        first.withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= max_devices)
        .select("license_key", "device_id", F.lit(True).alias("_in"))
    )
    return (
        uses.join(let_in, ["license_key", "device_id"], "left")
        .withColumn("admitted", F.coalesce("_in", F.lit(False)))
        .drop("_in")
    )
