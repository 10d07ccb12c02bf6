"""Catalog of drawings: tile groups with sizes, counts and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlog import schema as S
from drawlog.operators import surface as sf
from drawlog.operators import tiles
from drawlog.operators.ingest import joined_frames
from drawlog.operators.segments import document_size
from drawlog.sources.staging import stage

def _counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("shape", "stroke")]


def canvas_table(
    log: DataFrame,
    surface: DataFrame,
    cap: int | None = None,
    resolved: DataFrame | None = None,
    block_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One row per canvas with its state, counts and first shape; and the current paint table."""
    numbered = sf.numbered_log(surface, block_rows)
    order = stage(sf.current_paints(numbered, cap), "order")
    first = sf.paint_texts(
        log, surface, order.where("kind = 'shape' AND kind_index = 1"), resolved, block_rows
    ).select(
        *S.SURFACE,
        F.col("d").alias("first_d"),
        F.col("paint").alias("first_fill"),
        F.col("fill_rule").alias("first_rule"),
        *[F.get("transform", F.lit(i)).alias(n) for i, n in enumerate(("ma", "mb", "mc", "md", "tx", "ty"))],
    )
    counts = order.groupBy(*S.SURFACE).agg(*_counts())
    ended = log.where("type = 'session_end'").select("session_id").distinct().withColumn("ended", F.lit(True))
    table = (
        sf.state_of(surface)
        .join(counts, S.SURFACE, "left")
        .join(first, S.SURFACE, "left")
        .join(sf.error_count(numbered, cap), S.SURFACE, "left")
        .join(ended, "session_id", "left")
    )
    filled = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("shapes", "strokes", "errors")}
    filled["ended"] = F.coalesce("ended", F.lit(False))
    table = table.withColumns(filled).withColumn("n_paints", F.col("shapes") + F.col("strokes"))
    return stage(table, "canvases"), order


def canvas_catalog(
    log: DataFrame,
    surface: DataFrame | None = None,
    cap: int | None = None,
    resolved: DataFrame | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Catalog rows of all documents.

    A document is a tile group with a visible member whose members all have
    edges of at least 16.  Columns: session_id, canvas_id (representative),
    width, height, revision, shapes, gap_fillers, errors, state.
    """
    if surface is None:
        log = joined_frames(log, block_rows)
        surface = sf.surface_log(log, resolved, block_rows)
    canvases, order = canvas_table(log, surface, cap, resolved, block_rows)
    groups = stage(tiles.tile_groups(canvases).join(canvases, ["session_id", "canvas_id"]), "groups")
    key = tiles.GROUP
    listed = groups.groupBy(*key).agg(
        F.bool_or("visible").alias("_seen"),
        F.min(F.least("width", "height")).alias("_edge"),
        F.count(F.lit(1)).alias("tiles"),
        F.sum("revision").cast("bigint").alias("revision"),
        F.sum("errors").cast("bigint").alias("errors"),
        F.bool_or("ended").alias("_ended"),
        F.max(F.struct("n_paints", "tx", "ty", "canvas_id", "width", "height", "shapes", "strokes")).alias("_m"),
    ).where(F.col("_seen") & (F.col("_edge") >= S.MIN_LISTED_EDGE))
    listed = stage(listed, "listed")
    many = listed.where("tiles > 1").select(*key)
    sizes = None
    if not many.isEmpty():
        members = groups.join(many, key, "left_semi")
        tiled = order.join(members.select("session_id", "canvas_id"), ["session_id", "canvas_id"], "left_semi")
        texts = stage(sf.paint_texts(log, surface, tiled, resolved, block_rows), "tile-paints")
        merged = stage(tiles.merged_paints(texts, members), "merged")
        tile_box = tiles.tile_merge_summary(members).select(*key, "tile_width", "tile_height")
        sizes = (
            merged.groupBy(*key)
            .agg(*_counts())
            .join(document_size(merged, key), key, "left")
            .join(tile_box, key)
            .select(
                *key,
                F.col("shapes").alias("_shapes"),
                F.col("strokes").alias("_strokes"),
                F.coalesce("doc_width", "tile_width").alias("_w"),
                F.coalesce("doc_height", "tile_height").alias("_h"),
            )
        )
    if sizes is None:
        nothing = {"_shapes": "bigint", "_strokes": "bigint", "_w": "double", "_h": "double"}
        out = listed.withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})
    else:
        out = listed.join(sizes, key, "left")
    return out.select(
        "session_id",
        F.col("_m.canvas_id").alias("canvas_id"),
        F.coalesce("_w", "_m.width").alias("width"),
        F.coalesce("_h", "_m.height").alias("height"),
        "revision",
        F.coalesce("_shapes", "_m.shapes").alias("shapes"),
        F.coalesce("_strokes", "_m.strokes").alias("gap_fillers"),
        "errors",
        F.when(F.col("_ended"), "ENDED").otherwise("RECORDING").alias("state"),
    )


def document_tables(
    log: DataFrame,
    surface: DataFrame | None = None,
    cap: int | None = None,
    resolved: DataFrame | None = None,
    block_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Paints and documents for the export jobs, tiles merged.

    The keys of both are ``tiles.GROUP``.  Documents carry canvas_id (the
    representative), width, height, tiles and errors.  A drawing of several
    tiles is as large as its shapes reach, or as its tiles if a shape cannot be
    read.
    """
    if surface is None:
        log = joined_frames(log, block_rows)
        surface = sf.surface_log(log, resolved, block_rows)
    canvases, order = canvas_table(log, surface, cap, resolved, block_rows)
    groups = stage(tiles.tile_groups(canvases).join(canvases, ["session_id", "canvas_id"]), "groups")
    texts = stage(sf.paint_texts(log, surface, order, resolved, block_rows), "tile-paints")
    merged = stage(tiles.merged_paints(texts, groups), "merged")
    key = tiles.GROUP
    docs = groups.groupBy(*key).agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum("errors").cast("bigint").alias("errors"),
        F.max(F.struct("n_paints", "tx", "ty", "canvas_id", "width", "height")).alias("_m"),
    )
    sizes = document_size(merged, key).join(tiles.tile_merge_summary(groups).select(*key, "tile_width", "tile_height"), key, "right")
    many = F.col("tiles") > 1
    side = lambda n: F.when(many, F.coalesce(f"doc_{n}", f"tile_{n}")).otherwise(F.col(f"_m.{n}")).alias(n)
    out = docs.join(sizes, key, "left").select(*key, F.col("_m.canvas_id").alias("canvas_id"), side("width"), side("height"), "tiles", "errors")
    return merged, out


def catalog_order(catalog: DataFrame, only_painted: bool = False) -> DataFrame:
    """Largest area first, then most paints, then id."""
    rows = catalog.where("shapes > 0 OR gap_fillers > 0") if only_painted else catalog
    return rows.orderBy(
        (F.col("width") * F.col("height")).desc(), (F.col("shapes") + F.col("gap_fillers")).desc(), "canvas_id"
    )


def primary_surface(catalog: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First row in catalog order, per ``by`` when given; an aggregate, so no sort is needed."""
    rank = F.struct(
        (-(F.col("width") * F.col("height"))).alias("a"),
        (-(F.col("shapes") + F.col("gap_fillers"))).alias("n"),
        F.col("canvas_id").alias("i"),
    )
    best = F.min_by(F.struct(*catalog.columns), rank).alias("_r")
    return catalog.groupBy(*(by or [])).agg(best).where("_r IS NOT NULL").select("_r.*")


def asset_counts(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """Canvases with paints, vectors, and their total, in one row."""
    c = catalog.agg(F.count_if((F.col("shapes") > 0) | (F.col("gap_fillers") > 0)).alias("canvases"))
    v = vectors.agg(F.count(F.lit(1)).alias("vectors"))
    one = F.lit(1)
    return (
        c.withColumn("_k", one)
        .join(v.withColumn("_k", one), "_k")
        .select("canvases", "vectors", (F.col("canvases") + F.col("vectors")).alias("total"))
    )
