"""Typed readers for logs, captured assets, settings and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlog import schema as S


def _lines(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    lines = (spark.readStream if streaming else spark.read).text(path)
    return lines.where(F.trim("value") != "").select("value", F.xxhash64("value").cast("string").alias("batch_id"))


def _events(lines: DataFrame) -> DataFrame:
    """``value, batch_id, position, _v, text, kind``: the elements of every line that is a JSON array, each parsed (``_v``) and as its text."""
    array = F.try_parse_json("value")
    # Parsed anew from the text that is kept, inside the generator: it runs once per element there.
    parts = F.transform(F.try_variant_get(array, "$", "array<variant>"), lambda v: F.try_parse_json(F.to_json(v)))
    rows = lines.select("value", "batch_id", F.posexplode(parts).alias("position", "_v"))
    return rows.select("value", "batch_id", F.col("position").cast("bigint").alias("position"), "_v", F.to_json("_v").alias("text"), F.schema_of_variant("_v").alias("kind"))


_CHECKED = [f for f in S.EVENT.fields if f.name != "value"]
#: Fields that hold a text whatever their kind.
_TEXTS = {f.name for f in _CHECKED if isinstance(f.dataType, T.StringType)}


def _fitting(f: T.StructField) -> str:
    """Pattern of the kinds a field may have; a null fits every field."""
    if f.name in _TEXTS:
        return "^(VOID|STRING)$"
    if isinstance(f.dataType, T.ArrayType):
        return "^(VOID$|ARRAY<(?!(?s:.)*(STRING|BOOLEAN|OBJECT|VARIANT)))"
    if isinstance(f.dataType, T.StructType):
        return "^(VOID$|OBJECT<)"
    return "^(VOID$|BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _faults() -> Column:
    """Fields of an event (``_v``) whose value is not of their type; null where all are.

    Each field is looked up once: a missing one has no kind, and no kind is no fault.
    """
    odd = []
    for f in _CHECKED:
        kind = F.schema_of_variant(F.try_variant_get("_v", f"$.{f.name}", "variant"))
        odd.append(F.when(~kind.rlike(_fitting(f)), F.lit(f.name)))
    names = F.array_compact(F.array(*odd))
    return F.when(F.size(names) > 0, F.concat(F.lit("type of "), F.array_join(names, ", ")))


def read_draw_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text files with one JSON array of events per line, to typed log rows.

    Unknown fields are dropped and missing ones are null; a transform that does
    not have six numbers becomes null.  ``batch_id`` names the line's batch by
    content so that a resent line gets the same id.  What cannot be read this
    way is given, with the reason, by :func:`rejected_draw_log`; a blank line
    is no batch.
    """
    rows = _events(_lines(spark, path, streaming)).where(F.col("kind").startswith("OBJECT<"))
    rows = rows.withColumn("_fault", _faults()).where("_fault IS NULL")
    rows = rows.withColumn("e", F.from_json("text", S.EVENT))
    return rows.select(
        *[F.col(f"e.{n}").alias(n) for n in S.EVENT.fieldNames() if n != "transform"],
        F.when(F.size("e.transform") == 6, F.col("e.transform")).alias("transform"),
        "batch_id",
        "position",
    )


def rejected_draw_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """What :func:`read_draw_log` leaves out: ``batch_id, position, reason, text``.

    A line that is no JSON or no array is one row without a position; an
    element that is no object, or has a field of another type, is one row with
    its place.  Together with the log's rows they make up the whole input.
    """
    lines = _lines(spark, path, streaming)
    array = F.try_parse_json("value")
    kind = F.schema_of_variant(array)
    whole = F.when(array.isNull(), "not JSON").when(~kind.startswith("ARRAY<"), "not an array")
    bad = lines.withColumn("reason", whole).where("reason IS NOT NULL")
    bad = bad.select("batch_id", F.lit(None).cast("bigint").alias("position"), "reason", F.col("value").alias("text"))
    odd = _events(lines).withColumn("reason", F.when(~F.col("kind").startswith("OBJECT<"), "not an object").otherwise(_faults()))
    return bad.unionByName(odd.where("reason IS NOT NULL").select("batch_id", "position", "reason", "text"))


def read_vector_assets(spark: SparkSession, path: str) -> DataFrame:
    """Captured SVG rows; camelCase names become column names."""
    raw = spark.read.schema(S.VECTOR_ASSET).json(path)
    return raw.withColumnRenamed("svgId", "svg_id")


# Export settings used where a job gives none.
DEFAULT_SETTINGS = {
    "profile": "adobe-stock",
    "min_pixels": 15_000_000.0,
    "max_pixels": 65_000_000.0,
    "ratio": "source",
    "background_color": "#ffffff",
    "transparent_background": False,
    "artwork_scale": 1.0,
}


def load_export_settings(df: DataFrame) -> DataFrame:
    """Fill missing settings, column by column; missing lists become empty."""
    out = df
    for name, value in DEFAULT_SETTINGS.items():
        base = F.col(name) if name in df.columns else F.lit(None)
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "string"
        out = out.withColumn(name, F.coalesce(base.cast(kind), F.lit(value)))
    for name in ("removed_colors", "removed_elements"):
        base = F.col(name) if name in df.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(base.cast("array<string>"), F.array().cast("array<string>")))
    return out


FEED_ITEM = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("id", "type", "title", "description", "image_url", "link", "note", "created_at")
    ]
    + [T.StructField("sort_order", T.DoubleType())]
)
_ENVELOPE = T.StructType(
    [T.StructField("success", T.BooleanType()), T.StructField("data", T.ArrayType(FEED_ITEM))]
)


def load_feed(df: DataFrame, body: str = "body") -> DataFrame:
    """Feed envelopes to items with their position; other envelopes are refused."""
    keep = [c for c in df.columns if c != body]
    return (
        df.withColumn("_e", F.from_json(body, _ENVELOPE))
        .where(F.col("_e.success") & F.col("_e.data").isNotNull())
        .select(*keep, F.posexplode("_e.data").alias("position", "_i"))
        .select(*keep, F.col("position").cast("bigint").alias("position"), "_i.*")
    )
