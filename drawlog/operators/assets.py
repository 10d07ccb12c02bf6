"""Captured vector assets: revisions, elements, edits, file names."""

from __future__ import annotations

import re
import sys
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlog.functions.color import normalize_paint_hex
from drawlog.functions.rules import validate_vector_asset
from drawlog.operators.running import BLOCK_ROWS, Run, running
from drawlog.sources.staging import stage

ASSET = ["session_id", "svg_id"]


def asset_revisions(updates: DataFrame, span: int = BLOCK_ROWS) -> DataFrame:
    """Valid updates with ``changed`` and ``revision``.

    The revision rises only when markup, size or filename differ from the
    version before.  ``updates``: session_id, svg_id, arrival and the asset
    columns.
    """
    valid = validate_vector_asset(updates).where("reason IS NULL").drop("reason")
    same = F.sha2(F.to_json(F.struct("markup", "width", "height", "filename")), 256)
    block = F.floor(F.col("arrival") / span)
    before = running(
        valid.withColumn("_now", same), ASSET, ["arrival"], block, {"_last": Run("last", F.col("_now"), inclusive=False)}
    )
    marked = before.withColumn("changed", F.coalesce(F.col("_now") != F.col("_last"), F.lit(True))).drop("_now", "_last")
    return running(marked, ASSET, ["arrival"], block, {"revision": Run("sum", F.col("changed").cast("bigint"))})


def vector_catalog(updates: DataFrame, span: int = BLOCK_ROWS) -> DataFrame:
    """Latest stored version of every asset."""
    stored = asset_revisions(updates, span).where("changed").drop("changed")
    rest = [c for c in stored.columns if c not in ASSET]
    latest = stored.groupBy(*ASSET).agg(F.max_by(F.struct(*rest), F.col("arrival")).alias("_r"))
    return latest.select(*ASSET, "_r.*")


# Elements that paint, and containers that only define.
PAINT_TAGS = ("path", "rect", "circle", "ellipse", "polygon", "polyline", "line", "text", "use")
DEFINING_TAGS = ("defs", "clipPath", "mask", "pattern", "symbol", "marker")
_ELEMENT_FIELDS = ["element_no", "tag", "dom_id", "fill", "stroke", "hidden", "d", "own_fill", "own_stroke", "fill_rule", "matrix", "stroke_width"]


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _paint_of(node: ET.Element, name: str) -> str | None:
    m = re.search(rf"(?:^|;)\s*{name}\s*:\s*([^;]+)", node.get("style") or "")
    return (m.group(1).strip() if m else "") or node.get(name) or None


def _walk(root: ET.Element):
    """Paint elements outside defs in document order, with the paint they inherit.

    The open elements are a list, so nesting may be as deep as the markup says.
    """
    todo = [(root, None, None, False, False)]
    while todo:
        node, fill, stroke, in_defs, hidden = todo.pop()
        tag = _local(node.tag)
        fill, stroke = _paint_of(node, "fill") or fill, _paint_of(node, "stroke") or stroke
        in_defs = in_defs or tag == "defs"
        if tag in PAINT_TAGS and not in_defs:
            yield node, tag, fill or "#000000", stroke, hidden
        inside = hidden or tag in DEFINING_TAGS
        todo += [(child, fill, stroke, in_defs, inside) for child in reversed(node)]


def _parse(markup: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(markup or "")
    except ET.ParseError:
        return None


def vector_elements(assets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per paint element of the markup, outside defs, in document order.

    fill and stroke are inherited (style before attribute); ``hidden`` marks
    elements inside a defining container, which EPS leaves out.  Markup that is
    not well formed gives no rows.
    """
    keys = keys or ASSET
    text = lambda n: T.StructField(n, T.StringType())
    fields = {"element_no": T.StructField("element_no", T.LongType()), "hidden": T.StructField("hidden", T.BooleanType())}
    out = T.StructType(
        [assets.schema[k] for k in keys] + [fields.get(n, text(n)) for n in _ELEMENT_FIELDS]
    )

    def read(batches):
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False, name=None):
                root = _parse(values[-1])
                if root is None:
                    continue
                for no, (node, tag, fill, stroke, hidden) in enumerate(_walk(root), 1):
                    own = [node.get(a) for a in ("d", "fill", "stroke", "fill-rule", "transform", "stroke-width")]
                    rows.append((*values[:-1], no, tag, node.get("id") or None, fill, stroke, hidden, *own))
            yield pd.DataFrame(rows, columns=[*keys, *_ELEMENT_FIELDS])

    return assets.select(*keys, "markup").mapInPandas(read, out)


def element_ids(elements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add element_id: the id, else ``svg-el-n`` counting elements without id.

    An asset has at most 100,000 elements, so its window is bounded.
    """
    keys = keys or ASSET
    no_id = F.col("dom_id").isNull()
    w = Window.partitionBy(*keys).orderBy("element_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.sum(no_id.cast("bigint")).over(w) - 1
    return elements.withColumn(
        "element_id", F.when(no_id, F.concat(F.lit("svg-el-"), count.cast("string"))).otherwise(F.col("dom_id"))
    )


def edit_markup(assets: DataFrame, ids: DataFrame, colors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Markup with chosen elements removed and chosen colors set to ``none``.

    ``ids``: keys, element_id.  ``colors``: keys, color (``#RRGGBB``).  Which
    elements are hit is decided by joins; the markup is rewritten by element
    number.  Assets without a hit keep their markup.
    """
    keys = keys or ASSET
    elements = stage(element_ids(vector_elements(assets, keys), keys), "elements")
    removed = elements.join(ids.select(*keys, "element_id").distinct(), [*keys, "element_id"], "left_semi")
    chosen = colors.select(*keys, F.upper("color").alias("_hex")).distinct()
    hits = [removed.select(*keys, "element_no", F.lit("remove").alias("what"))]
    for side in ("fill", "stroke"):
        hex_of = elements.select(*keys, "element_no", normalize_paint_hex(F.col(side)).alias("_hex"))
        hits.append(
            hex_of.join(chosen, [*keys, "_hex"], "left_semi").select(*keys, "element_no", F.lit(side).alias("what"))
        )
    edits = (
        hits[0].unionByName(hits[1]).unionByName(hits[2])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("element_no", "what"))).alias("edits"))
    )
    todo = assets.join(edits, keys, "left")
    names = assets.columns

    def rewrite(batches):
        for pdf in batches:
            done = [_apply_edits(m, e) for m, e in zip(pdf["markup"], pdf["edits"])]
            yield pdf[names].assign(markup=done)

    return todo.mapInPandas(rewrite, assets.schema)


def _apply_edits(markup: str | None, edits) -> str | None:
    if edits is None or not len(edits):
        return markup
    root = _parse(markup)
    if root is None:
        return markup
    ET.register_namespace("", "http://www.w3.org/2000/svg")
    nodes = {no: hit[0] for no, hit in enumerate(_walk(root), 1)}
    parents = {child: parent for parent in root.iter() for child in parent}
    for edit in edits:
        node = nodes.get(edit["element_no"])
        if node is None:
            continue
        if edit["what"] == "remove":
            if node in parents:
                parents[node].remove(node)
        else:
            name = edit["what"]
            node.set(name, "none")
            style = re.sub(rf"(^|;)\s*{name}\s*:[^;]*", r"\1", node.get("style") or "").strip("; ")
            node.set("style", f"{style}; {name}: none" if style else f"{name}: none")
    return _markup(root)


def _markup(root: ET.Element) -> str:
    """Text of a tree of any depth."""
    depth, level = 0, [root]
    while level:
        depth, level = depth + 1, [child for node in level for child in node]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 2 * depth + 1000))
    try:
        return ET.tostring(root, encoding="unicode")
    finally:
        sys.setrecursionlimit(limit)


def filename_override(docs: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The user's file name where there is one, else the document's."""
    given = names.select(*keys, F.col("filename").alias("_given"))
    return (
        docs.join(given, keys, "left")
        .withColumn("filename", F.coalesce(F.when(F.col("_given") != "", F.col("_given")), F.col("filename")))
        .drop("_given")
    )


def _candidate(stem: str, ext: str, index: str):
    return F.expr(f"CASE WHEN {index} = 0 THEN {stem} ELSE concat({stem}, '_', CAST({index} AS STRING)) END || {ext}")


_NUMBERED = r"_[1-9][0-9]{0,17}$"


def _number(name: str):
    return F.regexp_extract(name, r"_([1-9][0-9]*)$", 1).cast("bigint")


def _taken_or_lost(asked: DataFrame, ranked: DataFrame, blocked: DataFrame, key: list[str], span: int) -> DataFrame:
    """Who gets a number that is also another asked name: ``asked`` with ``_lost`` (the other name was first).

    Row j of a name (from 0) comes to its i-th free number m when j + (numbers
    lost before) = m.  The number is lost if ``_first``, the other name's first
    row, comes before row j, so with c rows before ``_first``: lost if
    (lost before) <= m - c.  This one count is walked over blocks of numbers;
    all names walk their blocks side by side.
    """
    names = asked.select(*key).distinct()
    numbers = asked.select(*key, "taken", "_first", "_child", F.lit(0).cast("bigint").alias("_one"))
    passed = blocked.join(names, key, "left_semi").select(
        *key, "taken", F.lit(None).cast("bigint").alias("_first"), F.lit(None).cast("string").alias("_child"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    free = running(
        numbers.unionByName(passed), key, ["taken"], F.floor(F.col("taken") / span), {"_passed": Run("sum", F.col("_one"))}
    ).where("_first IS NOT NULL")
    rows = ranked.join(names, key, "left_semi").select(
        *key, "row_no", F.lit(None).cast("bigint").alias("taken"), F.lit(1).cast("bigint").alias("_one")
    )
    asks = asked.select(*key, F.col("_first").alias("row_no"), "taken", F.lit(0).cast("bigint").alias("_one"))
    before = running(
        rows.unionByName(asks), key, ["row_no"], F.floor(F.col("row_no") / span), {"_before": Run("sum", F.col("_one"))}
    ).where("taken IS NOT NULL")
    slack = free.join(before.select(*key, "taken", "_before"), [*key, "taken"]).select(
        *key, "taken", "_child", (F.col("taken") - F.col("_passed") - F.col("_before")).alias("_slack")
    )
    nth = {"_nth": Run("sum", F.lit(1).cast("bigint"))}
    slack = running(slack, key, ["taken"], F.floor(F.col("taken") / span), nth)
    slack = stage(slack.withColumn("_part", F.floor((F.col("_nth") - 1) / span)).drop("_nth"), "slack")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("taken")
        lost, n = [], int(part["_sofar"].iloc[0])
        for room in part["_slack"]:
            lost.append(n <= room)
            n += lost[-1]
        return part.assign(_lost=lost, _sofar=n)[[*key, "taken", "_child", "_lost", "_sofar"]]

    schema = f"{key[0]} string, {key[1]} string, taken bigint, _child string, _lost boolean, _sofar bigint"
    out, sofar = None, names.withColumn("_sofar", F.lit(0).cast("bigint"))
    for i in range(slack.agg(F.max("_part")).first()[0] + 1):
        part = slack.where(F.col("_part") == i).join(sofar, key)
        done = stage(part.groupBy(*key).applyInPandas(walk, schema), "walked")
        out = done if out is None else out.unionByName(done)
        sofar = done.groupBy(*key).agg(F.max("_sofar").alias("_sofar"))
    return out.drop("_sofar")


def allocate_unique_filenames(df: DataFrame, existing: DataFrame, span: int = BLOCK_ROWS) -> DataFrame:
    """Add ``stored_name``: first free of name, name_1, name_2, ..., row by row in the order of row_no.

    ``df``: row_no (unique, decides who comes first) and filename; ``existing``:
    filename.  Two names meet in one place only: number k of ``a`` is the plain
    name of ``a_k``, and the first row that asks for ``a_k`` tries that first.
    So which of them gets it depends on ``a`` alone, and names are settled from
    ``a`` to ``a_k`` to ``a_k_l``: one round per level of nesting, whatever the
    number of collisions.  Then the j-th request for a name takes the j-th
    number that stored files and other names leave it.
    """
    parts = df.withColumns(
        {
            "_stem": F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""),
            "_ext": F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1),
        }
    )
    key = ["_stem", "_ext"]
    ranked = stage(
        running(parts, key, ["row_no"], F.floor(F.col("row_no") / span), {"_rank": Run("sum", F.lit(1).cast("bigint"))})
        .withColumn("_rank", F.col("_rank") - 1),
        "names",
    )
    names = ranked.groupBy(*key).agg(F.min("row_no").cast("bigint").alias("_first"))
    # Numbers of a name that stored files occupy.
    split = existing.select(
        F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "").alias("_s"),
        F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1).alias("_ext"),
    ).distinct()
    parent = F.regexp_replace("_s", _NUMBERED, "").alias("_stem")
    plain = split.select(F.col("_s").alias("_stem"), "_ext", F.lit(0).cast("bigint").alias("taken"))
    numbered = split.where(F.col("_s").rlike(_NUMBERED)).select(parent, "_ext", _number("_s").alias("taken"))
    blocked = stage(plain.unionByName(numbered).join(names, key, "left_semi").distinct(), "taken")
    # Asked names that are a number of another asked name.
    nested = names.withColumnRenamed("_stem", "_s").where(F.col("_s").rlike(_NUMBERED)).select(
        parent, "_ext", _number("_s").alias("taken"), "_first", F.col("_s").alias("_child")
    )
    nested = stage(nested.join(names.select(*key), key, "left_semi"), "nested")
    while not nested.isEmpty():
        waiting = nested.select(F.col("_child").alias("_stem"), "_ext")
        asked = stage(nested.join(waiting, key, "left_anti").join(blocked, [*key, "taken"], "left_anti"), "asked")
        if not asked.isEmpty():
            judged = stage(_taken_or_lost(asked, ranked, blocked, key, span), "judged")
            lost = judged.where("_lost").select(*key, "taken")
            got = judged.where("NOT _lost").select(F.col("_child").alias("_stem"), "_ext", F.lit(0).cast("bigint").alias("taken"))
            blocked = stage(blocked.unionByName(lost).unionByName(got).distinct(), "taken")
        nested = stage(nested.join(waiting, key, "left_semi"), "nested")
    # j-th request takes number j plus the blocked numbers it has to pass.
    passes = running(
        blocked, key, ["taken"], F.floor(F.col("taken") / span), {"_nth": Run("sum", F.lit(1).cast("bigint"))}
    ).withColumn("_from", F.col("taken") - (F.col("_nth") - 1))
    steps = passes.groupBy(*key, "_from").agg(F.count(F.lit(1)).alias("_k"))
    line = ranked.select(*key, F.col("_rank").alias("_at"), "row_no", F.lit(0).cast("bigint").alias("_k")).unionByName(
        steps.select(*key, F.col("_from").alias("_at"), F.lit(-1).cast("bigint").alias("row_no"), "_k")
    )
    placed = running(
        line, key, ["_at", "row_no"], F.floor(F.col("_at") / span), {"_skip": Run("sum", F.col("_k"))}
    ).where("row_no >= 0")
    named = placed.withColumn("_index", F.col("_at") + F.col("_skip")).select(
        "row_no", _candidate("_stem", "_ext", "_index").alias("stored_name")
    )
    return df.join(named, "row_no")
