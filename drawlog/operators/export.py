"""SVG and EPS documents from paint tables and captured assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlog.functions.color import parse_paint_rgb
from drawlog.functions.geometry import is_identity, matrix_text, rect_text
from drawlog.functions.sizing import SAFE_AREA, clamp_scale, fit_transform, with_artboard
from drawlog.functions.text import fmt4, let, strip, xml_escape
from drawlog.operators import segments as sg
from drawlog.operators.assets import ASSET, vector_elements
from drawlog.operators.paint import drop_colors, drop_elements, portable_paint, stock_validation
from drawlog.operators.running import Run, running, seq_block
from drawlog.sources.staging import stage

SETTINGS = ["min_pixels", "max_pixels", "ratio", "background_color", "transparent_background", "artwork_scale"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def kept_paints(table: DataFrame, keys: list[str], removed_ids: DataFrame | None, removed_colors: DataFrame | None):
    """Paints that stay after the user's removals; clears always stay."""
    out = table
    if removed_ids is not None:
        out = drop_elements(out, removed_ids)
    if removed_colors is not None:
        out = drop_colors(out, removed_colors)
    return out


def _placed(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with artboard (art_*) and placement (fit)."""
    bounds = sg.artwork_bounds(kept, keys)
    edges = ("min_x", "min_y", "max_x", "max_y")
    wide = with_artboard(docs).join(bounds.hint("merge"), keys, "left")
    box = F.when(F.col("min_x").isNotNull(), F.struct(*edges))
    return (
        wide.withColumn("_box", box)
        .withColumn(
            "fit",
            fit_transform(
                F.col("width"), F.col("height"), F.col("art_width"), F.col("art_height"), F.col("_box"), F.col("artwork_scale")
            ),
        )
        .drop("_box", *edges)
    )


def _background() -> Column:
    color = strip(F.col("background_color"))
    return F.when(color == "", "#ffffff").otherwise(color)


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: str, name: str) -> DataFrame:
    """Concatenate the rows of a document in order."""
    return rows.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda r: r[text]), ""
        ).alias(name)
    )


def document_chunks(rows: DataFrame, keys: list[str], chunk_chars: int = 2**20, block_rows: int | None = None) -> DataFrame:
    """Texts of documents of any size as numbered chunks: keys, chunk, text.

    ``rows``: keys, part, order_no, text; they follow each other by part, then
    order_no, then text.  A row belongs to the chunk in which it begins, so a
    chunk has at most ``chunk_chars`` characters and the rest of one row.
    Numbers rise from 0 and skip the chunks that lie within one long row.  Rows
    without text are left out.  Places are running sums over blocks, so no task
    holds a document.
    """
    order = ["part", "order_no", "text"]
    rows = stage(rows.where("text <> ''").select(*keys, *order), "document-rows")
    block = F.col("part").cast("bigint") * F.lit(2**40) + seq_block("order_no", block_rows)
    start = Run("sum", F.length("text").cast("bigint"), inclusive=False)
    placed = running(rows, keys, order, block, {"_start": start})
    return _joined(placed.withColumn("chunk", F.floor(F.col("_start") / chunk_chars)), [*keys, "chunk"], order[:2], "text", "text")


def _framed(frame: DataFrame, parts: list[DataFrame | Column], keys: list[str]) -> DataFrame:
    """Rows for :func:`document_chunks`: texts of ``frame`` and tables (keys, order_no, _t) in the given order."""
    frame = stage(frame, "frame")
    out = None
    for i, part in enumerate(parts):
        if isinstance(part, Column):
            part = frame.select(*keys, F.lit(0).cast("bigint").alias("order_no"), part.alias("_t"))
        else:
            part = part.join(frame.select(*keys), keys, "left_semi")
        part = part.select(*keys, F.lit(i).alias("part"), F.col("order_no").cast("bigint").alias("order_no"), F.col("_t").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def _numbered_clears(table: DataFrame, keys: list[str]) -> DataFrame:
    """Clears of every document with their number and how many there are.

    Partial clears are events of one session, so a document's list is bounded.
    """
    offset = [F.col(c) if c in table.columns else F.lit(0.0).alias(c) for c in ("surface_x", "surface_y")]
    row = F.struct("order_no", "d", "transform", "clip_d", "clip_transform", "width", "height", *offset)
    clears = table.where("kind = 'clear'").groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_c"))
    return clears.select(*keys, F.size("_c").cast("bigint").alias("clears"), F.posexplode("_c").alias("_p", "_r")).select(
        *keys, "clears", (F.col("_p") + 1).cast("bigint").alias("clear_no"), "_r.*"
    )


def _surface_matrix() -> Column:
    """Where a clear's surface lies: the offset of its tile in the document."""
    return F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("surface_x"), F.col("surface_y"))


def _clear_defs(clears: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    no = _s(F.col("clear_no"))
    x0, y0 = fmt4(F.col("mask_x0")), fmt4(F.col("mask_y0"))
    w = fmt4(F.col("mask_x1") - F.col("mask_x0"))
    h = fmt4(F.col("mask_y1") - F.col("mask_y0"))

    def clip(i: int, d: Column, m: Column) -> Column:
        return _cat(
            '<clipPath id="clear-', no, f'-clip-{i}" clipPathUnits="userSpaceOnUse"><path d="', xml_escape(d),
            '" transform="', m, '"/></clipPath>\n',
        )

    surface = rect_text(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    has_clip = F.col("clip_d").isNotNull()
    clips = _cat(
        clip(0, surface, matrix_text(_surface_matrix())),
        F.when(has_clip, clip(1, F.col("clip_d"), matrix_text(F.col("clip_transform")))).otherwise(""),
    )
    path = _cat('<path d="', xml_escape(F.col("d")), '" transform="', matrix_text(F.col("transform")), '" fill="black"/>')
    inner = _cat('<g clip-path="url(#clear-', no, '-clip-0)">', path, "</g>")
    erase = F.when(has_clip, _cat('<g clip-path="url(#clear-', no, '-clip-1)">', inner, "</g>")).otherwise(inner)
    mask = _cat(
        '<mask id="clear-', no, '" maskUnits="userSpaceOnUse" maskContentUnits="userSpaceOnUse" x="', x0, '" y="', y0,
        '" width="', w, '" height="', h, '" style="mask-type:luminance"><rect x="', x0, '" y="', y0, '" width="', w,
        '" height="', h, '" fill="white"/>', erase, "</mask>\n",
    )
    return clears.join(masks, keys).select(*keys, F.col("clear_no").alias("order_no"), F.concat(clips, mask).alias("_t"))


_DEFS = ("<defs>\n", "</defs>\n")
_SVG_TAIL = "\n    </g>\n  </g>\n</svg>"


def _svg_parts(
    table: DataFrame, docs: DataFrame, keys: list[str], removed_ids: DataFrame | None, removed_colors: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents with ``head`` and ``artwork``, the texts that open them; rows of their masks; rows of their layers."""
    kept = kept_paints(table, keys, removed_ids, removed_colors)
    placed = _placed(docs, kept, keys)
    n = _s(F.col("kind_index"))
    shape = _cat(
        '    <path id="shape-', n, '" d="', xml_escape(F.col("d")), '" fill="', xml_escape(F.col("paint")),
        '" fill-rule="', xml_escape(F.col("fill_rule")), '" transform="', matrix_text(F.col("transform")), '"/>\n',
    )
    stroke = _cat(
        '    <path id="gap-filler-', n, '" d="', xml_escape(F.col("d")), '" fill="none" stroke="', xml_escape(F.col("paint")),
        '" stroke-width="', fmt4(F.col("line_width")), '" transform="', matrix_text(F.col("transform")), '"/>\n',
    )
    paints = kept.where("kind <> 'clear'").select(
        *keys, "order_no", F.when(F.col("kind") == "shape", shape).otherwise(stroke).alias("_t")
    )
    clears = stage(_numbered_clears(table, keys), "clears")
    closings = clears.select(*keys, "order_no", F.lit("</g>\n").alias("_t"))
    openings = clears.select(
        *keys, (-F.col("clear_no")).alias("order_no"), _cat('<g mask="url(#clear-', _s(F.col("clear_no")), ')">\n').alias("_t")
    )
    layers = paints.unionByName(closings).unionByName(openings)
    cleared = clears.select(*keys).distinct()
    masked = table.join(cleared, keys, "left_semi")
    sizes = docs.select(*keys, "width", "height").join(cleared, keys, "left_semi")
    defs = _clear_defs(clears, sg.clear_mask_bounds(masked, sizes, keys), keys)
    w, h = _s(F.col("art_width")), _s(F.col("art_height"))
    background = F.when(F.col("transparent_background"), "").otherwise(
        _cat(
            '  <g id="background" aria-label="Background">\n    <rect id="background-color" width="', w, '" height="', h,
            '" fill="', xml_escape(_background()), '"/>\n  </g>\n',
        )
    )
    head = _cat(
        '<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="', w,
        '" height="', h, '" viewBox="0 0 ', w, " ", h, '" color-interpolation="sRGB">\n  <title>Editable vector artwork</title>\n',
        background,
    )
    artwork = _cat(
        '  <g id="artwork-transform" aria-label="Artwork transform" transform="translate(', fmt4(F.col("fit.ox")), " ",
        fmt4(F.col("fit.oy")), ") scale(", fmt4(F.col("fit.s")), ')">\n    <g id="artwork" aria-label="Artwork">\n',
    )
    return placed.withColumns({"head": head, "artwork": artwork}), defs, layers


def svg_documents(
    table: DataFrame,
    docs: DataFrame,
    keys: list[str],
    removed_ids: DataFrame | None = None,
    removed_colors: DataFrame | None = None,
) -> DataFrame:
    """One SVG text per document: keys, svg, art_width, art_height, art_ratio.

    ``table`` is a paint table, ``docs`` has keys, width, height and the export
    settings.  A partial clear masks everything before it: the groups of all
    clears open at the start, the last one outermost, and each closes where its
    clear was.
    """
    placed, defs, layers = _svg_parts(table, docs, keys, removed_ids, removed_colors)
    layers = _joined(layers, keys, ["order_no"], "_t", "layers")
    whole = placed.join(layers, keys, "left").join(_joined(defs, keys, ["order_no"], "_t", "clear_defs"), keys, "left")
    with_defs = F.when(F.col("clear_defs").isNull(), "").otherwise(_cat(_DEFS[0], F.col("clear_defs"), _DEFS[1]))
    svg = _cat(F.col("head"), with_defs, F.col("artwork"), F.coalesce("layers", F.lit("")), _SVG_TAIL)
    return whole.select(*keys, svg.alias("svg"), "art_width", "art_height", "art_ratio")


def svg_chunks(
    table: DataFrame,
    docs: DataFrame,
    keys: list[str],
    removed_ids: DataFrame | None = None,
    removed_colors: DataFrame | None = None,
    chunk_chars: int = 2**20,
    block_rows: int | None = None,
) -> DataFrame:
    """The texts of :func:`svg_documents` as chunks (:func:`document_chunks`), for documents too large for one row.

    A document whose text is null has no chunk.
    """
    placed, defs, layers = _svg_parts(table, docs, keys, removed_ids, removed_colors)
    defs = stage(defs, "defs")
    around = lambda t: defs.groupBy(*keys).agg(F.lit(0).alias("order_no"), F.lit(t).alias("_t"))
    frame = placed.select(*keys, "head", "artwork").where("head IS NOT NULL AND artwork IS NOT NULL")
    parts = [F.col("head"), around(_DEFS[0]), defs, around(_DEFS[1]), F.col("artwork"), layers, F.lit(_SVG_TAIL)]
    return document_chunks(_framed(frame, parts, keys), keys, chunk_chars, block_rows)


def _eps_head(title: Column, ox: Column, oy: Column, s: Column) -> Column:
    w, h = _s(F.col("art_width")), _s(F.col("art_height"))
    white = F.struct(*[F.lit(1.0).alias(c) for c in "rgb"])
    rgb = F.coalesce(parse_paint_rgb(_background()), white)
    fill = let(rgb, lambda c: F.concat_ws(" ", fmt4(c["r"]), fmt4(c["g"]), fmt4(c["b"])))
    background = F.when(F.col("transparent_background"), "").otherwise(
        _cat(
            "% Background\ngsave\n", fill, " setrgbcolor\nnewpath 0 0 moveto ", w, " 0 lineto ", w, " ", h,
            " lineto 0 ", h, " lineto closepath fill\ngrestore\n\n",
        )
    )
    fixed = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    return _cat(
        "%!PS-Adobe-3.0 EPSF-3.0\n%%Creator: drawlog\n%%Title: ", title, "\n%%Pages: 1\n%%BoundingBox: 0 0 ", w, " ", h,
        "\n%%HiResBoundingBox: 0.0000 0.0000 ", fixed("art_width"), " ", fixed("art_height"),
        "\n%%LanguageLevel: 3\n%%EndComments\n%%Page: 1 1\nsave\n0 ", h, " translate\n1 -1 scale\n\n", background,
        "% Artwork\ngsave\n", fmt4(ox), " ", fmt4(oy), " translate\n", fmt4(s), " ", fmt4(s), " scale\n",
    )


_EPS_TAIL = "grestore\nrestore\nshowpage\n%%EOF\n"


def _concat_matrix(m: Column) -> Column:
    numbers = F.array_join(F.transform(m, fmt4), " ")
    return _cat("[", numbers, "] concat\n")


def _rgb_line(paint: str) -> Column:
    c = F.col(paint)
    return F.concat_ws(" ", fmt4(c["r"]), fmt4(c["g"]), fmt4(c["b"]))


def _exclusions(clears: DataFrame, keys: list[str]) -> DataFrame:
    """Per document the clipping code of its clears, last clear first.

    A clear that cannot be read keeps its place with an empty text.
    """
    ident = F.expr("array(1D, 0D, 0D, 1D, 0D, 0D)")
    surface = rect_text(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    part = lambda no, d, m: F.struct(F.lit(no).alias("part"), d.alias("d"), m.alias("m"))
    parts = clears.select(
        *keys,
        "clear_no",
        F.explode(
            F.filter(
                F.array(
                    part(1, surface, _surface_matrix()),
                    part(2, F.col("clip_d"), F.coalesce("clip_transform", ident)),
                    part(3, F.col("d"), F.coalesce("transform", ident)),
                ),
                lambda p: p["d"].isNotNull(),
            )
        ).alias("_p"),
    ).select(*keys, "clear_no", "_p.part", "_p.d", "_p.m")
    ps = sg.postscript_texts(parts.where(F.col("d").rlike(r"^\s*($|[Mm])")), "d", "m")
    joined = parts.join(ps.hint("merge"), ["d", "m"], "left")
    text = F.when(F.col("part") < 3, _cat("newpath\n", F.col("ps"), "clip\n")).otherwise(
        _cat("newpath\n", F.col("ps"), "clip\nclippath\n")
    )
    code = joined.groupBy(*keys, "clear_no").agg(
        F.bool_and(F.col("ps").isNotNull()).alias("_ok"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", text.alias("t")))), lambda r: r["t"]), ""
        ).alias("_t"),
    )
    full = F.when(
        F.col("_ok"),
        _cat(
            "% clearRect exclusion\ngsave\n", F.col("_t"),
            "[ {/moveto load} {/lineto load} {/curveto load} {/closepath load} pathforall ] cvx\ngrestore\nnewpath clippath exec eoclip newpath\n",
        ),
    ).otherwise("")
    return (
        code.select(*keys, (-F.col("clear_no")).alias("_o"), F.col("clear_no"), full.alias("_code"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_o", "_code"))).alias("_codes"))
        .select(*keys, F.transform("_codes", lambda r: r["_code"]).alias("exclusions"))
    )


def _eps_parts(
    table: DataFrame, docs: DataFrame, keys: list[str], removed_ids: DataFrame | None, removed_colors: DataFrame | None, title: str
) -> tuple[DataFrame, DataFrame]:
    """Placed documents with ``head``, the text that opens them, and the rows of their paints."""
    kept = stage(kept_paints(table, keys, removed_ids, removed_colors), "kept")
    placed = _placed(docs, kept, keys)
    clears = stage(_numbered_clears(table, keys), "clears")
    codes = _exclusions(clears, keys)
    marks = clears.groupBy(*keys).agg(F.array_sort(F.collect_list("order_no")).alias("_marks"))
    # Texts of documents, clears and paths take far more memory than their written size: never broadcast.
    by_doc = stage(marks.join(codes.hint("merge"), keys), "exclusions")
    ps = sg.postscript_texts(kept.where("kind <> 'clear'"), "d")
    rows = (
        kept.where("kind <> 'clear'")
        .withColumn("_rgb", parse_paint_rgb(F.col("paint")))
        .where("_rgb IS NOT NULL")
        .join(ps.hint("merge"), "d")
        .join(by_doc.hint("merge"), keys, "left")
    )
    later = F.expr(
        "CASE WHEN _marks IS NULL THEN '' ELSE array_join(slice(exclusions, 1, size(filter(_marks, m -> m > order_no))), '') END"
    )
    matrix = F.when(is_identity(F.col("transform")), "").otherwise(_concat_matrix(F.col("transform")))
    paint = F.when(
        F.col("kind") == "shape",
        _cat("newpath\n", F.col("ps"), F.when(F.col("fill_rule") == "evenodd", "eofill\n").otherwise("fill\n")),
    ).otherwise(_cat(fmt4(F.col("line_width")), " setlinewidth\nnewpath\n", F.col("ps"), "stroke\n"))
    block = _cat("gsave\n", later, matrix, _rgb_line("_rgb"), " setrgbcolor\n", paint, "grestore\n")
    fit = F.col("fit")
    name = F.col(title) if title in docs.columns else F.lit("vectorized-result.eps")
    placed = placed.withColumn("head", _eps_head(name, fit["ox"], fit["oy"], fit["s"]))
    return placed, rows.select(*keys, "order_no", block.alias("_t"))


def eps_documents(
    table: DataFrame,
    docs: DataFrame,
    keys: list[str],
    removed_ids: DataFrame | None = None,
    removed_colors: DataFrame | None = None,
    title: str = "filename",
) -> DataFrame:
    """One EPS text per document: keys, eps, art_width, art_height, art_ratio.

    Each paint carries the clears after it as exclusions.  Paints without a
    color or with an unreadable path are left out.
    """
    placed, rows = _eps_parts(table, docs, keys, removed_ids, removed_colors, title)
    body = _joined(rows, keys, ["order_no"], "_t", "_body")
    eps = _cat(F.col("head"), F.coalesce("_body", F.lit("")), _EPS_TAIL)
    return placed.join(body.hint("merge"), keys, "left").select(*keys, eps.alias("eps"), "art_width", "art_height", "art_ratio")


def eps_chunks(
    table: DataFrame,
    docs: DataFrame,
    keys: list[str],
    removed_ids: DataFrame | None = None,
    removed_colors: DataFrame | None = None,
    title: str = "filename",
    chunk_chars: int = 2**20,
    block_rows: int | None = None,
) -> DataFrame:
    """The texts of :func:`eps_documents` as chunks (:func:`document_chunks`), for documents too large for one row.

    A document whose text is null, as one with a null title, has no chunk.
    """
    placed, rows = _eps_parts(table, docs, keys, removed_ids, removed_colors, title)
    frame = placed.select(*keys, "head").where("head IS NOT NULL")
    return document_chunks(_framed(frame, [F.col("head"), rows, F.lit(_EPS_TAIL)], keys), keys, chunk_chars, block_rows)


WARNING = "Warning: the SVG does not pass the stock checks yet."


def document_stats(
    table: DataFrame,
    docs: DataFrame,
    keys: list[str],
    removed_ids: DataFrame | None = None,
    removed_colors: DataFrame | None = None,
) -> DataFrame:
    """Counts after removals, artboard, and the validation of the whole drawing.

    ``docs`` also carries ``errors``.
    """
    kept = kept_paints(table, keys, removed_ids, removed_colors)
    counts = kept.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "shape").alias("_ks"), F.count_if(F.col("kind") == "stroke").alias("_kg")
    )
    valid = stock_validation(table, docs.select(*keys, "errors"), keys)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return (
        with_artboard(docs.drop("errors"))
        .join(valid, keys)
        .join(counts, keys, "left")
        .select(
            *keys,
            zero("_ks").alias("shapes"),
            zero("_kg").alias("gap_fillers"),
            "errors",
            F.struct(
                F.col("art_width").alias("width"),
                F.col("art_height").alias("height"),
                (F.col("art_width") * F.col("art_height")).alias("pixels"),
                F.col("art_ratio").alias("ratio"),
            ).alias("artboard"),
            F.struct("valid", "unsupported_fills", "unsupported_strokes", "has_strokes").alias("stock_validation"),
            F.when(~F.col("valid"), WARNING).alias("error"),
        )
    )


def _asset_fit(assets: DataFrame) -> DataFrame:
    """Captured assets are centered on their own box; sizes are positive by validation."""
    w, h = F.col("width"), F.col("height")
    s = F.least(F.col("art_width") * SAFE_AREA / w, F.col("art_height") * SAFE_AREA / h) * clamp_scale(F.col("artwork_scale"))
    return (
        with_artboard(assets)
        .withColumn("_s", s)
        .withColumns({"_ox": (F.col("art_width") - w * F.col("_s")) / 2.0, "_oy": (F.col("art_height") - h * F.col("_s")) / 2.0})
    )


def wrapped_vector_documents(assets: DataFrame, keys: list[str] | None = None, fmt: str = "svg", title: str = "filename") -> DataFrame:
    """Captured assets as documents: keys, text, art_width, art_height, art_ratio.

    ``assets``: keys, width, height, markup, filename and the export settings.
    SVG puts the markup into the artboard; EPS draws its path elements, and an
    asset whose markup cannot be read becomes an empty page.
    """
    keys = keys or ASSET
    placed = _asset_fit(assets)
    if fmt == "svg":
        w, h = _s(F.col("art_width")), _s(F.col("art_height"))
        background = F.when(F.col("transparent_background"), "").otherwise(
            _cat('  <rect id="background-color" width="', w, '" height="', h, '" fill="', xml_escape(_background()), '"/>\n')
        )
        text = _cat(
            '<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="', w,
            '" height="', h, '" viewBox="0 0 ', w, " ", h, '" color-interpolation="sRGB">\n  <title>Imported SVG artwork</title>\n',
            background, '  <g id="artwork-transform" aria-label="Artwork transform" transform="translate(', fmt4(F.col("_ox")),
            " ", fmt4(F.col("_oy")), ") scale(", fmt4(F.col("_s")), ')">\n', strip(F.col("markup")), "\n  </g>\n</svg>",
        )
        return placed.select(*keys, text.alias("text"), "art_width", "art_height", "art_ratio")
    paths = stage(
        vector_elements(assets, keys).where("tag = 'path' AND NOT hidden AND d IS NOT NULL"), "paths"
    )
    ps = sg.postscript_texts(paths, "d")
    numbers = F.filter(
        F.transform(
            F.split(F.regexp_extract("matrix", r"(?s)^matrix\((.*)\)$", 1), r"[\s,]+"), lambda t: t.try_cast("double")
        ),
        lambda v: v.isNotNull(),
    )
    rows = paths.join(ps, "d").withColumns(
        {
            "_m": numbers,
            "_fill": parse_paint_rgb(F.coalesce("own_fill", F.lit("#000000"))),
            "_stroke": parse_paint_rgb(F.col("own_stroke")),
        }
    )
    has_stroke = F.col("own_stroke").isNotNull()
    inner = lambda t: F.when(has_stroke, t).otherwise("")
    fill = F.when(
        F.col("_fill").isNotNull(),
        _cat(
            _rgb_line("_fill"), " setrgbcolor\nnewpath\n", F.col("ps"), inner("gsave\n"),
            F.when(F.col("fill_rule") == "evenodd", "eofill\n").otherwise("fill\n"), inner("grestore\n"),
        ),
    ).otherwise("")
    width = fmt4(F.coalesce(F.col("stroke_width").try_cast("double"), F.lit(1.0)))
    stroke = F.when(
        F.col("_stroke").isNotNull(),
        _cat(_rgb_line("_stroke"), " setrgbcolor\n", width, " setlinewidth\nnewpath\n", F.col("ps"), "stroke\n"),
    ).otherwise("")
    concat = F.when(F.size("_m") == 6, _concat_matrix(F.col("_m"))).otherwise("")
    blocks = rows.select(*keys, "element_no", _cat("gsave\n", concat, fill, stroke, "grestore\n").alias("_t"))
    body = _joined(blocks, keys, ["element_no"], "_t", "_body")
    name = F.col(title) if title in assets.columns else F.lit("vectorized-result.eps")
    eps = _cat(_eps_head(name, F.col("_ox"), F.col("_oy"), F.col("_s")), F.coalesce("_body", F.lit("")), _EPS_TAIL)
    return placed.join(body, keys, "left").select(*keys, eps.alias("text"), "art_width", "art_height", "art_ratio")
