"""Paint text to colors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlog.functions.text import let, strip

# Color names known to the exporter, as red, green, blue in 0..1.
EXPORT_NAMES = {
    "black": (0.0, 0.0, 0.0),
    "white": (1.0, 1.0, 1.0),
    "red": (1.0, 0.0, 0.0),
    "lime": (0.0, 1.0, 0.0),
    "green": (0.0, 1.0, 0.0),
    "blue": (0.0, 0.0, 1.0),
    "yellow": (1.0, 1.0, 0.0),
    "cyan": (0.0, 1.0, 1.0),
    "aqua": (0.0, 1.0, 1.0),
    "magenta": (1.0, 0.0, 1.0),
    "fuchsia": (1.0, 0.0, 1.0),
    "gray": (0.5, 0.5, 0.5),
    "grey": (0.5, 0.5, 0.5),
    "silver": (0.75, 0.75, 0.75),
    "maroon": (0.5, 0.0, 0.0),
    "navy": (0.0, 0.0, 0.5),
    "purple": (0.5, 0.0, 0.5),
    "teal": (0.0, 0.5, 0.5),
    "olive": (0.5, 0.5, 0.0),
    "orange": (1.0, 0.647, 0.0),
}

# The named colors of CSS Color Module Level 4.
CSS_NAMES = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4
black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887
cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc
crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9
darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f
darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f
darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3
deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222
floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700
goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4
indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5
lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff
lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1
lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899
lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff
maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db
mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc
mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5
navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500
orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee
palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd
powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1
saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d
silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa
springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347
turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00
yellowgreen 9acd32
"""

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def css_names() -> dict[str, str]:
    words = CSS_NAMES.split()
    return dict(zip(words[::2], words[1::2], strict=True))


def _rgb(r: Column, g: Column, b: Column) -> Column:
    known = r.isNotNull() & g.isNotNull() & b.isNotNull()
    return F.when(known, F.struct(r.alias("r"), g.alias("g"), b.alias("b")))


def _pairs(hex_text: Column) -> list[Column]:
    """The three two-digit channels of a 3, 4, 6 or 8 digit hex text."""
    short = F.length(hex_text).isin(3, 4)
    return [
        F.when(short, F.repeat(F.substring(hex_text, i + 1, 1), 2)).otherwise(F.substring(hex_text, 2 * i + 1, 2))
        for i in range(3)
    ]


def parse_paint_rgb(paint: Column) -> Column:
    """Struct of r, g, b in 0..1.  Null for no paint; unknown words are black."""
    return let(F.lower(strip(paint)), _rgb_of)


def _rgb_of(s: Column) -> Column:
    channel = lambda h: F.when(h.rlike("^[0-9a-f]{2}$"), F.conv(h, 16, 10).cast("double") / 255.0)
    from_hex = let(
        F.substring(s, 2, 1 << 30),
        lambda d: F.when(F.length(d).isin(3, 4, 6, 8), _rgb(*[channel(h) for h in _pairs(d)])),
    )
    inside = F.regexp_replace(F.regexp_replace(s, r"^(rgba)*(rgb)*\(*", ""), r"\)+$", "")

    def component(text: Column) -> Column:
        bare = F.regexp_replace(text, "%+$", "")
        value = F.when(bare.rlike(f"^{_NUMBER}$"), bare.try_cast("double"))
        scaled = value / F.when(text.endswith("%"), 100.0).otherwise(255.0)
        return F.when(scaled.isNotNull(), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)))

    # The components of rgb(...) as numbers; fewer than three make it an unknown word.
    numbers = F.transform(F.transform(F.split(inside, ","), strip), component)
    names = F.create_map(
        *[
            x
            for name, (r, g, b) in EXPORT_NAMES.items()
            for x in (F.lit(name), F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")))
        ]
    )
    black = F.struct(*[F.lit(0.0).alias(c) for c in "rgb"])
    from_rgb = let(
        numbers, lambda v: F.when(F.size(v) >= 3, _rgb(*[F.get(v, F.lit(i)) for i in range(3)])).otherwise(black)
    )
    return (
        F.when(s.isNull() | s.isin("", "none", "transparent"), None)
        .when(s.startswith("#"), from_hex)
        .when(s.startswith("rgb"), from_rgb)
        .otherwise(F.coalesce(F.element_at(names, s), black))
    )


def _hex2(v: Column) -> Column:
    whole = F.floor(F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)) + 0.5).cast("bigint")
    return F.lpad(F.hex(whole), 2, "0")


def normalize_paint_hex(paint: Column) -> Column:
    """Uppercase ``#RRGGBB`` of a CSS color; null for anything that is not one color."""
    found = let(F.lower(strip(paint)), _css_hex)
    return F.concat(F.lit("#"), F.upper(found))


def _css_hex(s: Column) -> Column:
    from_hex = let(
        F.substring(s, 2, 1 << 30),
        lambda d: F.when(
            d.rlike("^([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$"), F.concat(*_pairs(d))
        ),
    )
    parts = F.regexp_extract_all(s, F.lit(rf"({_NUMBER}%?)"), F.lit(1))
    number = lambda text: F.regexp_replace(text, "%$", "").try_cast("double")
    item = rf"{_NUMBER}%?"
    shape = rf"^rgba?\(\s*{item}(\s*,\s*|\s+){item}(\s*,\s*|\s+){item}(\s*[,/]\s*{item})?\s*\)$"
    channels = F.transform(
        parts, lambda t: F.when(t.endswith("%"), number(t) * 255.0 / 100.0).otherwise(number(t))
    )
    hexes = F.array_join(F.slice(F.transform(channels, _hex2), 1, 3), "")
    from_rgb = F.when(s.rlike(shape), hexes)

    hsl = rf"^hsla?\(\s*{_NUMBER}(deg)?(\s*,\s*|\s+){_NUMBER}%(\s*,\s*|\s+){_NUMBER}%(\s*[,/]\s*{item})?\s*\)$"

    def hsl_hex(v: Column) -> Column:
        hue = F.pmod(F.get(v, F.lit(0)), F.lit(360.0))
        sat, light = (F.greatest(F.least(F.get(v, F.lit(i)) / 100.0, F.lit(1.0)), F.lit(0.0)) for i in (1, 2))
        base = F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))

        def channel(p: Column, n: float) -> Column:
            k = F.pmod(F.lit(n) + p["h"] / 30.0, F.lit(12.0))
            reach = p["s"] * F.least(p["l"], 1.0 - p["l"])
            return _hex2((p["l"] - reach * F.greatest(F.least(k - 3.0, 9.0 - k, F.lit(1.0)), F.lit(-1.0))) * 255.0)

        return let(base, lambda p: F.concat(channel(p, 0.0), channel(p, 8.0), channel(p, 4.0)))

    from_hsl = F.when(s.rlike(hsl), let(F.transform(parts, number), hsl_hex))
    named = F.create_map(*[F.lit(x) for kv in css_names().items() for x in kv])
    return (
        F.when(s.startswith("#"), from_hex)
        .when(s.startswith("rgb"), from_rgb)
        .when(s.startswith("hsl"), from_hsl)
        .otherwise(F.element_at(named, s))
    )


def portable_paint(paint: Column) -> Column:
    p = strip(paint)
    return (p != "") & (F.instr(p, "[object Canvas") == 0) & (F.instr(F.lower(p), "url(") == 0)
