"""Attribute values of templates as column expressions: numbers, colours, fonts, borders, padding, units, markup in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of a unit (1/96 inch), names of colours, sizes of paper, entities.
UNIT_DXA, UNIT_PT, UNIT_EMU, DXA_EMU = 15.0, 0.75, 9525, 635
MM_DXA, MM_UNIT, PT_UNIT = 1440.0 / 25.4, 96.0 / 25.4, 96.0 / 72.0
X_TOLERANCE, Y_TOLERANCE, GAP_SPLIT = 3.0, 6.0, 30.0
COLORS = {
    "black": "000000", "white": "FFFFFF", "red": "FF0000", "lime": "00FF00", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF", "aqua": "00FFFF",
    "magenta": "FF00FF", "fuchsia": "FF00FF", "silver": "C0C0C0", "gray": "808080", "grey": "808080", "maroon": "800000", "olive": "808000", "green": "008000",
    "purple": "800080", "teal": "008080", "navy": "000080", "orange": "FFA500", "gold": "FFD700", "whitesmoke": "F5F5F5", "gainsboro": "DCDCDC",
    "lightgray": "D3D3D3", "lightgrey": "D3D3D3", "darkgray": "A9A9A9", "darkgrey": "A9A9A9", "beige": "F5F5DC", "ivory": "FFFFF0", "khaki": "F0E68C",
    "lavender": "E6E6FA", "lightblue": "ADD8E6", "lightgreen": "90EE90", "lightyellow": "FFFFE0", "pink": "FFC0CB", "brown": "A52A2A",
    "darkblue": "00008B", "darkgreen": "006400", "darkred": "8B0000",
}
PAPERS = {1: (215.9, 279.4), 5: (215.9, 355.6), 8: (297.0, 420.0), 9: (210.0, 297.0), 11: (148.0, 210.0), 13: (182.0, 257.0)}
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#160;": " "}


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def number(text: Column, default: float | None = 0.0) -> Column:
    """A text as a number; the default where it is missing or unreadable."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def color(text: Column) -> Column:
    """RRGGBB of a colour name, `R,G,B`, `A,R,G,B`, `#RRGGBB` or `#AARRGGBB`; null for transparent, unknown and unreadable values. Channels are held within 0..255."""
    t = F.trim(text)
    names = F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])
    parts = F.split(t, ",")
    read = [F.trim(F.get(parts, F.size(parts) - F.lit(3 - i))).try_cast("int") for i in range(3)]
    held = [F.greatest(F.lit(0), F.least(F.lit(255), c)) for c in read]
    mixed = F.when(read[0].isNotNull() & read[1].isNotNull() & read[2].isNotNull(), F.format_string("%02X%02X%02X", *held))
    return (
        F.when(t.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(F.substring(t, 2, 6)))
        .when(t.rlike("^#[0-9A-Fa-f]{8}$"), F.upper(F.substring(t, 4, 6)))
        .when(F.size(parts).isin(3, 4), mixed)
        .otherwise(names[F.lower(t)])
    )


def color_text(rgb: Column) -> Column:
    """`R, G, B` of RRGGBB."""
    return F.concat_ws(", ", *[F.conv(F.substring(rgb, k, 2), 16, 10) for k in (1, 3, 5)])


def font(text: Column) -> Column:
    """A font text as struct<name, size, bold, italic, underline, strike>; Arial 9 where it says nothing."""
    t = F.coalesce(text, F.lit(""))
    style = F.regexp_extract(t, "style=(.*)$", 1)
    head = F.split(F.regexp_replace(t, "style=.*$", ""), ",")
    name = F.trim(F.get(head, F.lit(0)))
    sizes = F.filter(F.transform(head, lambda x: F.regexp_extract(F.trim(x), r"^([\d.]+)\s*pt$", 1).try_cast("double")), lambda x: x.isNotNull())
    return F.struct(
        F.when(name == "", F.lit("Arial")).otherwise(name).alias("name"), F.coalesce(F.get(sizes, F.lit(0)), F.lit(9.0)).alias("size"),
        style.contains("Bold").alias("bold"), style.contains("Italic").alias("italic"), style.contains("Underline").alias("underline"), style.contains("Strikeout").alias("strike"),
    )


def border(text: Column) -> Column:
    """The sides of a border text as struct<t, r, b, l> of 0 and 1; null where none is named. `All` counts only as the whole value."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    whole = F.trim(text) == "All"
    side = lambda n: F.when(whole | F.array_contains(names, n), 1).otherwise(0)
    sides = F.struct(side("Top").alias("t"), side("Right").alias("r"), side("Bottom").alias("b"), side("Left").alias("l"))
    return F.when(sides["t"] + sides["r"] + sides["b"] + sides["l"] > 0, sides)


def border_text(sides: Column) -> Column:
    """`All`, or the names of the sides in the order left, right, top, bottom; null for none."""
    n = sides["t"] + sides["r"] + sides["b"] + sides["l"]
    listed = F.concat_ws(", ", *[F.when(sides[k] == 1, F.lit(name)) for k, name in (("l", "Left"), ("r", "Right"), ("t", "Top"), ("b", "Bottom"))])
    return F.when(n == 4, F.lit("All")).when(n > 0, listed)


def padding(text: Column) -> Column:
    """Left, top, right and bottom padding; one value stands for all, anything else for 2, 1, 2, 1."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    good = ~F.exists(parts, lambda x: x.isNull())
    usual = F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0), F.lit(1.0))
    return F.when(good & (F.size(parts) == 4), parts).when(good & (F.size(parts) == 1), F.array_repeat(parts[0], 4)).otherwise(usual)


def unescape(text: Column) -> Column:
    """Entities replaced one after another in the order of the table."""
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def without_tags(text: Column) -> Column:
    """Text without tags: breaks become line ends, entities their signs."""
    return unescape(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\r\n"), "<[^>]+>", ""))


def markup_enabled() -> Column:
    """Whether a node's flags say that its text is HTML."""
    return F.coalesce(F.lower(attr("HtmlTags")) == "true", F.lit(False)) | F.coalesce(attr("TextRenderType").isin("HtmlTags", "HtmlParagraph"), F.lit(False))


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def device_color(parts: list[Column]) -> Column:
    """RRGGBB of one grey, three RGB or four CMYK shares from 0 to 1, cut off rather than rounded."""
    if len(parts) == 4:
        parts = [(1 - c) * (1 - parts[3]) for c in parts[:3]]
    whole = [F.greatest(F.lit(0), F.least(F.lit(255), (c * 255).cast("int"))) for c in parts]
    return F.format_string("%02X%02X%02X", *(whole * 3 if len(whole) == 1 else whole))


def units_of_mm(mm: Column) -> Column:
    return mm * F.lit(96.0) / F.lit(25.4)


def units_of_pt(pt: Column) -> Column:
    return pt * F.lit(96.0) / F.lit(72.0)


def dxa_of_mm(mm: Column) -> Column:
    """Twentieths of a point, rounded half to even."""
    return F.rint(mm * F.lit(1440.0) / F.lit(25.4)).cast("int")
