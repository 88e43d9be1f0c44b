"""Documents as templates: blocks of paragraphs, tables, pictures and placed text to the XML of a report template."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folium.functions import fonts, inline
from folium.functions.inline import number_text as num
from folium.functions.values import MM_UNIT, PT_UNIT
from folium.sources import text

RUN = inline.RUN
SIDES = "struct<t:int,r:int,b:int,l:int>"
CELL = f"struct<runs:array<{RUN}>,colspan:int,rowspan:int,align:string,valign:string,borders:{SIDES},border_color:string,border_width:double,fill:string>"
MODEL = f"doc_id string, sec_no int, part string, block int, kind string, align string, valign string, indent double, before double, after double, line_height double, x double, y double, width double, height double, runs array<{RUN}>, cols array<double>, rows array<struct<height:double,cells:array<{CELL}>>>, borders {SIDES}, border_color string, border_width double, fill string, image binary"
SECTIONS = "doc_id string, sec_no int, width double, height double, landscape boolean, left double, right double, top double, bottom double"

# The usual page and font of a document, the padding of a cell, the height of a line in sizes, the gap of bands.
A4 = (210.0 * MM_UNIT, 297.0 * MM_UNIT)
MARGINS = {"left": 20.0 * MM_UNIT, "right": 15.0 * MM_UNIT, "top": 15.0 * MM_UNIT, "bottom": 15.0 * MM_UNIT}
FACE, SIZE, PADDING, LINE, BAND_GAP, LEAST = "Times New Roman", 11.0, 4.0, 1.18, 4.0, 10.0
USUAL = {"doc_id": None, "sec_no": 0, "width": A4[0], "height": A4[1], "landscape": False} | MARGINS
BANDS = (("header", "PageHeaderBand", "PageHeader"), ("body", "DataBand", "Data"), ("footer", "PageFooterBand", "PageFooter"))


def text_of(runs: list[dict] | None) -> str:
    return "".join(r.get("text") or "" for r in runs or ())


def height_of(runs: list[dict] | None, width: float, font: dict, indent: float = 0.0) -> float:
    """The height in units that runs take at a width, wrapped by the metrics of their common font."""
    size = font["size"] or SIZE
    room = max(max((width - PADDING) / PT_UNIT, 1.0) - indent / PT_UNIT, 1.0)
    lines = sum(len(fonts.wrap(t, font["name"], size, room, font["bold"], font["italic"])) for t in text_of(runs).split("\n"))
    return lines * size * LINE * PT_UNIT


def color_text(rgb: str) -> str:
    return ", ".join(str(int(rgb[k : k + 2], 16)) for k in (0, 2, 4))


class Report:
    """The elements of one template under way."""

    def __init__(self):
        self.root = ET.Element("Report", {"ScriptLanguage": "CSharp", "ReportInfo.Creator": "folium"})
        ET.SubElement(self.root, "Dictionary")
        self.counts: Counter = Counter()
        self.warnings: list[str] = []

    def add(self, parent: ET.Element, tag: str, prefix: str, **attrs) -> ET.Element:
        """An element named Prefix1, Prefix2, ...; attributes without a value are left out."""
        self.counts[prefix] += 1
        said = {k.replace("__", "."): num(v) if isinstance(v, float) else v for k, v in attrs.items() if v is not None}
        return ET.SubElement(parent, tag, {"Name": f"{prefix}{self.counts[prefix]}"} | said)

    def section(self, sec: dict, parts: dict[str, list[dict]]) -> None:
        wide, high = sec["width"] / MM_UNIT, sec["height"] / MM_UNIT
        flat = bool(sec["landscape"])
        margins = {f"{k.title()}Margin": sec[k] / MM_UNIT for k in MARGINS}
        page = self.add(self.root, "ReportPage", "Page", Landscape="true" if flat else None, PaperWidth=high if flat else wide, PaperHeight=wide if flat else high, **margins)
        width, top = sec["width"] - sec["left"] - sec["right"], 0.0
        for part, tag, prefix in BANDS:
            if part != "body" and not parts.get(part):
                continue
            band = self.add(page, tag, prefix, Top=top if part != "header" else None, Width=width, CanGrow="true" if part == "body" else None)
            height = self.blocks(band, parts.get(part, []), width)
            band.set("Height", num(max(height, LEAST) if part == "body" else height))
            top += height + BAND_GAP

    def blocks(self, band: ET.Element, blocks: list[dict], width: float) -> float:
        """Blocks one under another; returns where the last one ends. Placed text stands where it says."""
        y = 0.0
        for b in blocks:
            if b["kind"] == "space":
                y += b["height"] or 0.0
            elif b["kind"] == "paragraph":
                y += b["before"] or 0.0
                y += self.paragraph(band, b, y, width) + (b["after"] or 0.0)
            elif b["kind"] == "table":
                y += self.table(band, b, y, width)
            elif b["kind"] == "image":
                y += self.image(band, b, y, width)
            elif b["kind"] == "abs":
                self.styled(band, "TextObject", "Text", b, inline.dominant(b["runs"] or [], FACE, SIZE), Left=b["x"], Top=b["y"], Width=b["width"], Height=b["height"], CanGrow="true")
                y = max(y, b["y"] + b["height"])
            else:
                self.warnings.append(f"block {b['kind']} is left out")
        return y

    def styled(self, parent: ET.Element, tag: str, prefix: str, b: dict, font: dict, **attrs) -> ET.Element:
        """An element with text: plain in one font, or as markup where its runs differ from it."""
        runs = b["runs"] or []
        marked = inline.differ(runs, font)
        sides = [name for k, name in (("l", "Left"), ("r", "Right"), ("t", "Top"), ("b", "Bottom")) if (b.get("borders") or {}).get(k)]
        line, wide = b.get("border_color") or "000000", b.get("border_width") or 1.0
        return self.add(
            parent, tag, prefix, **attrs, Font=inline.font_text(font), Border__Lines=("All" if len(sides) == 4 else ", ".join(sides)) or None,
            Border__Color=color_text(line) if sides and line != "000000" else None, Border__Width=float(wide) if sides and abs(wide - 1.0) > 0.01 else None,
            HorzAlign=b["align"] if b.get("align") not in (None, "Left") else None, VertAlign=b["valign"] if b.get("valign") not in (None, "Top") else None,
            Fill__Color=color_text(b["fill"]) if b.get("fill") else None, TextRenderType="HtmlTags" if marked else None,
            Text=inline.html_of([runs]) if marked else text_of(runs).replace("\n", "\r\n"),
        )

    def paragraph(self, band: ET.Element, b: dict, y: float, width: float) -> float:
        font = inline.dominant(b["runs"] or [], FACE, SIZE)
        indent = b["indent"] or 0.0
        height = height_of(b["runs"], width, font, indent)
        self.styled(band, "TextObject", "Text", b, font, Left="0", Top=y, Width=width, Height=height, CanGrow="true", ParagraphOffset=indent or None, LineHeight=b["line_height"] or None)
        return height

    def image(self, band: ET.Element, b: dict, y: float, width: float) -> float:
        free = max(width - b["width"], 0.0)
        left = free / 2 if b["align"] == "Center" else free if b["align"] == "Right" else 0.0
        self.add(band, "PictureObject", "Picture", Left=left, Top=y, Width=b["width"], Height=b["height"], SizeMode="Stretch", Image=base64.b64encode(b["image"] or b"").decode())
        return b["height"]

    def table(self, band: ET.Element, b: dict, y: float, width: float) -> float:
        cols = [float(c) for c in b["cols"] or ()] or [width]
        scale = min(1.0, width / sum(cols)) if sum(cols) else 1.0
        cols = [c * scale for c in cols]
        table = self.add(band, "TableObject", "Table", Left="0", Top=y, Width=sum(cols))
        for c in cols:
            self.add(table, "TableColumn", "Column", Width=c)
        total = 0.0
        for row in b["rows"] or ():
            line = self.add(table, "TableRow", "Row")
            height, at = row["height"] or 0.0, 0
            for cell in row["cells"]:
                wide, high = max(1, cell["colspan"] or 1), max(1, cell["rowspan"] or 1)
                font = inline.dominant(cell["runs"] or [], FACE, SIZE)
                height = max(height, height_of(cell["runs"], sum(cols[at : at + wide]) or cols[-1], font))
                self.styled(line, "TableCell", "Cell", cell, font, ColSpan=str(wide) if wide > 1 else None, RowSpan=str(high) if high > 1 else None)
                at += wide
            line.set("Height", num(height))
            line.set("AutoSize", "true")
            total += height
        table.set("Height", num(total))
        return total

    def xml(self) -> str:
        ET.indent(self.root)
        return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(self.root, encoding="unicode") + "\n"


def report_of(sections: list[dict], blocks: list[dict]) -> tuple[str, list[str]]:
    """The XML of a document, and what it leaves out. Sections without blocks keep their page; blocks of sections that aren't given get the usual page."""
    made = Report()
    given = {s["sec_no"]: s for s in sections}
    for no in sorted({*given, *(b["sec_no"] for b in blocks)} or {0}):
        parts: dict[str, list[dict]] = {}
        for b in blocks:
            if b["sec_no"] == no:
                parts.setdefault(b["part"], []).append(b)
        made.section(given.get(no, USUAL), parts)
    return made.xml(), made.warnings


def templates(blocks: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """doc_id, xml and warnings of each document: one template each.

    blocks: the columns of MODEL, in order of sec_no, part and block; sections: those
    of SECTIONS (lengths in units). Documents are read one after another from sorted
    partitions. Nulls stand for the usual value; an empty input gives no rows.
    """
    spark = blocks.sparkSession
    model = spark.createDataFrame([], MODEL)
    names = model.columns
    rows = blocks.select(*names).withColumn("sec_no", F.coalesce("sec_no", F.lit(0))).withColumn("part", F.coalesce("part", F.lit("body")))
    if sections is None:
        rows = rows.withColumn("page", F.lit(None).cast(f"array<struct<{','.join(c.replace(' ', ':', 1) for c in SECTIONS.split(', ')[1:])}>>"))
    else:
        own = sections.groupBy("doc_id").agg(F.collect_list(F.struct(*[c.split()[0] for c in SECTIONS.split(", ")[1:]])).alias("page"))
        rows = rows.join(own, "doc_id", "left").select(*names, "page")
    arrow = to_arrow_schema(spark.createDataFrame([], "doc_id string, xml string, warnings array<string>").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (dict(zip([*names, "page"], r)) for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(len(names) + 1))))
        for doc_id, group in groupby(every, key=lambda r: r["doc_id"]):
            own_ = list(group)
            xml, warnings = report_of([USUAL | {k: v for k, v in s.items() if v is not None} for s in own_[0]["page"] or ()], own_)
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "xml": xml, "warnings": warnings}], arrow)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "sec_no", "part", "block").mapInArrow(run, "doc_id string, xml string, warnings array<string>")


def _model(blocks: DataFrame, **columns: Column) -> DataFrame:
    shape = blocks.sparkSession.createDataFrame([], MODEL).schema
    usual = {"sec_no": F.lit(0), "part": F.lit("body"), "doc_id": F.col("doc_id").cast("string"), "block": F.col("block").cast("int")}
    return blocks.select(*[(columns | {k: v for k, v in usual.items() if k not in columns}).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def _run(text_: Column, size: Column | None = None, **flags: Column) -> Column:
    kinds = {"size": "double", "face": "string", "color": "string"}
    return F.struct(text_.alias("text"), *[flags.get(k, F.lit(False)).alias(k) for k in ("bold", "italic", "underline", "strike", "sub", "sup")], *[(size if k == "size" and size is not None else flags.get(k, F.lit(None))).cast(t).alias(k) for k, t in kinds.items()])


def _cell(runs: Column, colspan: Column | None = None, rowspan: Column | None = None, align: Column | None = None, fill: Column | None = None, on: str = "trbl") -> Column:
    one = F.lit(1)
    sides = F.struct(*[F.lit(int(k in on)).alias(k) for k in "trbl"])
    return F.struct(runs.alias("runs"), (one if colspan is None else colspan).alias("colspan"), (one if rowspan is None else rowspan).alias("rowspan"), (F.lit("Left") if align is None else align).alias("align"), F.lit("Top").alias("valign"), sides.alias("borders"), F.lit("000000").alias("border_color"), F.lit(1.0).alias("border_width"), (F.lit(None) if fill is None else fill).cast("string").alias("fill"))


def of_plain(blocks: DataFrame) -> DataFrame:
    """Blocks of flow.plain_blocks as a document."""
    return _model(blocks, kind=F.lit("paragraph"), align=F.col("align"), runs=F.array(_run(F.regexp_replace("text", "\r\n|\r", "\n"))))


def of_markdown(blocks: DataFrame) -> DataFrame:
    """Blocks of text.markdown_blocks as a document; a rule is a table of one cell with a line above, tables fill the page, their heads are bold on grey."""
    pt, mm = PT_UNIT, MM_UNIT
    kind = F.col("kind")
    runs = F.transform("runs", lambda r: _run(r["text"], size=r["size"], bold=r["bold"], italic=r["italic"], strike=r["strike"], face=F.when(r["code"], F.lit("Courier New"))))
    head = lambda i: i == 0
    rows = F.transform("rows", lambda row, i: F.struct(F.lit(0.0).alias("height"), F.transform(row, lambda c: _cell(F.array(_run(c, size=F.lit(text.BODY), bold=head(i))), align=F.when(head(i), "Center").otherwise("Left"), fill=F.when(head(i), "EFEFEF"))).alias("cells")))
    line = F.array(F.struct(F.lit(10 * pt).alias("height"), F.array(_cell(F.array(_run(F.lit(""), size=F.lit(1.0))), on="t")).alias("cells")))
    width, n = F.lit(170 * mm), F.size(F.col("rows")[0])
    return _model(
        blocks, kind=F.when(kind.isin("table", "rule"), "table").otherwise("paragraph"), align=F.col("align"), runs=runs, rows=F.when(kind == "rule", line).otherwise(rows),
        cols=F.when(kind == "rule", F.array(width)).when(kind == "table", F.array_repeat(width / n, n)), indent=F.when(kind == "quote", 10 * mm).otherwise(0.0),
        before=F.when(kind == "heading", 10 * pt).otherwise(0.0), after=F.when(kind == "item", 2 * pt).otherwise(6 * pt),
    )


def of_word(blocks: DataFrame) -> DataFrame:
    """Blocks of docx.read as a document; pictures and unreadable files are left out."""
    shown = blocks.where("kind in ('paragraph', 'table')")
    full = lambda rs: F.transform(rs, lambda r: _run(r["text"], size=r["size"], bold=r["bold"], italic=r["italic"], underline=r["underline"], strike=r["strike"], face=r["face"], color=r["color"]))
    last = F.array_max(F.transform("cells", lambda c: c["row"]))
    row = lambda i: F.struct(F.lit(0.0).alias("height"), F.transform(F.array_sort(F.filter("cells", lambda c: c["row"] == i), lambda a, b: a["col"] - b["col"]), lambda c: _cell(full(c["runs"]), c["col_span"], c["row_span"])).alias("cells"))
    rows = F.when((F.col("kind") == "table") & (F.size("cells") > 0), F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), row))
    return _model(shown, kind=F.col("kind"), align=F.col("align"), indent=F.col("indent"), runs=full("runs"), cols=F.col("cols"), rows=rows)
