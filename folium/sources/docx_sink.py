"""Templates as Word documents: blocks of a grid to tables with borders, fills, fields, links, pictures, headers and footers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from folium.functions import pictures
from folium.functions.values import DXA_EMU, UNIT_DXA
from folium.operators.sheets import Sheet, height_of, sheets_of

# Fields that stand for placeholders, names of the format, the height of a paragraph between tables, and the colour of links.
FIELDS = {"[Page]": "PAGE", "[Page#]": "PAGE", "[TotalPages]": "NUMPAGES", "[TotalPages#]": "NUMPAGES"}
FIELD = re.compile(r"(\[(?:Page|TotalPages)#?\])")
ALIGN = {"Left": "left", "Center": "center", "Right": "right", "Justify": "both"}
VALIGN = {"Top": "top", "Center": "center", "Bottom": "bottom"}
TURNED = {90: "btLr", 270: "tbRl"}
STROKES = {"Solid": "single", "Dash": "dashed", "Dot": "dotted", "DashDot": "dotDash", "DashDotDot": "dotDotDash", "Double": "double"}
SIDES = (("t", "top"), ("l", "left"), ("b", "bottom"), ("r", "right"))
GAP, LINK, COLUMN_SPACE = 20, "0563C1", 425
SPACES = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture", "v": "urn:schemas-microsoft-com:vml"}
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


class Part:
    """One part of the package with its relations; pictures are shared by all parts."""

    def __init__(self, media: dict[bytes, str]):
        self.media, self.links = media, {}

    def relation(self, kind: str, target: str, outside: bool = False) -> str:
        return self.links.setdefault((kind, target, outside), f"rId{len(self.links) + 1}")

    def relations(self) -> str:
        rows = "".join(f'<Relationship Id="{i}" Type="{KIND}{kind}" Target={quoteattr(target)}{" TargetMode=" + chr(34) + "External" + chr(34) if outside else ""}/>' for (kind, target, outside), i in self.links.items())
        return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'

    # --- runs and paragraphs

    def run_props(self, run: dict, base: dict, color: str | None) -> str:
        either = lambda k: bool(run.get(k) or base.get(k))
        face = quoteattr(run.get("face") or base["name"])
        size = round((run.get("size") or base["size"]) * 2)
        color = run.get("color") or color
        flags = "".join(f"<w:{tag}/>" for tag, key in (("b", "bold"), ("i", "italic"), ("strike", "strike")) if either(key))
        lift = "subscript" if run.get("sub") else "superscript" if run.get("sup") else ""
        return (
            f"<w:rPr><w:rFonts w:ascii={face} w:hAnsi={face} w:eastAsia={face} w:cs={face}/>{flags}" + (f'<w:color w:val="{color}"/>' if color else "")
            + f'<w:sz w:val="{size}"/><w:szCs w:val="{size}"/>' + ('<w:u w:val="single"/>' if either("underline") else "") + (f'<w:vertAlign w:val="{lift}"/>' if lift else "") + "</w:rPr>"
        )

    def text_run(self, text: str, props: str) -> str:
        return f'<w:r>{props}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""

    def fragment(self, run: dict, rect: dict) -> str:
        """A run: a link where the object has one, else text with fields for the numbers of pages."""
        text, base = run.get("text") or "", rect["font"]
        if rect.get("url"):
            props = self.run_props(run | {"underline": True, "color": run.get("color") or LINK}, base, None)
            return f'<w:hyperlink r:id="{self.relation("hyperlink", rect["url"], True)}">{self.text_run(text, props)}</w:hyperlink>'
        props = self.run_props(run, base, rect.get("color"))
        return "".join(f'<w:fldSimple w:instr=" {FIELDS[t]} ">{self.text_run("1", props)}</w:fldSimple>' if t in FIELDS else self.text_run(t, props) for t in FIELD.split(text))

    def picture(self, rect: dict) -> str:
        """A picture in line, no larger than it should be."""
        data = bytes(rect["image"])
        name = self.media.setdefault(data, f"image{len(self.media) + 1}.{'jpeg' if data[:2] == bytes([255, 216]) else 'bmp' if data[:2] == b'BM' else 'png'}")
        wide, high = (max(1, round((rect[k] or rect[o]) * UNIT_DXA * DXA_EMU)) for k, o in (("image_w", "w"), ("image_h", "h")))
        no = len(self.links) + 1
        return (
            f'<w:r><w:drawing><wp:inline><wp:extent cx="{wide}" cy="{high}"/><wp:docPr id="{no}" name="{name}"/><a:graphic><a:graphicData uri="{SPACES["pic"]}"><pic:pic><pic:nvPicPr><pic:cNvPr id="{no}" name="{name}"/><pic:cNvPicPr/></pic:nvPicPr>'
            f'<pic:blipFill><a:blip r:embed="{self.relation("image", "media/" + name)}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{wide}" cy="{high}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )

    def paragraph(self, body: str, align: str = "Left", indent: float = 0.0, line: float | None = None, after: int = 0, exact: int | None = None, mark: int | None = None) -> str:
        spacing = f'<w:spacing w:before="0" w:after="{after}"' + (f' w:line="{exact}" w:lineRule="exact"' if exact else f' w:line="{round(line * UNIT_DXA)}" w:lineRule="exact"' if line else "") + "/>"
        ind = f'<w:ind w:firstLine="{round(indent * UNIT_DXA)}"/>' if indent else ""
        size = f'<w:rPr><w:sz w:val="{mark * 2}"/><w:szCs w:val="{mark * 2}"/></w:rPr>' if mark else ""
        return f'<w:p><w:pPr>{spacing}{ind}<w:jc w:val="{ALIGN.get(align, "left")}"/>{size}</w:pPr>{body}</w:p>'

    def gap(self, height: float = 0.0) -> str:
        """A paragraph as low as can be, and what else there is of a gap as space after it."""
        return self.paragraph("", after=max(0, int(height * UNIT_DXA) - GAP), exact=GAP, mark=1)

    # --- tables

    def filled(self, rect: dict) -> str:
        if rect["image"]:
            return self.paragraph(self.picture(rect), rect["align"])
        lines = rect["runs"] or [[{"text": t}] for t in re.split(r"\r\n|\r|\n", rect["text"])]
        return "".join(self.paragraph("".join(self.fragment(r, rect) for r in line), rect["align"], rect["indent"] if k == 0 or rect["align"] != "Center" else 0.0, rect["line_height"], mark=None if any(r.get("text") for r in line) else max(1, round(rect["font"]["size"]))) for k, line in enumerate(lines or [[]]))

    def cell_props(self, rect: dict) -> str:
        strokes = "".join(
            f'<w:{name} w:val="{STROKES.get(rect["brd_style"], "single")}" w:sz="{max(2, round((rect["brd_w"][k] or 1.0) * 6))}" w:space="0" w:color="{rect["brd_color"]}"/>' if rect["brd"][k] else f'<w:{name} w:val="nil"/>'
            for k, name in SIDES
        )
        pad = rect["pad"] or [40 / UNIT_DXA, 0.0, 40 / UNIT_DXA, 0.0]
        margins = "".join(f'<w:{side} w:w="{max(0, round(pad[k] * UNIT_DXA))}" w:type="dxa"/>' for side, k in (("top", 1), ("left", 0), ("bottom", 3), ("right", 2)))
        fill = f'<w:shd w:val="clear" w:color="auto" w:fill="{rect["fill"]}"/>' if rect["fill"] and rect["fill"] != "FFFFFF" else ""
        turn = f'<w:textDirection w:val="{TURNED[rect["angle"]]}"/>' if rect["angle"] in TURNED and not rect["image"] else ""
        return f'<w:tcBorders>{strokes}</w:tcBorders>{fill}<w:tcMar>{margins}</w:tcMar>{turn}<w:vAlign w:val="{VALIGN.get(rect["valign"], "top")}"/>'

    def table(self, block: dict, warnings: list[str]) -> str:
        cols = [round(w * UNIT_DXA) for w in block["cols"]]
        n_rows, n_cols = len(block["row_heights"]), len(cols)
        owner: dict[tuple[int, int], dict] = {}
        for c in block["cells"]:
            if (c["row"], c["col"]) in owner:
                if c["rect"]["text"].strip():
                    warnings.append(f"cell {c['rect']['name']} lies within another and is left out")
                continue
            for y in range(c["row"], min(c["row"] + c["row_span"], n_rows)):
                for x in range(c["col"], min(c["col"] + c["col_span"], n_cols)):
                    owner.setdefault((y, x), c)
        rows = []
        for y in range(n_rows):
            made, x = [], 0
            while x < n_cols:
                c, span = owner.get((y, x)), 1
                while c is not None and x + span < n_cols and owner.get((y, x + span)) is c:
                    span += 1
                above = c is not None and owner.get((y - 1, x)) is c
                below = c is not None and owner.get((y + 1, x)) is c
                props = f'<w:tcW w:w="{sum(cols[x : x + span])}" w:type="dxa"/>' + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ("<w:vMerge/>" if above else '<w:vMerge w:val="restart"/>' if below else "")
                body = self.paragraph("", mark=1) if c is None or above else self.filled(c["rect"])
                made.append(f"<w:tc><w:tcPr>{props}{self.cell_props(c['rect']) if c else ''}</w:tcPr>{body}</w:tc>")
                x += span
            rows.append(f'<w:tr><w:trPr><w:trHeight w:val="{max(1, int(block["row_heights"][y] * UNIT_DXA))}" w:hRule="atLeast"/></w:trPr>{"".join(made)}</w:tr>')
        none = "".join(f'<w:{side} w:val="nil"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
        grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in cols)
        return f'<w:tbl><w:tblPr><w:tblW w:w="{sum(cols)}" w:type="dxa"/><w:tblInd w:w="0" w:type="dxa"/><w:tblBorders>{none}</w:tblBorders><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(rows)}</w:tbl>'

    def blocks(self, blocks: list[dict], warnings: list[str]) -> str:
        """Blocks one under another, with a gap after a table that another table or the end follows."""
        after = [*(b["kind"] for b in blocks[1:]), "table"]
        return "".join(self.gap(b["h"]) if b["kind"] == "spacer" else self.table(b, warnings) + (self.gap() if nxt == "table" else "") for b, nxt in zip(blocks, after))

    def watermark(self, text: str, face: str = "Arial", size: int = 64) -> str:
        wide, high = max(220, int(len(text) * size * 0.7)), int(size * 1.6)
        style = f"position:absolute;width:{wide}pt;height:{high}pt;rotation:315;z-index:-1;mso-position-horizontal:center;mso-position-horizontal-relative:margin;mso-position-vertical:center;mso-position-vertical-relative:margin"
        return f'<w:p><w:r><w:pict><v:rect style="{style}" filled="f" stroked="f"><v:textbox inset="0,0,0,0"><w:txbxContent><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii={quoteattr(face)} w:hAnsi={quoteattr(face)}/><w:color w:val="C0C0C0"/><w:sz w:val="{size * 2}"/></w:rPr><w:t>{escape(text)}</w:t></w:r></w:p></w:txbxContent></v:textbox></v:rect></w:pict></w:r></w:p>'


def file_of(sheets: list[Sheet]) -> tuple[bytes, list[str]]:
    """A `.docx` file with one section for each page, and what it leaves out.

    A header or footer keeps the distance that the margin had, and the margin grows
    by its height, so that the body keeps its own.
    """
    ns = " ".join(f'xmlns:{k}="{u}"' for k, u in SPACES.items())
    media: dict[bytes, str] = {}
    main, files, warnings, types, body = Part(media), {}, [], [], []
    for no, sheet in enumerate(sheets):
        page, margins = sheet.page, dict(sheet.page["margins"])
        refs, away = "", {"header": 708, "footer": 708}
        for kind, blocks, side in (("header", sheet.header, "top"), ("footer", sheet.footer, "bottom")):
            mark = page.get("watermark") if kind == "header" else None
            if not blocks and not mark:
                continue
            part = Part(media)
            text = (part.watermark(mark) if mark else "") + part.blocks(blocks, warnings)
            name = f"{kind}{no + 1}.xml"
            tag = {"header": "hdr", "footer": "ftr"}[kind]
            files[f"word/{name}"] = f"<w:{tag} {ns}>{text or '<w:p/>'}</w:{tag}>"
            files[f"word/_rels/{name}.rels"] = part.relations()
            types.append(f'<Override PartName="/word/{name}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{kind}+xml"/>')
            refs += f'<w:{kind}Reference w:type="default" r:id="{main.relation(kind, name)}"/>'
            if blocks:
                away[kind] = margins[side]
                margins[side] += int(height_of(blocks) * UNIT_DXA)
        flat = ' w:orient="landscape"' if page["width"] > page["height"] else ""
        columns = f'<w:cols w:num="{page["columns"]}" w:space="{COLUMN_SPACE}"/>' if (page.get("columns") or 1) > 1 else ""
        edges = " ".join(f'w:{k}="{margins[k]}"' for k in ("top", "right", "bottom", "left"))
        section = f'<w:sectPr>{refs}<w:type w:val="nextPage"/><w:pgSz w:w="{page["width"]}" w:h="{page["height"]}"{flat}/><w:pgMar {edges} w:header="{away["header"]}" w:footer="{away["footer"]}" w:gutter="0"/>{columns}</w:sectPr>'
        body.append(main.blocks(sheet.body, warnings))
        body.append(section if no == len(sheets) - 1 else f"<w:p><w:pPr>{section}</w:pPr></w:p>")
    main.relation("styles", "styles.xml")
    files["word/document.xml"] = f"<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>"
    files["word/_rels/document.xml.rels"] = main.relations()
    files["word/styles.xml"] = f'<w:styles {ns}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:spacing w:before="0" w:after="0"/></w:pPr><w:rPr><w:rFonts w:ascii="Arial" w:hAnsi="Arial"/><w:sz w:val="18"/></w:rPr></w:style></w:styles>'
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    defaults = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), ("png", "image/png"), ("jpeg", "image/jpeg"), ("bmp", "image/bmp")))
    files["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{defaults}<Override PartName="/word/document.xml" ContentType="{word}document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{word}styles+xml"/>{"".join(types)}</Types>'
    files["_rels/.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{KIND}officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("[Content_Types].xml", *sorted(n for n in files if n[0] != "[")):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + files[name], zipfile.ZIP_DEFLATED)
        for data, name in media.items():
            if pictures.size_of(data) is None:
                warnings.append(f"picture {name} is of no known kind")
            z.writestr(zipfile.ZipInfo(f"word/media/{name}", (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue(), warnings


OUT = pa.schema([("doc_id", pa.string()), ("content", pa.binary()), ("warnings", pa.list_(pa.string()))])


def documents(laid_out: DataFrame) -> DataFrame:
    """doc_id, content (a `.docx` file) and warnings of each template of sheets.laid_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                content, warnings = file_of(sheets_of(r["pages"], r["rects"], r["blocks"]))
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "content": content, "warnings": warnings}], OUT)

    return laid_out.select("doc_id", "pages", "rects", "blocks").mapInArrow(run, "doc_id string, content binary, warnings array<string>")
