"""Word documents: `.docx` files to blocks of runs and tables, and blocks to files, with the standard library alone."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the namespace, alignments, units of a unit.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ALIGN = {"left": "Left", "start": "Left", "right": "Right", "end": "Right", "center": "Center", "both": "Justify", "distribute": "Justify"}
DXA = 15.0
RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,size:double,face:string,color:string>"
CELL = f"struct<row:int,col:int,col_span:int,row_span:int,runs:array<{RUN}>>"
BLOCKS = f"doc_id string, block int, kind string, align string, indent double, runs array<{RUN}>, cols array<double>, cells array<{CELL}>"
KEYS = ("bold", "italic", "underline", "strike", "size", "face", "color")
PLAIN = dict.fromkeys(("bold", "italic", "underline", "strike"), False) | {"size": None, "face": None, "color": None}


def _on(el: ET.Element | None) -> bool | None:
    return None if el is None else el.get(W + "val", "true").lower() not in ("false", "0", "none", "off")


def _style(props: ET.Element | None) -> dict:
    """The properties a run states itself."""
    if props is None:
        return {}
    size, fonts, color = props.find(W + "sz"), props.find(W + "rFonts"), props.find(W + "color")
    said = {"bold": _on(props.find(W + "b")), "italic": _on(props.find(W + "i")), "strike": _on(props.find(W + "strike")), "underline": _on(props.find(W + "u"))}
    if size is not None and (size.get(W + "val") or "").isdigit():
        said["size"] = int(size.get(W + "val")) / 2
    if fonts is not None:
        said["face"] = fonts.get(W + "ascii") or fonts.get(W + "hAnsi")
    if color is not None and (color.get(W + "val") or "auto") != "auto":
        said["color"] = color.get(W + "val").upper()
    return {k: v for k, v in said.items() if v is not None}


def styles_of(root: ET.Element | None) -> dict[str, dict]:
    """Run properties of each paragraph style, with those it is based on (at most 16 steps); "" has the document's own."""
    if root is None:
        return {"": {}}
    base = _style(root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"))
    own, parent = {}, {}
    for s in root.findall(W + "style"):
        key = s.get(W + "styleId", "")
        own[key] = _style(s.find(W + "rPr"))
        above = s.find(W + "basedOn")
        parent[key] = above.get(W + "val") if above is not None else None
    out = {"": base}
    for key in own:
        chain, at = [], key
        while at in own and at not in chain and len(chain) < 16:
            chain.append(at)
            at = parent[at]
        merged = dict(base)
        for k in reversed(chain):
            merged |= own[k]
        out[key] = merged
    return out


def _runs(p: ET.Element, styles: dict[str, dict]) -> list[dict]:
    props = p.find(W + "pPr")
    named = props.find(W + "pStyle") if props is not None else None
    base = PLAIN | styles.get(named.get(W + "val") if named is not None else "", styles[""])
    out: list[dict] = []
    for r in p.iter(W + "r"):
        text = "".join("\t" if x.tag == W + "tab" else "\n" if x.tag in (W + "br", W + "cr") else "‑" if x.tag == W + "noBreakHyphen" else x.text or "" for x in r if x.tag in (W + "t", W + "tab", W + "br", W + "cr", W + "noBreakHyphen"))
        if not text:
            continue
        run = base | _style(r.find(W + "rPr")) | {"text": text}
        if out and all(out[-1][k] == run[k] for k in KEYS):
            out[-1]["text"] += text
        else:
            out.append(run)
    return out


def _number(el: ET.Element | None, name: str, default: float | None = None) -> float | None:
    try:
        return float(el.get(W + name)) if el is not None else default
    except (TypeError, ValueError):
        return default


def _table(tbl: ET.Element, styles: dict[str, dict]) -> dict:
    cols = [_number(g, "w", 0.0) / DXA for g in tbl.findall(f"{W}tblGrid/{W}gridCol")]
    cells: list[dict] = []
    open_cells: dict[int, dict] = {}
    for r, tr in enumerate(tbl.findall(W + "tr")):
        c = 0
        for tc in tr.findall(W + "tc"):
            props = tc.find(W + "tcPr")
            span = int(_number(props.find(W + "gridSpan") if props is not None else None, "val", 1) or 1)
            merge = props.find(W + "vMerge") if props is not None else None
            if merge is not None and merge.get(W + "val", "continue") == "continue" and c in open_cells:
                open_cells[c]["row_span"] += 1
            else:
                runs: list[dict] = []
                for k, p in enumerate(tc.findall(W + "p")):
                    more = _runs(p, styles)
                    if k and runs:
                        runs[-1]["text"] += "\n"
                    runs += more
                cell = {"row": r, "col": c, "col_span": span, "row_span": 1, "runs": runs}
                cells.append(cell)
                open_cells.pop(c, None)
                if merge is not None:
                    open_cells[c] = cell
            c += span
    return {"kind": "table", "cols": cols, "cells": cells}


def blocks_of(raw: bytes) -> Iterator[dict]:
    """Paragraphs, spaces and tables of a document's body in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        styles = styles_of(ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None)
    for el in body if body is not None else ():
        if el.tag == W + "p":
            runs = _runs(el, styles)
            props = el.find(W + "pPr")
            jc, ind = (props.find(W + "jc"), props.find(W + "ind")) if props is not None else (None, None)
            yield {"kind": "paragraph" if runs else "space", "align": ALIGN.get(jc.get(W + "val", "left") if jc is not None else "left", "Left"), "indent": (_number(ind, "firstLine", 0.0) or 0.0) / DXA, "runs": runs}
        elif el.tag == W + "tbl":
            yield _table(el, styles)


def main_part(raw: bytes) -> str:
    """The XML of a file's main part."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return z.read("word/document.xml").decode("utf-8")


def read(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """Blocks of all documents under a path; a file that can't be read gives one block of the kind error with the reason in its run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    found = list(blocks_of(raw))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    found = [{"kind": "error", "runs": [PLAIN | {"text": str(e)}]}]
                out += [(p, k, b["kind"], b.get("align"), b.get("indent"), b.get("runs"), b.get("cols"), b.get("cells")) for k, b in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "block", "kind", "align", "indent", "runs", "cols", "cells"])

    return files.mapInPandas(run, BLOCKS)


def _run_xml(run: dict) -> str:
    props = "".join(f"<w:{tag}/>" for tag, key in (("b", "bold"), ("i", "italic"), ("strike", "strike")) if run.get(key))
    props += '<w:u w:val="single"/>' if run.get("underline") else ""
    props += f'<w:color w:val="{run["color"]}"/>' if run.get("color") else ""
    props += f'<w:sz w:val="{round(run["size"] * 2)}"/>' if run.get("size") else ""
    face = f'<w:rFonts w:ascii="{escape(run["face"], {chr(34): "&quot;"})}" w:hAnsi="{escape(run["face"], {chr(34): "&quot;"})}"/>' if run.get("face") else ""
    parts = (run.get("text") or "").split("\n")
    text = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' if t else "" for t in parts)
    return f"<w:r><w:rPr>{face}{props}</w:rPr>{text}</w:r>"


def _paragraph_xml(runs: list[dict], align: str | None, indent: float | None = None) -> str:
    jc = {"Right": "right", "Center": "center", "Justify": "both"}.get(align or "")
    props = (f'<w:ind w:firstLine="{round(indent * DXA)}"/>' if indent else "") + (f'<w:jc w:val="{jc}"/>' if jc else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(map(_run_xml, runs or []))}</w:p>"


def _table_xml(cols: list[float], cells: list[dict]) -> str:
    rows = 1 + max((c["row"] + c["row_span"] - 1 for c in cells), default=-1)
    at = {(c["row"] + k, c["col"]): (c, k) for c in cells for k in range(c["row_span"])}
    out = []
    for r in range(rows):
        tcs, c = [], 0
        while c < len(cols):
            cell, k = at.get((r, c), (None, 0))
            span = min(cell["col_span"], len(cols) - c) if cell else 1
            props = f'<w:tcW w:w="{round(sum(cols[c : c + span]) * DXA)}" w:type="dxa"/>' + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "")
            props += ("<w:vMerge/>" if k else '<w:vMerge w:val="restart"/>') if cell and cell["row_span"] > 1 else ""
            tcs.append(f"<w:tc><w:tcPr>{props}</w:tcPr>{_paragraph_xml(cell['runs'] if cell and not k else [], None)}</w:tc>")
            c += span
        out.append(f"<w:tr>{''.join(tcs)}</w:tr>")
    grid = "".join(f'<w:gridCol w:w="{round(w * DXA)}"/>' for w in cols)
    return f'<w:tbl><w:tblPr><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(out)}</w:tbl><w:p/>'


def file_of(blocks: list[dict]) -> bytes:
    """A `.docx` file of blocks."""
    body = "".join(_table_xml(list(b["cols"]), list(b["cells"])) if b["kind"] == "table" else _paragraph_xml(b.get("runs"), b.get("align"), b.get("indent")) for b in blocks)
    ns = W[1:-1]
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{ns}"><w:body>{body}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


def documents(blocks: DataFrame) -> DataFrame:
    """doc_id and content (a `.docx` file) of each document; a document is one group, its blocks in order."""

    def plain(x):
        return [r.asDict(recursive=True) if hasattr(r, "asDict") else dict(r) for r in x] if x is not None else []

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for b in pdf.sort_values("block").itertuples():
            cells = [c | {"runs": plain(c["runs"])} for c in plain(b.cells)]
            rows.append({"kind": b.kind, "align": b.align, "indent": None if pd.isna(b.indent) else b.indent, "runs": plain(b.runs), "cols": [] if b.cols is None else list(b.cols), "cells": cells})
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [file_of(rows)]})

    return blocks.where(F.col("kind") != "error").groupBy("doc_id").applyInPandas(build, "doc_id string, content binary")
