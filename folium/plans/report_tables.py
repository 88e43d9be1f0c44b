"""The flat tables of report payloads: pages, bands, objects, tables, rows, columns and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folium.operators import inlining
from folium.operators.inlining import Col, Table

ROOT = "Report"
#: Elements that other tables refer to: they keep a table of their own even where the data at hand has one of each.
KEPT = ("Pages", "Bands", "TableObject", "TextObject", "ContainerObject", "Columns", "Rows", "Cells")
_PARENT = (Col("parent_element", "string", "element", (None,)), Col("parent_id", "int", "row_id", (None,)))
_IN_TABLE = (Col("table_id", "int", "row_id", (("TableObject",),)), Col("table_name", "string", "Name", (("TableObject",),)))


def _is(*names: str):
    return lambda element: element in names


PAGES = Table(_is("Pages"), (Col("page_id", "int", "row_id"), Col("report_id", "int", "row_id", ((ROOT,),)), Col("report_name", "string", "Name", ((ROOT,),)), Col("page_no", "int", "list_no"), Col("page_name", "string", "Name"), Col("watermark_text", "string", "Watermark.Text"), Col("watermark_font", "string", "Watermark.Font.Name"), Col("watermark_size", "double", "Watermark.Font.Size")))
BANDS = Table(_is("Bands"), (Col("band_id", "int", "row_id"), *_PARENT, Col("page_id", "int", "row_id", (("Pages",),)), Col("band_no", "int", "list_no"), Col("band_name", "string", "Name"), Col("height", "double", "Height")))
#: Everything that stands among the objects of a band, container or cell.
OBJECTS = Table(lambda element: element == "Objects" or element.endswith("Object"), (Col("object_id", "int", "row_id"), Col("object_type", "string", "element"), *_PARENT, Col("parent_name", "string", "Name", (None,)), Col("band_id", "int", "row_id", (("Bands",),)), Col("object_no", "int", "list_no"), Col("object_name", "string", "Name"), Col("text", "string", "Text"), Col("width", "double", "Width")))
TABLES = Table(_is("TableObject"), (Col("table_id", "int", "row_id"), *_PARENT, Col("parent_name", "string", "Name", (None,)), Col("table_no", "int", "list_no"), Col("table_name", "string", "Name"), Col("width", "double", "Width")))
LINES = Table(_is("Rows"), (Col("line_id", "int", "row_id"), *_IN_TABLE, Col("row_no", "int", "list_no"), Col("line_name", "string", "Name"), Col("height", "double", "Height")))
COLUMNS = Table(_is("Columns"), (Col("column_id", "int", "row_id"), *_IN_TABLE, Col("column_no", "int", "list_no"), Col("column_name", "string", "Name"), Col("width", "double", "Width")))
CELLS = Table(_is("Cells"), (Col("cell_id", "int", "row_id"), Col("line_id", "int", "row_id", (("Rows",),)), *_IN_TABLE, Col("row_no", "int", "list_no", (("Rows",),)), Col("cell_no", "int", "list_no"), Col("cell_name", "string", "Name"), Col("text", "string", "Text"), Col("col_span", "int", "ColSpan"), Col("row_span", "int", "RowSpan")))


def flatten(payloads: DataFrame) -> DataFrame:
    return inlining.flatten(payloads, ROOT, KEPT)


def typed(payloads: DataFrame, table: Table) -> DataFrame:
    return inlining.typed(payloads, table, ROOT, KEPT)


def found(payloads: DataFrame) -> DataFrame:
    """rec_id, table_name, row_no, cell_no, parent_name of every cell of a table, each once."""
    holder = inlining.Table(_is("Cells"), (Col("held", "string", "element", (("TableObject",),)), *_IN_TABLE[1:], Col("row_no", "int", "list_no", (("Rows",),)), Col("cell_no", "int", "list_no"), Col("parent_name", "string", "Name", (("TableObject",), None))), True)
    return typed(payloads, holder).where("held is not null").drop("held")
