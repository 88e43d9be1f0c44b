import json

import pytest

from folium.operators import inlining as L
from folium.plans import report_tables as R
from folium.runtime import cut

SHAPE = "rec_id bigint, received_at timestamp, payload string, element string"
T0 = "2024-01-01 00:00:00"


def frame(spark, rows):
    import datetime

    return spark.createDataFrame([(r, datetime.datetime(2024, 1, d), p, "clash") for r, d, p in rows], SHAPE)


def table(name, cells, **more):
    return {"Type": "TableObject", "Name": name, "Rows": [{"Name": "R", "Cells": cells}], **more}


def report(*objects, band="B1"):
    return {"Report": {"Name": "X", "Pages": [{"Name": "P", "Watermark": {"Text": "w", "Font": {"Size": 3}}, "Bands": {"Name": band, "Objects": list(objects)}}]}}


def test_found_over_shapes(spark):
    nested = table("Inner", {"Name": "c2"})
    plain = report(table("T", [{"Name": "c1", "ColSpan": "2", "Objects": nested}, {"Name": "c3", "Text": {"Lines": ["a", "b"]}}], Columns={"Name": "K", "Width": "1.5"}))
    rows = [
        (1, 1, json.dumps(plain)),
        (1, 2, json.dumps(plain)[:-9]),  # sent again, cut off
        (2, 1, json.dumps({"body": json.dumps(plain)})),  # wrapped
        (3, 1, "{"),
        (4, 1, None),
        (5, 1, "[]"),
    ]
    got = {tuple(r) for r in R.found(frame(spark, rows)).collect()}
    one = {("T", 1, 1, "B1"), ("T", 1, 2, "B1"), ("Inner", 1, 1, "c1")}
    assert got == {(r, *x) for r in (1, 2) for x in one}


def test_stray_scalars_do_not_hide_tables(spark):
    good = report(table("T", [{"Name": "c1", "Text": {"Lines": ["a"]}}]))
    good["Report"]["Pages"][0]["Bands"] = {"Name": "B1", "Body": {"Objects": good["Report"]["Pages"][0]["Bands"]["Objects"]}}
    stray = [report({"Type": "TableObject", "Name": "U", "Rows": ""}), report({"Type": "TableObject", "Name": "V", "Rows": [{"Cells": 0}]}), report(table("W", [{"Name": "c", "Text": "t", "Objects": "-"}])), {"Report": {"Pages": "none"}}, {"Report": {"Pages": [{"Bands": {"Name": "B", "Body": 7, "Objects": "x"}}]}}]
    rows = [(k, 1, json.dumps(p)) for k, p in enumerate([good, *stray])]
    assert {tuple(r) for r in R.found(frame(spark, rows)).collect()} == {(0, "T", 1, 1, "B1"), (3, "W", 1, 1, "B1")}
    flat = R.flatten(frame(spark, rows)).collect()
    assert {r.rec_id: r.fields["Rows"] for r in flat if "Rows" in r.fields} == {1: ""} and [r.fields["Cells"] for r in flat if "Cells" in r.fields] == ["0"]


def test_types_and_links(spark):
    data = frame(spark, [(1, 1, json.dumps(report(table("T", [{"Name": "c", "ColSpan": "x", "RowSpan": 2, "Text": None}], Width="9", Columns=[{"Name": "a", "Width": "7.5"}, {"Name": "b", "Width": None}]))))])
    df = cut(R.flatten(data))
    cell = R.typed(data, R.CELLS).collect()[0]
    assert (cell.col_span, cell.row_span, cell.text, cell.row_no, cell.cell_no, cell.table_name) == (None, 2, None, 1, 1, "T")
    assert [r.width for r in R.typed(data, R.COLUMNS).orderBy("column_no").collect()] == [7.5, None]
    ids = {(r.element, r.row_id) for r in df.collect()}
    assert all((r.parent_element, r.parent_id) in ids for r in df.collect() if r.parent_id)
    page = df.where("element = 'Pages'").collect()[0].fields
    assert page["Watermark.Text"] == "w" and page["Watermark.Font.Size"] == "3"  # inlined
    page, band, obj, tab, line = (R.typed(data, t).collect()[0] for t in (R.PAGES, R.BANDS, R.OBJECTS, R.TABLES, R.LINES))
    assert (page.report_name, page.page_no, page.page_name, page.watermark_size) == ("X", 1, "P", 3.0)
    assert (band.parent_element, band.parent_id, band.page_id, band.band_name) == ("Pages", page.page_id, page.page_id, "B1")
    assert (obj.object_type, obj.band_id, obj.object_name, obj.width) == ("TableObject", band.band_id, "T", 9.0)
    assert (tab.table_id, tab.parent_id, tab.parent_name, line.table_id, cell.line_id) == (obj.object_id, band.band_id, "B1", tab.table_id, line.line_id)


def test_nothing_is_dropped(spark):
    """Wrappings of any depth, several reports in one payload, lists in lists, and records too deep for the stock reader."""
    one = lambda name: report(table(name, [{"Name": "c"}]))
    far = one("Far")
    for _ in range(12):
        far = {"w": [far]}
    strings = json.dumps(one("S"))
    for _ in range(8):
        strings = json.dumps({"s": strings})
    two = {"Report": [one("A")["Report"], [one("B")["Report"]]]}
    lists = report(table("L", [[{"Name": "c1"}, {"Name": "c2"}], {"Name": "c3"}]))
    tables = report([[table("M", [{"Name": "c"}])]])
    n = 30_000
    deep = '{"Report": {"Pages": {"Bands": ' + '{"Name": "b", "Bands": [' * n + json.dumps({"Name": "last", "Objects": table("D", [{"Name": "c"}])}) + "]}" * n + "}}}"
    shapes = [json.dumps(far), strings, json.dumps(two), json.dumps(lists), json.dumps(tables), deep, json.dumps({"Report": json.dumps(one("I")["Report"])}), json.dumps([one("P"), one("Q")])]
    got = {(r.rec_id, r.table_name, r.row_no, r.cell_no, r.parent_name) for r in R.found(frame(spark, [(k, 1, p) for k, p in enumerate(shapes)])).collect()}
    assert got == {(0, "Far", 1, 1, "B1"), (1, "S", 1, 1, "B1"), (2, "A", 1, 1, "B1"), (2, "B", 1, 1, "B1"), (3, "L", 1, 1, "B1"), (3, "L", 1, 2, "B1"), (3, "L", 1, 3, "B1"), (4, "M", 1, 1, "B1"), (5, "D", 1, 1, "last"), (6, "I", 1, 1, "B1"), (7, "P", 1, 1, "B1"), (7, "Q", 1, 1, "B1")}


def test_empty_and_deep(spark):
    assert R.found(frame(spark, [])).count() == 0
    inner = {"Name": "last", "Objects": [table("T", [{"Name": "c"}])]}
    for k in range(60):
        inner = {"Name": f"b{k}", "Bands": [inner]}
    deep = {"Report": {"Pages": {"Bands": inner}}}
    assert [tuple(r) for r in R.found(frame(spark, [(9, 1, json.dumps(deep))])).collect()] == [(9, "T", 1, 1, "last")]


@pytest.mark.parametrize("facts,tables", [([("edge", "Report", "A", "A"), ("edge", "A", "B", "B")], {"Report"}), ([("edge*", "Report", "A", "A"), ("edge", "A", "A", "A")], {"Report", "A"}), ([("edge", "Report", "A", "A"), ("edge", "A", "C", "C"), ("edge", "Report", "C", "C")], {"Report", "C"})])
def test_design(facts, tables):
    assert set(L.design(facts, "Report").tables) == tables
