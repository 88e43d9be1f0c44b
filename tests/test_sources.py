from folium.sources import docx, text
from folium.streaming import folder


def test_markdown(spark):
    md = "# Kopf\n\nEin **fetter** und *schräger* Text\nweiter\n\n- eins\n2. zwei\n> Zitat\n\n| a | b |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |\n\n---\n"
    df = spark.createDataFrame([(1, md, "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, kind string")
    got = text.markdown_blocks(df).orderBy("block").collect()
    assert [b.kind for b in got] == ["heading", "paragraph", "item", "item", "quote", "table", "rule"]
    assert [(r.text, r.bold, r.italic) for r in got[1].runs] == [("Ein ", False, False), ("fetter", True, False), (" und ", False, False), ("schräger", False, True), (" Text weiter", False, False)]
    assert got[5].rows == [["a", "b"], ["1", ""], ["2", "3"]] and got[2].runs[0].text == "• eins" and got[0].runs[0].size == 18.0
    assert text.markdown_blocks(df.limit(0)).count() == 0


def test_inline_and_decoding():
    assert [r["text"] for r in text.inline("a `x*y*` \\*z\\* ~~w~~")] == ["a ", "x*y*", " *z* ", "w"]
    assert text.decoded("Имя".encode("cp1251")) == "Имя" and text.decoded(b"\xef\xbb\xbfx") == "x"


def test_docx_round_trip(spark, tmp_path):
    run = docx.PLAIN | {"text": "Привет & <мир>\nzwei", "bold": True, "size": 14.0, "color": "0000C0", "face": "Arial"}
    blocks = [{"kind": "paragraph", "align": "Center", "indent": 20.0, "runs": [run, docx.PLAIN | {"text": " x"}]}, {"kind": "table", "cols": [100.0, 50.0], "cells": [{"row": 0, "col": 0, "col_span": 1, "row_span": 2, "runs": [docx.PLAIN | {"text": "a"}]}, {"row": 0, "col": 1, "col_span": 1, "row_span": 1, "runs": []}, {"row": 1, "col": 1, "col_span": 1, "row_span": 1, "runs": [docx.PLAIN | {"text": "b"}]}]}]
    (tmp_path / "a.docx").write_bytes(docx.file_of(blocks))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = docx.read(spark, str(tmp_path))
    got = [r for r in rows.orderBy("block").collect() if r.doc_id.endswith("/a.docx")]
    assert [b.kind for b in got] == ["paragraph", "table", "space"] and [r.kind for r in rows.collect() if r.doc_id.endswith("bad.docx")] == ["error"]
    assert (got[0].align, got[0].indent, got[0].runs[0].text, got[0].runs[0].size) == ("Center", 20.0, run["text"], 14.0)
    assert [(c.row, c.col, c.row_span) for c in got[1].cells] == [(0, 0, 2), (0, 1, 1), (1, 1, 1)]
    again = list(docx.blocks_of(docx.documents(rows).collect()[0].content))
    assert again[0]["runs"][0]["text"] == run["text"] and again[1]["cells"][0]["row_span"] == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("eins\n\nzwei", encoding="utf-8")
    q = folder.plain_blocks(spark, str(tmp_path / "in"), "*.txt").writeStream.format("memory").queryName("folium_blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("folium_blocks").collect()) == ["eins", "zwei"]
