import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folium.functions import barcode as B
from folium.functions import rtf as R
from folium.functions import values as V
from folium.operators import flow, grid, islands


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize("text,rgb", [("Red", "FF0000"), ("255, 0, 0", "FF0000"), ("255, 255, 0, 0", "FF0000"), ("#FF00FF00", "00FF00"), ("#00FF00", "00FF00"), ("Transparent", None), ("", None), (None, None), ("300, -5, 7", "FF0007"), ("1, 2, x", None)])
def test_color(spark, text, rgb):
    assert one(spark, V.color, text) == rgb


def test_values(spark):
    assert one(spark, V.color_text, "FF8000") == "255, 128, 0"
    f = one(spark, V.font, "Arial, 9pt, style=Bold, Italic")
    assert (f.name, f.size, f.bold, f.italic, f.underline) == ("Arial", 9.0, True, True, False)
    assert one(spark, V.font, None).name == "Arial"
    assert tuple(one(spark, V.border, "All")) == (1, 1, 1, 1)
    assert tuple(one(spark, V.border, "Left, Bottom")) == (0, 0, 1, 1)
    assert one(spark, V.border, "none") is None
    assert one(spark, V.padding, "1, 2, 3, 4") == [1, 2, 3, 4] and one(spark, V.padding, None) == [2, 1, 2, 1] and one(spark, V.padding, "5") == [5, 5, 5, 5]
    assert one(spark, V.unescape, "&amp;lt;") == "<"
    assert one(spark, V.without_tags, "a<BR />b &lt;i&gt;") == "a\r\nb <i>"


def test_barcodes(spark):
    bars = one(spark, B.ean13, "400638133393")
    assert len(bars) == 95 and bars.startswith("101") and bars.endswith("101") and bars == one(spark, B.ean13, "4006381333931")
    assert one(spark, B.ean13, "123") is None and len(one(spark, B.ean8, "1234567")) == 67
    assert one(spark, B.interleaved25, "123") == one(spark, B.interleaved25, "0123")
    assert B.png("101").startswith(b"\x89PNG")


def test_rtf():
    lines, align = R.rtf_lines(R.lines_rtf([[{"text": "Привет {x}", "bold": True, "size": 14, "color": "0000C0"}], [{"text": "b"}]], "Center"))
    assert align == "Center" and lines[0][0]["text"] == "Привет {x}" and lines[0][0]["size"] == 14 and lines[0][0]["color"] == "0000C0" and len(lines) == 2
    text = r"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}\pard \'cf\'f0@1080?\uc0@1074 !\par}".replace("@", "\\u")
    assert R.rtf_text(text) == "Прив!"
    assert R.rtf_text("") == "" and R.rtf_text("{\\rtf1 {{{") == ""


def test_snap(spark):
    df = spark.createDataFrame([([4.0, 0.0, 2.0, 9.0],), ([],)], "v array<double>")
    assert [r.g for r in df.select(grid.snapped(F.col("v"), 3.0).alias("g")).collect()] == [[0.0, 4.0, 9.0], []]


def rects(spark, rows):
    return spark.createDataFrame([Row(band=1, ord=k, x=float(x), y=float(y), w=float(w), h=float(h), bordered=False) for k, (x, y, w, h) in enumerate(rows)])


def test_grid(spark):
    made = lambda rows: grid.gridded(rects(spark, rows).withColumn("width", F.lit(200.0)), ["band"])[0]
    two = made([(0, 0, 100, 20), (100, 0, 100, 20)]).collect()
    assert len(two) == 1 and len(two[0].cols) == 2 and len(two[0].cells) == 2
    parted = made([(0, 0, 100, 20), (0, 100, 100, 20)]).orderBy("block").collect()
    assert [b.kind for b in parted] == ["table", "spacer", "table"]
    assert [(r.inner_ord, r.outer_ord) for r in grid.overlaps(rects(spark, [(0, 0, 200, 100), (20, 20, 40, 20)])).collect()] == [(1, 0)]


def test_segments_match_a_scan(spark):
    rng = random.Random(3)
    rows = [(1, 1, float(rng.randrange(0, 900)), float(rng.randrange(0, 30)), 10.0, k) for k in range(120)]
    got = {r.ord: r.segment for r in islands.segments(spark.createDataFrame(rows, "page int, line int, x double, width double, size double, ord int")).collect()}
    reach, seg = None, -1
    for _, _, x, w, s, o in sorted(rows, key=lambda r: (r[2], r[5])):
        if reach is None or x - reach > 1.2 * s:
            seg += 1
        reach = max(reach or 0.0, x + w) if reach is not None else x + w
        assert got[o] == seg


def test_wrap_and_pages(spark):
    assert flow.wrap("aaa bbb-ccc", 10, 25) == ["aaa", "bbb-", "ccc"]
    assert flow.wrap("x" * 12, 10, 25) == ["xxxxx", "xxxxx", "xx"] and flow.wrap("", 10, 25) == [""]
    sized = spark.createDataFrame([(1, 0, 3, 30.0), (1, 1, 8, 80.0), (1, 2, 30, 300.0)], "doc_id bigint, block int, n_lines int, height double")
    got = [(r.block, r.page, r.first_line, r.end_line) for r in flow.paginated(sized, 100.0).orderBy("page", "top").collect()]
    assert got == [(0, 1, 0, 3), (1, 2, 0, 8), (2, 2, 0, 2), (2, 3, 2, 12), (2, 4, 12, 22), (2, 5, 22, 30)]


def test_unique_targets_of_a_hot_target(spark):
    rows = [(k, "Same" if k % 3 else ("SAME" if k % 2 else f"t{k}"), "x") for k in range(300)]
    got = {r.doc_id: r.unique_target for r in islands.unique_targets(spark.createDataFrame(rows, "doc_id int, target string, n string"), "target", "doc_id").collect()}
    seen: dict = {}
    for k, t, _ in rows:
        seen[t.lower()] = seen.get(t.lower(), 0) + 1
        assert got[k] == (t if seen[t.lower()] == 1 else f"{t}-{seen[t.lower()]}")


def test_offsets_and_inherited(spark):
    import statistics

    values = {"a": [0.125, 3.5, 2.0, 2.0], "b": [1.0], "c": [9.0, 1.0, 4.0]}
    df = spark.createDataFrame([(g, v, "x") for g, vs in values.items() for v in vs], "g string, v double, n string")
    got = {r.g: (r.n, r.median, r.worst, r.tail) for r in islands.offsets(df, "g", "v", 3.0).collect()}
    assert got == {g: (len(vs), statistics.median(vs), max(vs), sum(v > 3 for v in vs)) for g, vs in values.items()}
    chain = [("d", f"s{k}", f"s{k - 1}" if k else None, {"p": f"{k}"} if k % 10 == 0 else {f"q{k}": "x"}) for k in range(40)] + [("d", "lone", "gone", {}), ("d", "c1", "c2", {}), ("d", "c2", "c1", {"z": "1"})]
    done = {r.style: r.props for r in islands.inherited(spark.createDataFrame(chain, "key string, style string, base string, props map<string,string>")).collect()}
    assert done["s39"]["p"] == "30" and len(done["s39"]) == 1 + 36 and done["s0"] == {"p": "0"} and done["lone"] == {} and done["c1"]["z"] == "1"
    assert islands.inherited(spark.createDataFrame([], "key string, style string, base string, props map<string,string>")).count() == 0


def test_duckdb_version():
    assert duckdb.__version__
