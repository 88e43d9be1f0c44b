"""Queries of the layout operators over the driver's tables, each with its SQL.

Geometry comes from the numeric tables: lineitem gives rectangles (a band for each
order), events glyphs (a line for each user), orders strokes; attribute values,
pages and names come from the template tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import barcode as B
from folium.functions import rtf
from folium.functions import values as V
from folium.operators import flow, grid, islands
from folium.runtime import table
from folium.sources import docx, template_xml, text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, d: str, *attrs: str) -> DataFrame:
    """Each node once with the attributes asked for."""
    return table(spark, d, "template_node").select("doc_id", F.col("node_id").cast("int").alias("node_id"), "tag", *[F.col("attrs")[a].alias(a.replace(".", "_")) for a in attrs]).distinct()


def rects(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("band"), F.row_number().over(w).alias("ord"), (10.0 * (F.col("l_partkey") % 60)).alias("x"), (10.0 * (F.col("l_suppkey") % 12)).alias("y"),
        (F.col("l_quantity") * 4.0).alias("w"), (20.0 + 10.0 * (F.col("l_linenumber") % 3)).alias("h"), (F.col("l_returnflag") == "R").alias("bordered"),
    )


RECTS = "(SELECT l_orderkey AS band, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord, 10.0::DOUBLE * (l_partkey % 60) AS x, 10.0::DOUBLE * (l_suppkey % 12) AS y, l_quantity * 4.0::DOUBLE AS w, 20.0::DOUBLE + 10.0::DOUBLE * (l_linenumber % 3) AS h, l_returnflag = 'R' AS bordered FROM lineitem)"


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit(1).alias("page"), F.col("user_id").alias("line"), F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("x"), F.floor(F.col("value") / 50).cast("double").alias("width"), F.lit(10.0).alias("size"), F.col("event_type").alias("style"), F.col("event_id").alias("ord"))


GLYPHS = "(SELECT 1 AS page, user_id AS line, floor(floor(epoch(ts)) / 3600)::DOUBLE AS x, floor(value / 50)::DOUBLE AS width, 10.0::DOUBLE AS size, event_type AS style, event_id AS ord FROM events)"


@query("SELECT DISTINCT doc_id, node_id::INT AS node_id, attrs['TextColor'] AS value, CASE WHEN regexp_full_match(t, '#[0-9A-Fa-f]{6}') THEN upper(substr(t, 2, 6)) WHEN regexp_full_match(t, '#[0-9A-Fa-f]{8}') THEN upper(substr(t, 4, 6)) WHEN len(p) IN (3, 4) THEN CASE WHEN r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL THEN printf('%02X%02X%02X', greatest(0, least(255, r)), greatest(0, least(255, g)), greatest(0, least(255, b))) END ELSE names[lower(t)] END AS rgb FROM (SELECT *, TRY_CAST(trim(p[len(p)-2]) AS INT) AS r, TRY_CAST(trim(p[len(p)-1]) AS INT) AS g, TRY_CAST(trim(p[len(p)]) AS INT) AS b, MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.COLORS.items()) + "} AS names FROM (SELECT *, trim(attrs['TextColor']) AS t, string_split(trim(attrs['TextColor']), ',') AS p FROM template_node WHERE attrs['TextColor'] IS NOT NULL))")
def color_parse(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "TextColor").where("TextColor is not null").select("doc_id", "node_id", F.col("TextColor").alias("value"), V.color(F.col("TextColor")).alias("rgb"))


@query("SELECT p_partkey, concat_ws(', ', (p_partkey % 256)::VARCHAR, (p_size % 256)::VARCHAR, ((p_partkey * 7) % 256)::VARCHAR) AS value FROM part")
def color_format(spark: SparkSession, d: str) -> DataFrame:
    rgb = F.format_string("%02X%02X%02X", (F.col("p_partkey") % 256).cast("int"), (F.col("p_size") % 256).cast("int"), ((F.col("p_partkey") * 7) % 256).cast("int"))
    return table(spark, d, "part").select("p_partkey", V.color_text(rgb).alias("value"))


@query(r"SELECT DISTINCT doc_id, node_id::INT AS node_id, CASE WHEN trim(h[1]) = '' THEN 'Arial' ELSE trim(h[1]) END AS name, coalesce(list_filter(list_transform(h, lambda x: TRY_CAST(regexp_extract(trim(x), '^([0-9.]+)\s*pt$', 1) AS DOUBLE)), lambda x: x IS NOT NULL)[1], 9.0) AS size, contains(s, 'Bold') AS bold, contains(s, 'Italic') AS italic, contains(s, 'Underline') AS underline, contains(s, 'Strikeout') AS strike FROM (SELECT *, regexp_extract(attrs['Font'], 'style=(.*)$', 1) AS s, string_split(regexp_replace(attrs['Font'], 'style=.*$', ''), ',') AS h FROM template_node WHERE attrs['Font'] IS NOT NULL)")
def font_parse(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "Font").where("Font is not null").withColumn("f", V.font(F.col("Font"))).select("doc_id", "node_id", "f.*")


_SIDES = "list_transform(string_split(attrs['Border.Lines'], ','), lambda x: trim(x))"
_SIDE = "(CASE WHEN trim(attrs['Border.Lines']) = 'All' OR list_contains(s, '{}') THEN 1 ELSE 0 END)"


@query(f"SELECT DISTINCT doc_id, node_id::INT AS node_id, {_SIDE.format('Top')} AS t, {_SIDE.format('Right')} AS r, {_SIDE.format('Bottom')} AS b, {_SIDE.format('Left')} AS l FROM (SELECT *, {_SIDES} AS s FROM template_node WHERE attrs['Border.Lines'] IS NOT NULL)")
def border_flags(spark: SparkSession, d: str) -> DataFrame:
    sides = nodes(spark, d, "Border.Lines").where("Border_Lines is not null").withColumn("s", V.border(F.col("Border_Lines")))
    return sides.select("doc_id", "node_id", *[F.coalesce(F.col(f"s.{k}"), F.lit(0)).alias(k) for k in "trbl"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN t + r + b + l = 4 THEN 'All' WHEN t + r + b + l > 0 THEN concat_ws(', ', CASE WHEN l = 1 THEN 'Left' END, CASE WHEN r = 1 THEN 'Right' END, CASE WHEN t = 1 THEN 'Top' END, CASE WHEN b = 1 THEN 'Bottom' END) END AS value FROM (SELECT *, l_partkey % 2 AS t, l_suppkey % 2 AS r, l_linenumber % 2 AS b, l_orderkey % 2 AS l FROM lineitem)")
def border_text(spark: SparkSession, d: str) -> DataFrame:
    sides = F.struct(*[(F.col(c) % 2).cast("int").alias(k) for c, k in (("l_partkey", "t"), ("l_suppkey", "r"), ("l_linenumber", "b"), ("l_orderkey", "l"))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.border_text(sides).alias("value"))


@query("SELECT DISTINCT doc_id, node_id::INT AS node_id, CASE WHEN good AND len(p) = 4 THEN p WHEN good AND len(p) = 1 THEN [p[1], p[1], p[1], p[1]] ELSE [2.0, 1.0, 2.0, 1.0]::DOUBLE[] END AS sides FROM (SELECT *, len(list_filter(p, lambda x: x IS NULL)) = 0 AS good FROM (SELECT *, list_transform(string_split(attrs['Padding'], ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS p FROM template_node WHERE attrs['Padding'] IS NOT NULL))")
def padding_parse(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "Padding").where("Padding is not null").select("doc_id", "node_id", V.padding(F.col("Padding")).alias("sides"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 96.0::DOUBLE / 25.4::DOUBLE AS units_mm, l_quantity * 96.0::DOUBLE / 72.0::DOUBLE AS units_pt, l_extendedprice / 9525.0::DOUBLE AS units_emu, l_extendedprice / 15.0::DOUBLE AS units_dxa FROM lineitem")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.units_of_mm(F.col("l_quantity")).alias("units_mm"), V.units_of_pt(F.col("l_quantity")).alias("units_pt"), (F.col("l_extendedprice") / V.UNIT_EMU).alias("units_emu"), (F.col("l_extendedprice") / V.UNIT_DXA).alias("units_dxa"))


def _unescaped(sql: str) -> str:
    for name, sign in V.ENTITIES.items():
        sql = f"replace({sql}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return sql


@query(r"SELECT DISTINCT doc_id, node_id::INT AS node_id, " + _unescaped(r"regexp_replace(regexp_replace(attrs['Text'], '(?i)<br\s*/?>', chr(13) || chr(10), 'g'), '<[^>]+>', '', 'g')") + " AS plain FROM template_node WHERE tag = 'TextObject' AND attrs['Text'] IS NOT NULL AND (coalesce(lower(attrs['HtmlTags']) = 'true', false) OR coalesce(attrs['TextRenderType'] IN ('HtmlTags', 'HtmlParagraph'), false))")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "template_node").where(F.col("tag") == "TextObject").where(F.col("attrs")["Text"].isNotNull() & V.markup_enabled())
    return t.select("doc_id", F.col("node_id").cast("int").alias("node_id"), V.without_tags(F.col("attrs")["Text"]).alias("plain")).distinct()


@query(r"SELECT doc_id, len(regexp_split_to_array(text, '\r\n|\r|\n'))::INT AS n_lines FROM documents WHERE text IS NOT NULL")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(V.lines(F.col("text"))).alias("n_lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%02X%02X%02X', (trunc(l_discount * 255))::INT, (trunc(l_tax * 255))::INT, (trunc(l_quantity / 50 * 255))::INT) AS rgb, printf('%02X%02X%02X', (trunc(l_tax * 255))::INT, (trunc(l_tax * 255))::INT, (trunc(l_tax * 255))::INT) AS grey FROM lineitem")
def device_color(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.device_color([c("l_discount"), c("l_tax"), c("l_quantity") / 50]).alias("rgb"), V.device_color([c("l_tax")]).alias("grey"))


def _paper(side: int) -> str:
    return "CASE coalesce(raw_paper_size, 9) " + " ".join(f"WHEN {k} THEN {v[side]}" for k, v in V.PAPERS.items()) + f" ELSE {V.PAPERS[9][side]} END::DOUBLE"


def _dxa(sql: str) -> str:
    return f"round_even({sql} * 1440.0::DOUBLE / 25.4::DOUBLE, 0)::INT"


_SIZES = [_dxa(f"coalesce({n}, {_paper(k)})") for k, n in ((0, "paper_width"), (1, "paper_height"))]
_MARGINS = ", ".join(f"{_dxa(f'coalesce({s}_margin, 10.0)')} AS {s}_dxa" for s in ("left", "right", "top", "bottom"))


@query(f"SELECT doc_id, page_no, CASE WHEN coalesce(landscape, false) THEN {_SIZES[1]} ELSE {_SIZES[0]} END AS width, CASE WHEN coalesce(landscape, false) THEN {_SIZES[0]} ELSE {_SIZES[1]} END AS height, {_MARGINS} FROM report_page")
def page_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "report_page")
    paper = lambda side: F.coalesce(F.create_map(*[F.lit(x) for k, v in V.PAPERS.items() for x in (k, v[side])])[F.coalesce("raw_paper_size", F.lit(9))], F.lit(V.PAPERS[9][side]))
    w, h = V.dxa_of_mm(F.coalesce("paper_width", paper(0))), V.dxa_of_mm(F.coalesce("paper_height", paper(1)))
    flat = F.coalesce("landscape", F.lit(False))
    margins = [V.dxa_of_mm(F.coalesce(f"{s}_margin", F.lit(10.0))).alias(f"{s}_dxa") for s in ("left", "right", "top", "bottom")]
    return p.select("doc_id", "page_no", F.when(flat, h).otherwise(w).alias("width"), F.when(flat, w).otherwise(h).alias("height"), *margins)


@query(f"SELECT band, max(x + w) AS width FROM {RECTS} WHERE w > 0.5 AND h > 0.5 GROUP BY band")
def band_width(spark: SparkSession, d: str) -> DataFrame:
    return grid.band_width(grid.visible(rects(spark, d)), 0.0)


@query(f"SELECT band, list_reduce(list_prepend([]::DOUBLE[], list_transform(list_sort(list(x)), lambda v: [v])), lambda acc, v: CASE WHEN len(acc) > 0 AND v[1] - acc[-1] <= 15.0 THEN acc ELSE list_append(acc, v[1]) END) AS grid FROM {RECTS} GROUP BY band")
def grid_snap(spark: SparkSession, d: str) -> DataFrame:
    return rects(spark, d).groupBy("band").agg(grid.snapped(F.collect_list("x"), 15.0).alias("grid"))


@query(f"SELECT a.band, a.ord, a.x, a.y, a.w, a.h, a.bordered, coalesce(min(b.x) - any_value(a.x), any_value(a.w)) AS clip_w FROM {RECTS} a LEFT JOIN {RECTS} b ON a.band = b.band AND a.ord <> b.ord AND NOT a.bordered AND b.x > a.x + 1 AND b.x < a.x + a.w AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= a.h * 0.5 GROUP BY a.band, a.ord, a.x, a.y, a.w, a.h, a.bordered")
def clip_overlap(spark: SparkSession, d: str) -> DataFrame:
    return grid.clipped(rects(spark, d))


@query(f"SELECT a.band, a.ord AS inner_ord, b.ord AS outer_ord FROM {RECTS} a JOIN {RECTS} b ON a.band = b.band AND a.ord <> b.ord AND a.w * a.h < b.w * b.h AND greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) >= 0.7 * a.w * a.h")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return grid.overlaps(rects(spark, d))


@query(f"SELECT band, ord, x, y, w, h, bordered FROM {RECTS} WHERE w > 0.5 AND h > 0.5")
def rect_filter(spark: SparkSession, d: str) -> DataFrame:
    return grid.visible(rects(spark, d))


@query()
def gridify_blocks(spark: SparkSession, d: str) -> DataFrame:
    boxes = grid.visible(rects(spark, d))
    return grid.gridded(boxes.join(grid.band_width(boxes, 0.0), "band"), ["band"])[0]


@query(f"SELECT page, line, x, width, size, style, ord, CAST(sum(s) OVER (PARTITION BY page, line ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM (SELECT *, CASE WHEN x - max(x + width) OVER (PARTITION BY page, line ORDER BY x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1.2 * size THEN 1 ELSE 0 END AS s FROM {GLYPHS})")
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return islands.segments(glyphs(spark, d))


@query(f"SELECT *, coalesce(x - lag(x + width) OVER (PARTITION BY page, line ORDER BY x, ord) > 0.16 * size, false) AS space_before FROM {GLYPHS}")
def run_spacing(spark: SparkSession, d: str) -> DataFrame:
    return islands.spaces(glyphs(spark, d))


@query(f"SELECT line, run, style, string_agg(ord::VARCHAR, '' ORDER BY ord) AS text, count(*) AS n FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY line ORDER BY ord ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM (SELECT *, CASE WHEN lag(ord) OVER w IS NOT NULL AND style IS DISTINCT FROM lag(style) OVER w THEN 1 ELSE 0 END AS s FROM {GLYPHS} WINDOW w AS (PARTITION BY line ORDER BY ord))) GROUP BY line, run, style")
def run_merge(spark: SparkSession, d: str) -> DataFrame:
    return islands.runs(glyphs(spark, d).withColumn("text", F.col("ord").cast("string")), ["line"], "ord", "style", "text")


@query("SELECT grp, axis, color, rule, min(start) AS start, max(stop) AS stop, count(*) AS n FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY grp, axis, color ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS INT) AS rule FROM (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY grp, axis, color ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.2 THEN 1 ELSE 0 END AS s FROM (SELECT o_custkey AS grp, 0.0::DOUBLE AS axis, o_orderstatus AS color, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS start, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE + 200.0 AS stop FROM orders))) GROUP BY ALL")
def rule_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.lit(0.0).alias("axis"), F.col("o_orderstatus").alias("color"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("start"), F.lit(200.0).alias("length"))
    return islands.rules(o)


@query("SELECT doc_id, arg_max(style, {w: w, o: -o}) AS style FROM (SELECT doc_id, Font AS style, sum(length(Text) + 1) AS w, min(node_id) AS o FROM (SELECT DISTINCT doc_id, node_id::INT AS node_id, attrs['Font'] AS Font, attrs['Text'] AS Text FROM template_node) WHERE Font IS NOT NULL AND Text IS NOT NULL GROUP BY doc_id, Font) GROUP BY doc_id")
def dominant_style(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d, "Font", "Text").where("Font is not null and Text is not null")
    return islands.dominant(t.withColumnRenamed("Font", "style"), ["doc_id"], "style", "Text", "node_id")


@query(r"SELECT doc_id, (generate_subscripts(b, 1) - 1)::INT AS block, unnest(b) AS text, CASE WHEN length(unnest(b)) > 200 THEN 'Justify' ELSE 'Left' END AS align FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n'), lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ')), lambda x: x <> '') AS b FROM documents WHERE text <> '')")
def plain_blocks(spark: SparkSession, d: str) -> DataFrame:
    return flow.plain_blocks(table(spark, d, "documents")).select("doc_id", "block", "text", "align")


_STACK = r"(SELECT doc_id, (generate_subscripts(b, 1) - 1)::INT AS block, unnest(b) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n'), lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ')), lambda x: x <> '') AS b FROM documents WHERE text <> ''))"


@query(f"SELECT doc_id, block, height, coalesce(sum(height + 8.0) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top FROM (SELECT doc_id, block, ceil(length(text) / 80.0) * 16.0::DOUBLE AS height FROM {_STACK})")
def stack_heights(spark: SparkSession, d: str) -> DataFrame:
    b = flow.plain_blocks(table(spark, d, "documents")).select("doc_id", "block", F.lit(0.0).alias("before"), (F.ceil(F.length("text") / 80.0) * 16.0).cast("double").alias("height"), F.lit(8.0).alias("after"))
    return islands.stacked(b, "doc_id", "block").select("doc_id", "block", "height", "top")


@query()
def wrap_lines(spark: SparkSession, d: str) -> DataFrame:
    return flow.wrapped(flow.plain_blocks(table(spark, d, "documents")), 11.0, 480.0)


@query()
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return flow.paginated(flow.measured(flow.plain_blocks(table(spark, d, "documents")), 11.0, 480.0), 700.0)


@query(r"SELECT doc_id, line, CASE WHEN regexp_full_match(t, '\s*') THEN 'blank' WHEN regexp_matches(t, '^#{1,6}\s+.*$') THEN 'heading' WHEN regexp_matches(t, '^\s*(-\s*(-\s*){2,}|\*\s*(\*\s*){2,}|_\s*(_\s*){2,})$') THEN 'rule' WHEN contains(t, '|') AND regexp_matches(coalesce(n, ''), '^\s*\|?[\s:-]*-[\s:|-]*\|?\s*$') AND contains(coalesce(n, ''), '|') THEN 'table' WHEN regexp_matches(t, '^\s*([-*+]|\d+[.)])\s+.*$') THEN 'list' WHEN regexp_matches(t, '^\s*>') THEN 'quote' ELSE 'text' END AS kind FROM (SELECT doc_id, line, t, lead(t) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS line, unnest(l) AS t FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents WHERE source = 'md' AND text <> '')))")
def md_line_class(spark: SparkSession, d: str) -> DataFrame:
    return flow.line_classes(table(spark, d, "documents").where("source = 'md'")).select("doc_id", "line", "kind")


def _lookup(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_EAN13 = "(SELECT p_partkey, k || ((10 - (list_sum(list_transform(range(1, 13), lambda i: substr(k, i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10)) % 10)::INT::VARCHAR AS k FROM (SELECT p_partkey, lpad((p_partkey * 7919 + 400000000000)::VARCHAR, 12, '0') AS k FROM part))"


@query(f"SELECT p_partkey, '101' || array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN substr({_lookup(B.PARITY)}[substr(k, 1, 1)::INT + 1], i, 1) = 'L' THEN {_lookup(B.LEFT)}[substr(k, i + 1, 1)::INT + 1] ELSE {_lookup(B.EVEN)}[substr(k, i + 1, 1)::INT + 1] END), '') || '01010' || array_to_string(list_transform(range(8, 14), lambda i: {_lookup(B.RIGHT)}[substr(k, i, 1)::INT + 1]), '') || '101' AS bars FROM {_EAN13}")
def ean13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", B.ean13(F.lpad((F.col("p_partkey") * 7919 + 400000000000).cast("string"), 12, "0")).alias("bars"))


@query(f"SELECT p_partkey, '101' || array_to_string(list_transform(range(1, 5), lambda i: {_lookup(B.LEFT)}[substr(k, i, 1)::INT + 1]), '') || '01010' || array_to_string(list_transform(range(5, 9), lambda i: {_lookup(B.RIGHT)}[substr(k, i, 1)::INT + 1]), '') || '101' AS bars FROM (SELECT p_partkey, k || ((10 - (list_sum(list_transform(range(1, 8), lambda i: substr(k, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10)) % 10)::INT::VARCHAR AS k FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 7, '0') AS k FROM part))")
def ean8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", B.ean8(F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("bars"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split('*' || upper(p_brand) || '*', ''), lambda c: coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in B.CODE39.items()) + "}[c], '" + B.CODE39["-"] + "')), '0') AS bars FROM part")
def code39(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", B.code39(F.col("p_brand")).alias("bars"))


@query(f"SELECT o_orderkey, '1010' || array_to_string(list_transform(range(1, (length(k) // 2) + 1), lambda i: array_to_string(list_transform(range(1, 6), lambda j: CASE WHEN substr({_lookup(B.WIDE)}[substr(k, 2 * i - 1, 1)::INT + 1], j, 1) = '1' THEN '11' ELSE '1' END || CASE WHEN substr({_lookup(B.WIDE)}[substr(k, 2 * i, 1)::INT + 1], j, 1) = '1' THEN '00' ELSE '0' END), '')), '') || '11101' AS bars FROM (SELECT o_orderkey, CASE WHEN length(o_orderkey::VARCHAR) % 2 = 1 THEN '0' || o_orderkey::VARCHAR ELSE o_orderkey::VARCHAR END AS k FROM orders)")
def itf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", B.interleaved25(F.col("o_orderkey").cast("string")).alias("bars"))


@query("SELECT doc_id, node_id, tag, tag || row_number() OVER (PARTITION BY doc_id, tag ORDER BY node_id)::VARCHAR AS name FROM (SELECT DISTINCT doc_id, node_id::INT AS node_id, tag FROM template_node)")
def names_rank(spark: SparkSession, d: str) -> DataFrame:
    return islands.named(nodes(spark, d), "doc_id", "tag", "node_id").select("doc_id", "node_id", "tag", "name")


@query("SELECT doc_id, target, CASE WHEN n = 1 THEN target ELSE target || '-' || n::VARCHAR END AS unique_target FROM (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY doc_id) AS n FROM (SELECT doc_id, coalesce(source, '') || '/' || coalesce(form_code, '') AS target FROM documents))")
def unique_targets(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("form_code", F.lit(""))).alias("target"))
    return islands.unique_targets(jobs, "target", "doc_id")


@query("SELECT user_id, event_type, first, place, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS place, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type)) WHERE place <= 5")
def warnings_top5(spark: SparkSession, d: str) -> DataFrame:
    return islands.first_warnings(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query(r"SELECT DISTINCT doc_id, node_id::INT AS node_id, attrs['Text'] AS text, TRY_CAST(attrs['Left'] AS DOUBLE) * 0.75::DOUBLE AS left_pt FROM template_node WHERE tag = 'TextObject' AND length(attrs['Text']) >= 10 AND NOT contains(attrs['Text'], '[') AND regexp_matches(attrs['Text'], '\S\s+\S') AND coalesce(attrs['HorzAlign'], 'Left') IN ('Left', 'Justify') AND coalesce(TRY_CAST(attrs['ParagraphOffset'] AS DOUBLE), 0) = 0 AND TRY_CAST(attrs['Left'] AS DOUBLE) >= 0")
def caption_filter(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "Text", "Left", "HorzAlign", "ParagraphOffset").where("tag = 'TextObject'")
    left = F.col("Left").try_cast("double")
    keep = (F.length("Text") >= 10) & ~F.col("Text").contains("[") & F.col("Text").rlike(r"\S\s+\S") & F.coalesce("HorzAlign", F.lit("Left")).isin("Left", "Justify") & (F.coalesce(F.col("ParagraphOffset").try_cast("double"), F.lit(0.0)) == 0) & (left >= 0)
    return n.where(keep).select("doc_id", "node_id", F.col("Text").alias("text"), (left * V.UNIT_PT).alias("left_pt"))


@query("SELECT l_returnflag, count(*) AS n, median(l_quantity - l_linenumber) AS median, max(l_quantity - l_linenumber) AS worst, count_if(l_quantity - l_linenumber > 3) AS tail FROM lineitem GROUP BY l_returnflag")
def delta_stats(spark: SparkSession, d: str) -> DataFrame:
    delta = F.col("l_quantity") - F.col("l_linenumber")
    return islands.offsets(table(spark, d, "lineitem").select("l_returnflag", delta.alias("delta")), "l_returnflag", "delta", 3.0)


@query()
def rtf_plain(spark: SparkSession, d: str) -> DataFrame:
    """The plain text of every rich text object."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rtf.rtf_text(t) if rtf.is_rtf(t) else t)

    return nodes(spark, d, "Text").where("tag = 'RichObject' and Text is not null").select("doc_id", "node_id", plain("Text").alias("plain"))


@query()
def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    return text.markdown_blocks(table(spark, d, "documents").where("source = 'md'"))


@query("SELECT doc_id, count(*) AS n_nodes, count(CASE WHEN tag = 'TextObject' THEN 1 END) AS n_texts, sum(len(map_keys(attrs)))::BIGINT AS n_attrs, sum(list_sum(list_transform(map_values(attrs), lambda v: length(v))))::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id, node_id, tag, attrs FROM template_node) GROUP BY doc_id")
def template_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Templates written as XML and read again: how many nodes, text objects, attributes and characters in them each has."""
    n = table(spark, d, "template_node").select("doc_id", "node_id", "parent_id", "ord", "tag", "attrs", "text")
    made = template_xml.documents(n)

    def again(batches):
        for pdf in batches:
            rows = [template_xml.rows_of(i, x.encode()) for i, x in zip(pdf["doc_id"], pdf["xml"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_nodes": [len(r) for r in rows], "n_texts": [sum(n[5] == "TextObject" for n in r) for r in rows], "n_attrs": [sum(len(n[6]) for n in r) for r in rows], "n_chars": [sum(len(v) for n in r for v in n[6].values()) for r in rows]})

    return made.mapInPandas(again, "doc_id string, n_nodes bigint, n_texts bigint, n_attrs bigint, n_chars bigint")


@query(f"SELECT doc_id::VARCHAR AS doc_id, count(*) AS n_blocks, sum(length(replace(text, chr(13) || chr(10), chr(10)))) AS n_chars FROM {_STACK} GROUP BY doc_id")
def docx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as `.docx` files and read again: their paragraphs and characters."""
    none = F.lit(None)
    run = F.struct(F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"), *[F.lit(False).alias(k) for k in ("bold", "italic", "underline", "strike")], none.cast("double").alias("size"), none.cast("string").alias("face"), none.cast("string").alias("color"))
    blocks = flow.plain_blocks(table(spark, d, "documents")).select(F.col("doc_id").cast("string").alias("doc_id"), "block", F.lit("paragraph").alias("kind"), "align", F.lit(0.0).alias("indent"), F.array(run).alias("runs"), none.cast("array<double>").alias("cols"), none.cast(f"array<{docx.CELL}>").alias("cells"))

    def again(batches):
        for pdf in batches:
            read = [[r["text"] for b in docx.blocks_of(c) for r in b["runs"]] for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_blocks": [len(x) for x in read], "n_chars": [sum(map(len, x)) for x in read]})

    return docx.documents(blocks).mapInPandas(again, "doc_id string, n_blocks bigint, n_chars bigint")
