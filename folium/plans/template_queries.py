"""Queries of whole templates and documents: rectangles, grids, Word and PDF files, the way back, and the check of a layout."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import barcode as B
from folium.functions import inline
from folium.functions import values as V
from folium.operators import flow, grid, islands, pdftext, placing, sheets
from folium.runtime import stored_clear, table
from folium.sources import docx, docx_sink, pdf, pdf_sink, template_sink, template_xml, text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "template_node").select("doc_id", "node_id", "parent_id", "ord", "depth", "tag", "attrs", "text")


_NUMBER = "coalesce(TRY_CAST({0} AS DOUBLE), {1}::DOUBLE)"
_ONCE = "(SELECT DISTINCT doc_id, node_id::INT AS node_id, parent_id::INT AS parent_id, tag, attrs FROM template_node)"
_SHOWN = "coalesce(lower({0}.attrs['Visible']) <> 'false', true)"


def _at(key: str, default: str = "0.0") -> str:
    return _NUMBER.format(f"n.attrs['{key}']", default)


@query(
    f"SELECT n.doc_id, n.node_id, CASE b.tag WHEN 'PageHeaderBand' THEN 'header' WHEN 'PageFooterBand' THEN 'footer' ELSE 'body' END AS part, {_at('Left')} AS x, {_at('Top')} AS y, {_at('Width')} AS w, {_at('Height')} AS h "
    f"FROM {_ONCE} n JOIN {_ONCE} b ON n.doc_id = b.doc_id AND n.parent_id = b.node_id JOIN {_ONCE} p ON b.doc_id = p.doc_id AND b.parent_id = p.node_id "
    f"WHERE n.tag IN ('TextObject', 'ShapeObject', 'CheckBoxObject', 'BarcodeObject') AND b.tag LIKE '%Band' AND b.tag <> 'OverlayBand' AND p.tag = 'ReportPage' AND {_SHOWN.format('n')} AND {_SHOWN.format('b')} AND {_SHOWN.format('p')} AND {_at('Width')} > 0.5 AND {_at('Height')} > 0.5"
)
def object_rects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that stand on a band by themselves, where they stand."""
    rects, _ = placing.placed(nodes(spark, d))
    return rects.where("kind in ('text', 'shape', 'checkbox', 'barcode')").select("doc_id", "node_id", "part", "x", "y", "w", "h")


@query()
def template_rects(spark: SparkSession, d: str) -> DataFrame:
    """Every rectangle of every template, cells of tables among them."""
    rects, _ = placing.placed(nodes(spark, d))
    return rects.select("doc_id", "page_id", "part", "band_no", "ord", "node_id", "kind", "x", "y", "w", "h", "text", F.size("runs").alias("n_lines"))


@query()
def template_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What templates lose on the way into a document: the first five messages of each and how many there are."""
    _, warnings = placing.placed(nodes(spark, d))
    return islands.first_warnings(warnings, "doc_id", "message", "ord")


@query()
def template_grids(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every part of every page."""
    n = nodes(spark, d)
    rects, _ = placing.placed(n)
    return grid.page_grids(rects, template_xml.pages(n.dropDuplicates(["doc_id", "node_id"])))[0]


def _laid_out(spark: SparkSession, d: str) -> DataFrame:
    return sheets.laid_out(nodes(spark, d))[0]


@query("SELECT doc_id, count(DISTINCT node_id) AS n_sections FROM template_node WHERE tag = 'ReportPage' AND coalesce(lower(attrs['Visible']) <> 'false', true) GROUP BY doc_id")
def template_docx(spark: SparkSession, d: str) -> DataFrame:
    """Templates as Word files, and how many sections each has when it is read."""

    @F.pandas_udf("bigint")
    def sections(files: pd.Series) -> pd.Series:
        return files.map(lambda f: docx.main_part(bytes(f)).count("<w:sectPr>"))

    return docx_sink.documents(_laid_out(spark, d)).select("doc_id", sections("content").alias("n_sections"))


@query()
def template_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Templates as PDF files, their pages and bytes."""
    return pdf_sink.documents(_laid_out(spark, d)).select("doc_id", "n_pages", F.length("content").alias("n_bytes"))


WORDS = pa.schema([("doc_id", pa.string()), ("ord", pa.int64()), ("x", pa.float64()), ("word", pa.string())])


def _words(laid: DataFrame) -> DataFrame:
    """doc_id, ord, x and word of the PDF files of templates in reading order: each file is written, read and let go in one step, so neither files nor glyphs are exchanged."""

    def run(batches):
        for batch in batches:
            for r in pdf_sink.each(batch):
                content, _, _ = pdf_sink.file_of(sheets.sheets_of(r["pages"], r["rects"], r["blocks"]), level=1)
                rows = [(no * 1_000_000 + k, x, word) for no, glyphs, _ in pdf.parsed(content) for k, (x, word) in enumerate(pdftext.words_of([pdftext.Item(*g) for g in glyphs]))]
                yield pa.RecordBatch.from_pydict({"doc_id": [r["doc_id"]] * len(rows)} | {c: [w[k] for w in rows] for k, c in enumerate(("ord", "x", "word"))}, WORDS)

    return laid.select("doc_id", "pages", "rects", "blocks").mapInArrow(run, "doc_id string, ord bigint, x double, word string")


@query()
def layout_check(spark: SparkSession, d: str) -> DataFrame:
    """How far captions in the PDF of a template stand from where the template has them: matched captions, median and worst offset in millimetres, and how many are off by more than three."""
    laid, _ = stored_clear(_laid_out(spark, d))
    found = pdftext.matched(captions(laid), _words(laid))
    return islands.offsets(found.withColumn("off", F.abs("delta")).withColumn("all", F.lit("all")), "all", "off", 3.0).drop("all")


def captions(laid: DataFrame) -> DataFrame:
    """Fixed captions in reading order with the left edge they should have, in points: no placeholders, set left, without indent, of two words and ten characters at least."""
    r = laid.select("doc_id", "pages", F.explode("rects").alias("r"))
    page = F.filter("pages", lambda p: p["page_id"] == F.col("r.page_id"))[0]
    said = F.trim(F.regexp_replace("r.text", r"\s+", " "))
    rows = r.select("doc_id", said.alias("text"), "r", page.alias("page"))
    on = (F.col("r.x") + F.col("r.w") > 0.5) & (F.col("r.y") + F.col("r.h") > 0.5) & (F.col("r.x") < F.col("page.body_units") - 0.5)
    keep = on & ~F.col("text").contains("[") & F.col("r.align").isin("Left", "Justify") & ~F.substring("r.text", 1, 1).rlike(r"\s") & (F.col("r.indent") == 0) & (F.length("text") >= 10) & F.col("text").contains(" ")
    left = F.col("page.margins.left") / 20 + F.greatest("r.x", F.lit(0.0)) * V.UNIT_PT
    order = F.struct("r.page_id", F.col("r.top") + F.col("r.y"), "r.x", "r.node_id")
    held = rows.where(keep).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "text", left.alias("expect")))).alias("c"))
    return held.select("doc_id", F.posexplode("c").alias("ord", "c")).select("doc_id", "ord", "c.text", "c.expect")


_TAGLESS = r"regexp_replace(regexp_replace(attrs['Text'], '(?i)</?br([^a-zA-Z>][^>]*)?>', chr(10), 'g'), '</?[a-zA-Z]+[^>]*>', '', 'g')"


def _unescaped(sql: str) -> str:
    for name, sign in V.ENTITIES.items():
        sql = f"replace({sql}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return sql


_PLAIN = f"regexp_replace({_TAGLESS}, '\\r\\n|\\r', chr(10), 'g')"


@query(f"SELECT DISTINCT doc_id, node_id::INT AS node_id, {_unescaped(_PLAIN)} AS plain, (length({_PLAIN}) - length(replace({_PLAIN}, chr(10), '')) + 1)::INT AS n_lines FROM template_node WHERE tag = 'TextObject' AND attrs['Text'] IS NOT NULL AND (coalesce(lower(attrs['HtmlTags']) = 'true', false) OR coalesce(attrs['TextRenderType'] IN ('HtmlTags', 'HtmlParagraph'), false))")
def html_runs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of styled runs of marked-up texts: their text and how many lines there are."""
    t = nodes(spark, d).where(F.col("tag") == "TextObject").where(F.col("attrs")["Text"].isNotNull() & V.markup_enabled())
    lines = t.select("doc_id", F.col("node_id").cast("int").alias("node_id"), F.col("attrs")["Text"].alias("text")).distinct().withColumn("lines", inline.runs(F.col("text")))
    said = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line, lambda r: r["text"]), "")), "\n")
    return lines.select("doc_id", "node_id", said.alias("plain"), F.size("lines").alias("n_lines"))


@query(f"SELECT doc_id, node_id, no AS line, part AS text FROM (SELECT doc_id, node_id, unnest(p) AS part, generate_subscripts(p, 1)::INT - 1 AS no FROM (SELECT DISTINCT doc_id, node_id::INT AS node_id, regexp_split_to_array(attrs['Text'], '\\r\\n|\\r|\\n') AS p FROM template_node WHERE tag = 'TextObject' AND attrs['Text'] <> ''))")
def html_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every text object."""
    t = nodes(spark, d).where("tag = 'TextObject'").select("doc_id", F.col("node_id").cast("int").alias("node_id"), F.col("attrs")["Text"].alias("text")).where("text <> ''").distinct()
    return t.select("doc_id", "node_id", F.posexplode(V.lines(F.col("text"))).alias("line", "text"))


_CODES = "list_transform(string_split(p_brand, ''), lambda c: CASE WHEN ord(c) BETWEEN 32 AND 126 THEN ord(c) - 32 ELSE 0 END)"
_PATTERNS = "[" + ", ".join(f"'{p}'" for p in B.CODE128) + "]"


@query(f"SELECT p_partkey, array_to_string(list_transform(list_concat([104], k, [((104 + list_sum(list_transform(range(1, len(k) + 1), lambda i: i * k[i]))) % 103)::INT, 106]), lambda c: {_PATTERNS}[c + 1]), '') AS bars FROM (SELECT p_partkey, {_CODES} AS k FROM part)")
def code128(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", B.bars128(F.col("p_brand")).alias("bars"))


@query()
def qr_codes(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of QR codes of part names, drawn by all cores, however few files the parts are in."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = table(spark, d, "part").select("p_partkey", "p_name").repartition(tasks, "p_partkey").select("p_partkey", B.rendered(F.lit("QR Code"), F.col("p_name")).alias("r"))
    return made.select("p_partkey", "r.square", F.length("r.png").alias("n_bytes"))


@query("SELECT DISTINCT attrs['Font'] AS font, CASE WHEN trim(string_split(regexp_replace(attrs['Font'], 'style=.*$', ''), ',')[1]) = '' THEN 'Arial' ELSE trim(string_split(regexp_replace(attrs['Font'], 'style=.*$', ''), ',')[1]) END || ', ' || regexp_replace(coalesce(TRY_CAST(nullif(regexp_extract(attrs['Font'], '([0-9.]+) *pt', 1), '') AS DOUBLE), 9.0)::VARCHAR, '\\.0$', '') || 'pt' || CASE WHEN len(s) > 0 THEN ', style=' || array_to_string(s, ', ') ELSE '' END AS again FROM (SELECT attrs, list_filter(['Bold', 'Italic', 'Underline', 'Strikeout'], lambda x: contains(regexp_extract(attrs['Font'], 'style=(.*)$', 1), x)) AS s FROM template_node WHERE attrs['Font'] IS NOT NULL)")
def font_format(spark: SparkSession, d: str) -> DataFrame:
    """Every font text of the templates, read and written again."""
    f = nodes(spark, d).select(F.col("attrs")["Font"].alias("font")).where("font is not null").distinct()
    return f.select("font", inline.font_format(V.font(F.col("font"))).alias("again"))


@query()
def plain_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents as templates, read again: how many paragraphs each has and how high the body is."""
    made = template_sink.templates(template_sink.of_plain(flow.plain_blocks(table(spark, d, "documents"))))
    return _summed(made)


@query()
def md_templates(spark: SparkSession, d: str) -> DataFrame:
    """Markdown documents as templates, read again."""
    return _summed(template_sink.templates(template_sink.of_markdown(text.markdown_blocks(table(spark, d, "documents").where("source = 'md'")))))


def _summed(made: DataFrame) -> DataFrame:
    def again(batches):
        for pdf_ in batches:
            rows = [template_xml.rows_of(i, x.encode()) for i, x in zip(pdf_["doc_id"], pdf_["xml"])]
            yield pd.DataFrame({"doc_id": pdf_["doc_id"], "n_texts": [sum(n[5] == "TextObject" for n in r) for r in rows], "n_cells": [sum(n[5] == "TableCell" for n in r) for r in rows], "height": [next(float(n[6]["Height"]) for n in r if n[5] == "DataBand") for r in rows]})

    return made.mapInPandas(again, "doc_id string, n_texts bigint, n_cells bigint, height double")


@query("SELECT 1 AS page, user_id AS line, count(*) AS n_items, string_agg(event_type, '|' ORDER BY x, event_id) AS types FROM (SELECT user_id, event_id, event_type, floor(floor(epoch(ts)) / 3600)::DOUBLE AS x FROM events) GROUP BY user_id")
def glyph_lines(spark: SparkSession, d: str) -> DataFrame:
    """Glyph runs put into lines by their base line: an event is a run of its type, a user a base line of its own."""
    e = table(spark, d, "events").select(F.lit("e").alias("doc_id"), F.pmod("user_id", F.lit(64)).cast("int").alias("page_no"), F.col("event_id").alias("item_no"), F.floor(F.unix_timestamp("ts") / 3600).cast("double").alias("x"), (F.col("user_id") * 100.0).alias("y"), F.lit(10.0).alias("size"), F.col("event_type").alias("text"), F.lit(0.0).alias("width"), F.lit("Arial").alias("font"), F.lit("000000").alias("color"))
    every = pdftext.by_page(e, "y double, n_items bigint, types string", lambda items: [{"y": n.y, "n_items": len(n.items), "types": "|".join(i.text for i in n.items)} for n in pdftext.lines_of(items)])
    return every.select(F.lit(1).alias("page"), (F.col("y") / 100).cast("bigint").alias("line"), "n_items", "types")


@query("SELECT 'r' || r_regionkey AS style, r_name AS size, 'Arial' AS face FROM region UNION ALL SELECT 'n' || n_nationkey, r_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Arial' END FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 's' || s_suppkey, r_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Arial' END FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def style_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Styles that take over what they don't say from those they are based on: suppliers on nations on regions."""
    c, none = F.col, F.lit(None).cast("string")
    region = table(spark, d, "region").select(F.concat(F.lit("r"), c("r_regionkey").cast("string")).alias("style"), none.alias("base"), F.create_map(F.lit("size"), c("r_name"), F.lit("face"), F.lit("Arial")).alias("props"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("style"), F.concat(F.lit("r"), c("n_regionkey").cast("string")).alias("base"), F.when(c("n_nationkey") % 2 == 0, F.create_map(F.lit("face"), c("n_name"))).otherwise(F.create_map().cast("map<string,string>")).alias("props"))
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("style"), F.concat(F.lit("n"), c("s_nationkey").cast("string")).alias("base"), F.create_map().cast("map<string,string>").alias("props"))
    done = islands.inherited(region.unionByName(nation).unionByName(supplier).withColumn("key", F.lit("d")))
    return done.select("style", c("props")["size"].alias("size"), c("props")["face"].alias("face"))
