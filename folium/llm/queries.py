"""Queries of the text problems over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import leakage, lookalike, markup, mojibake, packing, spans
from folium.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "template_node")).select("doc_id", "node_id")


def p1_repair(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "template_node"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.strip_markup(lookalike.text_nodes(table(spark, d, "template_node"))).select("doc_id", "node_id")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.strip_markup(lookalike.text_nodes(table(spark, d, "template_node"))).drop("text")


def p2_roles(spark: SparkSession, d: str) -> DataFrame:
    """How much of each kind of structure the markup held."""
    clean = markup.strip_markup(lookalike.text_nodes(table(spark, d, "template_node")))
    return clean.select(F.explode("structure").alias("s")).groupBy(F.col("s.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).cast("bigint").alias("n_chars"))


def _disguised(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "template_node")
    changed = lookalike.consistent(lookalike.text_nodes(nodes), table(spark, d, "caption"))
    return changed.join(mojibake.repair(nodes).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _disguised(spark, d).select("doc_id", "node_id").distinct()


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return _disguised(spark, d).dropDuplicates(["doc_id", "node_id"])


def p3_captions(spark: SparkSession, d: str) -> DataFrame:
    """How many text objects equal each caption as they stand and in their consistent form."""
    captions = table(spark, d, "caption")
    nodes = lookalike.text_nodes(table(spark, d, "template_node")).distinct()
    clean = lookalike.consistent(nodes, captions, changed_only=False)
    counts = clean.groupBy("clean").agg(F.count("*").alias("n_equal"), F.count_if(F.col("text") == F.col("clean")).alias("n_as_written"))
    return captions.join(counts, captions["caption_text"] == counts["clean"], "left").select("caption_id", "caption_text", F.coalesce("n_as_written", F.lit(0)).alias("n_as_written"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_target"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_target")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_passages(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each test item leaked into."""
    hits = cut(leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item")))
    items = table(spark, d, "eval_item").select("item_id", "suite", "lang").distinct()
    return items.join(hits.groupBy("item_id").agg(F.count("*").alias("n_docs")), "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents")).select("doc_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repair, p2_found, p2_clean, p2_roles, p3_found, p3_consistent, p3_captions, p6_containers, p6_fill, p7_found, p7_passages, p7_items, p8_found, p8_spans, p8_share)}

_WORDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"
_GRAMS = "SELECT DISTINCT {1}, array_to_string(w[i:i+12], ' ') AS gram FROM (SELECT {1}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {1}, {2} AS w FROM {0}) WHERE len(w) >= 13)"
_LEAKED = f"WITH d AS ({_GRAMS.format('documents', 'doc_id', _WORDS.format('text'))}), e AS ({_GRAMS.format('eval_item', 'item_id', _WORDS.format('item_text'))}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)"
_SHARED = "WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300), h AS (SELECT doc_id, md5(substr(text, i, 300)) AS k FROM w), s AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM h WHERE k IN (SELECT k FROM s)"

_SPANS = "WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300), h AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS k FROM w), s AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)), a AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 300 AS cut FROM h WHERE k IN (SELECT k FROM s)), g AS (SELECT doc_id, i, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM a), p AS (SELECT doc_id, (min(i) - 1)::INT AS span_start, (max(i) + 299)::INT AS span_end FROM g GROUP BY doc_id, span)"

SQL: dict[str, str] = {
    "p8_spans": f"{_SPANS} SELECT p.doc_id, span_start, span_end, length(text)::INT AS n_chars FROM p JOIN documents USING (doc_id)",
    "p8_share": f"{_SPANS} SELECT p.doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars, any_value(length(text))::BIGINT AS n_chars, sum(span_end - span_start) / any_value(length(text))::DOUBLE AS share FROM p JOIN documents USING (doc_id) GROUP BY p.doc_id",
    "p7_found": _LEAKED,
    "p7_items": f"SELECT i.item_id, i.suite, i.lang, count(l.doc_id) AS n_docs FROM (SELECT DISTINCT item_id, suite, lang FROM eval_item) i LEFT JOIN ({_LEAKED}) l USING (item_id) GROUP BY ALL",
    "p8_found": _SHARED,
}
