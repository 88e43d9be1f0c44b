"""Queries of the core over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.operators import drift, inlining
from folium.plans import layout_queries as layout
from folium.plans import report_tables as reports
from folium.plans import template_queries as templates
from folium.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return reports.found(table(spark, d, "table_payload"))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.PAGES)


def p4_bands(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.BANDS)


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.OBJECTS)


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.TABLES)


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.LINES)


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.COLUMNS)


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    return reports.typed(table(spark, d, "table_payload"), reports.CELLS)


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.flatten(table(spark, d, "table_payload"))


def p4_elements(spark: SparkSession, d: str) -> DataFrame:
    return inlining.elements(reports.flatten(table(spark, d, "table_payload")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.found(table(spark, d, "text_export"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    exports = table(spark, d, "text_export")
    return drift.unified(drift.rows_of(exports), drift.changes(drift.values_of(exports)))


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    return drift.long(p5_unified(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_cells, p4_columns, p4_pages, p4_bands, p4_objects, p4_tables, p4_lines, p4_rows, p4_elements, p5_found, p5_unified, p5_fields)} | layout.QUERIES | templates.QUERIES

_TYPED = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END"
_DRIFT = f"""WITH RECURSIVE r AS (SELECT DISTINCT feed_id, file_no, payload::JSON AS j FROM text_export WHERE feed_id IS NOT NULL AND file_no IS NOT NULL AND json_valid(payload)),
keyed AS (SELECT feed_id, file_no, j->>'Name' AS name, unnest(json_keys(j)) AS field, j FROM r WHERE json_type(j) = 'OBJECT'),
parsed AS (SELECT feed_id, file_no, name, field, json_extract(j, '$."' || field || '"') AS v FROM keyed),
vals AS (SELECT DISTINCT feed_id, file_no, name, field, {_TYPED} AS kind, v->>'$' AS value FROM parsed),
files AS (SELECT *, lag(file_no) OVER (PARTITION BY feed_id ORDER BY file_no) AS prev_no FROM (SELECT DISTINCT feed_id, file_no FROM vals)),
prof AS (SELECT feed_id, file_no, field, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds FROM vals WHERE field NOT IN ('Name', 'Text') GROUP BY ALL),
cur AS (SELECT p.*, f.prev_no FROM prof p JOIN files f USING (feed_id, file_no) WHERE f.prev_no IS NOT NULL),
past AS (SELECT p.feed_id, f.file_no, f.prev_no, p.field, p.kinds FROM prof p JOIN files f ON p.feed_id = f.feed_id AND p.file_no = f.prev_no),
fresh AS (SELECT * FROM cur ANTI JOIN past USING (feed_id, file_no, field)),
gone AS (SELECT * FROM past ANTI JOIN cur USING (feed_id, file_no, field)),
named AS (SELECT DISTINCT feed_id, file_no, name FROM vals WHERE name IS NOT NULL),
was AS (SELECT g.feed_id, g.file_no, g.field, g.kinds, list_sort(list(v.name || '=' || v.value)) AS body FROM gone g JOIN vals v ON v.feed_id = g.feed_id AND v.file_no = g.prev_no AND v.field = g.field AND v.value IS NOT NULL JOIN named n ON n.feed_id = g.feed_id AND n.file_no = g.file_no AND n.name = v.name GROUP BY ALL),
isn AS (SELECT g.feed_id, g.file_no, g.field, g.kinds, list_sort(list(v.name || '=' || v.value)) AS body FROM fresh g JOIN vals v ON v.feed_id = g.feed_id AND v.file_no = g.file_no AND v.field = g.field AND v.value IS NOT NULL JOIN named n ON n.feed_id = g.feed_id AND n.file_no = g.prev_no AND n.name = v.name GROUP BY ALL),
ren AS (SELECT i.feed_id, i.file_no, i.field AS field_name, w.field AS old_name, i.kinds, w.kinds AS old_kinds FROM isn i JOIN was w USING (feed_id, file_no, body)),
report AS (SELECT feed_id, file_no, 'renamed' AS change_kind, field_name, old_name FROM ren
UNION SELECT c.feed_id, c.file_no, 'retyped', c.field, '' FROM cur c JOIN past p USING (feed_id, file_no, field) WHERE len(c.kinds) > 0 AND len(p.kinds) > 0 AND c.kinds <> p.kinds
UNION SELECT feed_id, file_no, 'retyped', field_name, '' FROM ren WHERE len(kinds) > 0 AND len(old_kinds) > 0 AND kinds <> old_kinds
UNION SELECT feed_id, file_no, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed_id = g.feed_id AND r.file_no = g.file_no AND r.old_name = g.field)
UNION SELECT feed_id, file_no, 'added', field, '' FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed_id = g.feed_id AND r.file_no = g.file_no AND r.field_name = g.field))"""
# Where each field of a file came from: back along the renames to the name its line began with.
_LINES = f"""{_DRIFT},
born AS (SELECT * FROM report WHERE change_kind IN ('renamed', 'added')),
back AS (SELECT DISTINCT feed_id, file_no, field, field AS now_name, file_no AS upto, false AS done FROM vals WHERE field <> 'Name'
UNION ALL SELECT b.feed_id, b.file_no, b.field, CASE WHEN e.change_kind = 'renamed' THEN e.old_name ELSE b.now_name END, CASE WHEN e.change_kind = 'renamed' THEN e.file_no - 1 ELSE coalesce(e.file_no, -1) END, e.change_kind IS DISTINCT FROM 'renamed'
FROM back b LEFT JOIN LATERAL (SELECT x.change_kind, x.old_name, x.file_no FROM born x WHERE x.feed_id = b.feed_id AND x.field_name = b.now_name AND x.file_no <= b.upto ORDER BY x.file_no DESC LIMIT 1) e ON true WHERE NOT b.done),
root AS (SELECT feed_id, file_no, field, now_name AS first_name, upto AS since FROM back WHERE done),
col AS (SELECT r.feed_id, r.file_no, r.field, CASE WHEN EXISTS (SELECT 1 FROM root o WHERE o.feed_id = r.feed_id AND o.file_no = r.since AND o.first_name = r.first_name AND o.since <> r.since) THEN r.first_name || '@' || r.since ELSE r.first_name END AS col FROM root r)"""

_CELLS = """WITH RECURSIVE valid AS (SELECT rec_id, received_at, payload, CASE WHEN json_exists(payload, '$.Report') THEN json_extract(payload, '$.Report') ELSE json_extract(payload->>'$.body', '$.Report') END AS r FROM table_payload WHERE rec_id IS NOT NULL AND json_valid(payload)),
one AS (SELECT rec_id, arg_max(r, {'a': received_at, 'b': payload}) AS v FROM valid WHERE r IS NOT NULL GROUP BY rec_id),
walk AS (SELECT rec_id, v, 'Report' AS kind, v->>'Name' AS name, NULL::VARCHAR AS table_name, NULL::VARCHAR AS parent_name, NULL::BIGINT AS row_no, NULL::BIGINT AS cell_no FROM one
UNION ALL SELECT k.rec_id, k.c, CASE WHEN k.key = 'Objects' THEN k.c->>'Type' ELSE k.key END, k.c->>'Name',
CASE WHEN k.key = 'Objects' AND k.c->>'Type' = 'TableObject' THEN k.c->>'Name' WHEN k.key IN ('Rows', 'Cells') THEN k.table_name END,
CASE WHEN k.key = 'Objects' AND k.c->>'Type' = 'TableObject' THEN k.name WHEN k.key IN ('Rows', 'Cells') THEN k.parent_name END,
CASE WHEN k.key = 'Rows' THEN k.no WHEN k.key = 'Cells' THEN k.row_no END, CASE WHEN k.key = 'Cells' THEN k.no END
FROM (SELECT rec_id, name, table_name, parent_name, row_no, key, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS no FROM (SELECT *, CASE WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$[*]') ELSE [x] END AS l FROM (SELECT w.*, e.key, json_extract(w.v, '$.' || e.key) AS x FROM walk w, (VALUES ('Pages'), ('Bands'), ('Objects'), ('Rows'), ('Cells')) e(key)) WHERE x IS NOT NULL)) k WHERE json_type(k.c) = 'OBJECT')
SELECT DISTINCT rec_id, table_name, row_no::INT AS row_no, cell_no::INT AS cell_no, parent_name FROM walk WHERE kind = 'Cells'"""

SQL: dict[str, str] = layout.SQL | templates.SQL | {
    "p4_found": _CELLS,
    "p5_found": f"{_DRIFT} SELECT * FROM report",
    "p5_fields": f"{_LINES} SELECT v.feed_id, v.file_no, v.name, c.col AS field, max(v.value) AS value FROM vals v JOIN col c USING (feed_id, file_no, field) WHERE v.name IS NOT NULL AND v.value IS NOT NULL GROUP BY ALL",
}
