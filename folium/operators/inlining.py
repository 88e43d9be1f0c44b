"""Problem 4: deeply nested records as related flat tables, by shared inlining.

The schema graph of all records is gathered first (elements, edges, whether an
edge repeats). Elements that repeat, are shared by several parents or lie on a
cycle, and the root, become tables; every other element is inlined into the table
of its only parent. Records are then shredded into rows that carry the key of
their parent row; typed tables pick columns of a row and of the rows it lies in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.jsontext import json_text, read_json, scalar_text
from folium.runtime import collect_bounded

ROWS = "rec_id bigint, element string, row_id int, parent_element string, parent_id int, list_no int, fields map<string,string>"
ARROW = pa.schema([("rec_id", pa.int64()), ("element", pa.string()), ("row_id", pa.int32()), ("parent_element", pa.string()), ("parent_id", pa.int32()), ("list_no", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])
LEAF = "#"  # the column that holds the value of a repeated scalar


def roots_of(value, root: str) -> list[dict]:
    """All objects under ``root`` in the order of the text, wherever a wrapping keeps them: objects, lists, lists of lists or JSON text inside strings, to any depth."""
    out: list[dict] = []
    todo: list[tuple] = [(value, False)]  # whether the value stands under root
    while todo:
        v, own = todo.pop()
        if isinstance(v, str):
            if v.lstrip()[:1] in ("{", "[", '"'):
                try:
                    todo.append((read_json(v), own))
                except ValueError:
                    pass
        elif isinstance(v, list):
            todo += [(x, own) for x in reversed(v)]
        elif isinstance(v, dict):
            if root in v:
                todo.append((v[root], True))
            elif own:
                out.append(v)
            else:
                todo += [(x, False) for x in reversed(list(v.values()))]
    return out


def read_record(payload: str, root: str) -> list[dict]:
    """The root objects of one payload; none where it can't be read."""
    try:
        return roots_of(read_json(payload), root)
    except ValueError:
        return []


def items(values: list) -> list:
    """The entries of a list, those of lists within it in their place."""
    if not any(isinstance(x, list) for x in values):
        return values
    out, todo = [], [values]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        else:
            out.append(x)
    return out


def flat_text(value) -> str | None:
    """One text for a field that is plain elsewhere: lists of scalars by lines, an object with one member by that member, other values as JSON."""
    while isinstance(value, dict) and len(value) == 1:
        value = next(iter(value.values()))
    if isinstance(value, list) and not any(isinstance(x, (dict, list)) for x in value):
        return "\n".join(scalar_text(x) or "" for x in value)
    return json_text(value)


def element_of(key: str, value: dict) -> str:
    """The element type of an object: its own Type where it has one, else the key it stands under."""
    kind = value.get("Type")
    return str(kind) if isinstance(kind, str) and kind else key


def graph_of(record: dict, root: str, into: set) -> None:
    """Adds ('edge', parent, child, repeats) and ('field', element, name, kind) facts of one record; walks with an explicit stack, so depth has no limit."""
    todo = [(root, record)]
    while todo:
        element, value = todo.pop()
        for key, v in value.items():
            if isinstance(v, dict):
                child = element_of(key, v)
                into.add(("edge", element, child, key))
                todo.append((child, v))
            elif isinstance(v, list):
                if not v:
                    into.add(("field", element, key, "empty"))
                for x in items(v):
                    if isinstance(x, dict):
                        child = element_of(key, x)
                        into.add(("edge*", element, child, key))
                        todo.append((child, x))
                    else:
                        into.add(("field", element, key, "list"))
            else:
                into.add(("field", element, key, "null" if v is None else "scalar"))


class Design(NamedTuple):
    tables: frozenset  # elements with a table of their own
    plain: frozenset  # (element, field) that is a scalar somewhere and never leads to a kept element, kept as one column
    lists: frozenset  # (element, field) that only is a list of scalars, a table of its own


def design(facts: list[tuple[str, str, str, str]], root: str, kept: tuple = ()) -> Design:
    """Tables by the rules of shared inlining, from the facts of the schema graph; ``kept`` elements always have a table of their own, as others refer to it."""
    under: dict[str, set] = {}
    for kind, e, c, _ in facts:
        if kind != "field":
            under.setdefault(e, set()).add(c)

    def holds_kept(element: str) -> bool:
        seen, todo = set(), [element]
        while todo:
            x = todo.pop()
            if x in kept:
                return True
            if x not in seen:
                seen.add(x)
                todo += under.get(x, ())
        return False

    # A stray scalar where kept elements stand elsewhere is a field of its row and doesn't make them text.
    held = {(e, key) for kind, e, c, key in facts if kind != "field" and holds_kept(c)}
    plain = {(e, n) for kind, e, n, what in facts if kind == "field" and what == "scalar"} - held
    lists = {(e, n) for kind, e, n, what in facts if kind == "field" and what == "list"} - plain
    edges = [(e, c, key, kind == "edge*") for kind, e, c, key in facts if kind != "field" and (e, key) not in plain]
    parents: dict[str, set] = {}
    below: dict[str, set] = {}
    for e, c, _, _ in edges:
        parents.setdefault(c, set()).add(e)
        below.setdefault(e, set()).add(c)

    def recursive(element: str) -> bool:
        seen, todo = set(), list(below.get(element, ()))
        while todo:
            x = todo.pop()
            if x == element:
                return True
            if x not in seen:
                seen.add(x)
                todo += below.get(x, ())
        return False

    keys: dict[str, set] = {}
    for e, c, key, _ in edges:
        keys.setdefault(c, set()).add((e, key))
    tables = {root} | {c for _, c, _, _ in edges if c in kept} | {c for _, c, _, repeats in edges if repeats} | {c for c in parents if len(parents[c]) > 1 or len(keys[c]) > 1 or recursive(c)}
    return Design(frozenset(tables), frozenset(plain), frozenset(lists))


def shred(rec_id: int, records: list[dict], plan: Design, root: str) -> list[tuple]:
    """Rows of one record's root objects in the order of ROWS; row_id counts from 1 in document order of each record."""
    rows, count = [], 0
    # an entry: element, object, parent element, parent row, place in its list
    todo: list[tuple] = [(root, r, None, None, i) for i, r in reversed(list(enumerate(records, 1)))]
    while todo:
        element, value, parent, parent_id, no = todo.pop()
        count += 1
        own, fields, later = count, {}, []
        inside = [(element, "", value)]
        while inside:
            e, prefix, v = inside.pop()
            for key, x in v.items():
                if isinstance(x, (dict, list)) and (e, key) in plan.plain:
                    fields[prefix + key] = flat_text(x)
                elif isinstance(x, dict):
                    child = element_of(key, x)
                    if child in plan.tables:
                        later.append((child, x, element, own, 1))
                    else:
                        inside.append((child, f"{prefix}{key}.", x))
                elif isinstance(x, list):
                    for i, y in enumerate(items(x), 1):
                        if isinstance(y, dict):
                            later.append((element_of(key, y), y, element, own, i))
                        else:
                            later.append((f"{e}.{key}", {LEAF: flat_text(y)}, element, own, i))
                else:
                    fields[prefix + key] = scalar_text(x)
        rows.append((rec_id, element, own, parent, parent_id, no, fields))
        todo += reversed(later)
    return rows


def _emit(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * len(ARROW)
    cols[6] = [list(x.items()) for x in cols[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)


def readable(payloads: DataFrame, root: str) -> DataFrame:
    """One readable payload of each record (of its copies the one received last, then the greatest text): rec_id, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(read_record(p, root)) for p in batch.column("payload").to_pylist()], pa.bool_()))

    plain = payloads.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.col("received_at").cast("timestamp").alias("received_at"), "payload").dropna(subset=["rec_id", "payload"])
    return plain.mapInArrow(run, "rec_id bigint, received_at timestamp, payload string").groupBy("rec_id").agg(F.max(F.struct("received_at", "payload"))["payload"].alias("payload"))


def planned(payloads: DataFrame, root: str, kept: tuple = (), max_facts: int = 100_000) -> Design:
    """The design of the tables from the schema graph of all payloads; the graph (not the records) comes to the driver, ``max_facts`` entries at most."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for record in read_record(p, root):
                    graph_of(record, root, seen)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*seen) if seen else [()] * 4)], names=["kind", "element", "name", "what"])

    graph = payloads.where("rec_id is not null and payload is not null").select("payload").mapInArrow(facts, "kind string, element string, name string, what string").distinct()
    return design([tuple(r) for r in collect_bounded(graph, max_facts, "the schema graph")], root, kept)


def flatten(payloads: DataFrame, root: str, kept: tuple = (), max_facts: int = 100_000) -> DataFrame:
    """All rows of all tables: rec_id, element (the table), row_id, parent_element, parent_id, list_no (place in its list, from 1), fields.

    payloads: rec_id, received_at, payload (JSON text, perhaps wrapped, to any
    depth). Parent links hold within rec_id. A value that is an object in one
    record and a list of objects in another counts as a list of one; lists in lists
    count as one list; a payload with several root objects has a row for each.
    Null and unreadable payloads give no rows; of several copies of a record one is
    used; null fields stay as null; unknown fields are kept; an empty input gives
    no rows.
    """
    plan = planned(payloads, root, kept, max_facts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec_id, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += shred(rec_id, read_record(p, root), plan, root)
                if len(out) > 20_000:
                    yield _emit(out)
                    out = []
            yield _emit(out)

    return readable(payloads, root).mapInArrow(rows, ROWS)


class Col(NamedTuple):
    """A column of a typed table."""

    name: str
    kind: str  # string, int, double; text that isn't one is null
    what: str  # row_id, list_no, element or a field
    of: tuple = ()  # steps up from the row itself: None to the parent row, elements to the nearest row of these that it lies in


class Table(NamedTuple):
    """A typed table: the rows of the elements it takes, with columns of their own and of the rows they lie in."""

    takes: Callable[[str], bool]
    columns: tuple[Col, ...]
    distinct: bool = False  # whether equal rows of a record count once


def _ways(rows: list[tuple], table: Table) -> dict:
    """For each step that the columns take: where it leads from each row of a record (parents come before what lies in them)."""
    ways: dict = {}
    for step in {s for c in table.columns for s in c.of}:
        to: list = []
        for row in rows:
            up = row[4]
            to.append(up if up is None or step is None or rows[up - 1][1] in step else to[up - 1])
        ways[step] = to
    return ways


def _value(rows: list[tuple], ways: dict, at: int, col: Col):
    up = at + 1
    for step in col.of:
        up = ways[step][up - 1]
        if up is None:
            return None
    row = rows[up - 1]
    return row[2] if col.what == "row_id" else row[5] if col.what == "list_no" else row[1] if col.what == "element" else row[6].get(col.what)


def typed(payloads: DataFrame, table: Table, root: str, kept: tuple = (), max_facts: int = 100_000) -> DataFrame:
    """One flat table in fixed types, rec_id first: the rows of flatten with their links resolved, record by record, so that nothing is joined."""
    plan = planned(payloads, root, kept, max_facts)
    made_of = {"row_id": pa.int32(), "list_no": pa.int32()}
    shape = pa.schema([("rec_id", pa.int64()), *((c.name, made_of.get(c.what, pa.string())) for c in table.columns)])

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(shape), shape)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rec_id, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = shred(rec_id, read_record(p, root), plan, root)
                ways = _ways(rows, table)
                own = [(rec_id, *(_value(rows, ways, at, c) for c in table.columns)) for at, row in enumerate(rows) if table.takes(row[1])]
                out += dict.fromkeys(own) if table.distinct else own
                if len(out) > 20_000:
                    yield emit(out)
                    out = []
            yield emit(out)

    sql = {"row_id": "int", "list_no": "int"}
    flat = readable(payloads, root).mapInArrow(run, "rec_id bigint, " + ", ".join(f"{c.name} {sql.get(c.what, 'string')}" for c in table.columns))
    return flat.select("rec_id", *(F.expr(f"try_cast(trim({c.name}) as {c.kind}) as {c.name}") if c.what not in sql and c.kind != "string" else F.col(c.name) for c in table.columns))


def elements(rows: DataFrame) -> DataFrame:
    """How many rows each table has, how many of them have a parent, and how many fields are used."""
    return rows.groupBy("element").agg(F.count("*").alias("n_rows"), F.count("parent_id").alias("n_linked"), F.countDistinct("rec_id").alias("n_records"), F.sum(F.size("fields")).cast("bigint").alias("n_fields"))
