"""Problem 5: schemas that drift between the files of a feed.

The files of one object lie side by side after one shuffle by (feed, object). A
scan over them profiles every field of every file (presence, types) and sketches
the values that a field has on the objects of two files, summed before anything
is shuffled again. One small row for each file then tells its changes: fields
that are gone and fields that are new are matched by sketch; where several fit, a
bipartite assignment by name similarity and types decides. Matched columns are
unified under the name and the file their line of names began with.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.jsontext import Number, json_text, read_json
from folium.runtime import cut

KEY, BODY = "Name", "Text"
KINDS = ("string", "number", "boolean", "object", "array")
ROOM = 50_000  # sums a task holds before it sends them on


def kind_of(value) -> str:
    """The JSON type of a parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


_BITS = {"null": 0} | {k: 1 << i for i, k in enumerate(KINDS)}
_BIT_OF = {str: 1, Number: 2, bool: 4, dict: 8, list: 16, type(None): 0}


def kinds_of(mask: int) -> str:
    return ",".join(k for k in KINDS if mask & _BITS[k])


def rows_of(exports: DataFrame) -> DataFrame:
    """The objects as they come: feed_id, file_no, name, payload; rows without feed_id, file_no or payload are left out."""
    return exports.select(F.col("feed_id").cast("string").alias("feed_id"), F.col("file_no").cast("int").alias("file_no"), F.get_json_object("payload", f"$.{KEY}").alias("name"), F.col("payload").cast("string").alias("payload")).dropna(subset=["feed_id", "file_no", "payload"])


def values_of(exports: DataFrame) -> DataFrame:
    """The objects of all files, those of one feed and name side by side in the order of their files.

    An object without Name has the name null and is spread by its payload, lest such objects be hot.
    """
    return rows_of(exports).repartition("feed_id", F.coalesce("name", F.xxhash64("payload").cast("string"))).sortWithinPartitions("feed_id", "name", "file_no", "payload")


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str | None, list[dict]]]:
    """feed, file, name and the differing copies of each object of sorted partitions; unreadable payloads and such that are no objects are passed over."""
    at, copies, last = None, [], None
    for batch in batches:
        for feed, no, name, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (feed, no, name) != at or name is None:
                if copies:
                    yield (*at, copies)
                at, copies, last = (feed, no, name), [], None
            if payload == last:
                continue
            last = payload
            try:
                obj = read_json(payload)
            except ValueError:
                continue
            if isinstance(obj, dict):
                copies.append(obj)
    if copies:
        yield (*at, copies)


STATS = "feed_id string, file_no int, other int, field string, side string, mask int, n bigint, x bigint, y bigint"
_STATS = pa.schema([("feed_id", pa.string()), ("file_no", pa.int32()), ("other", pa.int32()), ("field", pa.string()), ("side", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the objects of a task.

    side '': the types (as bits) of a field of a file; the field '' stands for the
    file. side 'was' and 'is': how many values, and two sums of their hashes, a field
    of the file ``other`` (an object's last file before file_no) or of file_no has
    on objects of both that carry it in one of them only.
    """
    masks: dict[tuple, dict[str, int]] = {}
    sums: dict[tuple, list[int]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(*k, None, f, "", m, 0, 0, 0) for k, fields in masks.items() for f, m in fields.items()] + [(*k, 0, *v) for k, v in sums.items()]
        masks.clear()
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_STATS), _STATS)], schema=_STATS)

    def sketch(key: tuple, name: str, copies: list[dict], field: str) -> None:
        # an object's differing copies count with each of their values
        for text in {json_text(o[field]) for o in copies if o.get(field) is not None}:
            h = xxhash.xxh3_128_intdigest(f"{name}\0{text}".encode("utf-8", "surrogatepass"))
            s = sums.setdefault(key, [0, 0, 0])
            s[0] += 1
            s[1] ^= (h & (2**64 - 1)) - 2**63
            s[2] ^= (h >> 64) - 2**63

    before: tuple | None = None  # feed, file, name, fields, copies of the object's last file
    for feed, no, name, copies in _objects(batches):
        fields = masks.get((feed, no))
        if fields is None:
            fields = masks[feed, no] = {"": 0}
        for obj in copies:
            for f, v in obj.items():
                if f not in fields:
                    held += 1
                fields[f] = fields.get(f, 0) | _BIT_OF[type(v)]
        if name is not None:
            keys = copies[0].keys() if len(copies) == 1 else set().union(*copies)
            if before is not None and before[2] == name and before[0] == feed:
                for f in before[3] - keys:
                    sketch((feed, no, before[1], f, "was"), name, before[4], f)
                for f in keys - before[3]:
                    sketch((feed, no, before[1], f, "is"), name, copies, f)
            before = (feed, no, name, keys, copies)
        if held + len(sums) > ROOM:
            yield flush()
            held = 0
    yield flush()


def similarity(a: str, b: str) -> float:
    """How alike two field names are, by their letters in lower case."""
    x, y = (("".join(c for c in s.lower() if c.isalnum())) for s in (a, b))
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def assign(weights: list[list[float]]) -> list[int]:
    """Columns of a maximal assignment of rows (Hungarian method by shortest augmenting paths); needs rows <= columns."""
    n, m = len(weights), len(weights[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0], i0, delta, j1 = True, match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -weights[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def match(olds: dict[str, int], news: dict[str, int], pairs: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """One-to-one renames (old, new) with the most of the fitting pairs, then the most alike in types and names."""
    left, right = sorted({o for o, _ in pairs}), sorted({n for _, n in pairs})
    if len(pairs) == len(left) == len(right):
        return sorted(pairs)  # nothing to choose
    fit = {(o, n): 1000.0 + similarity(o, n) + 0.25 * (olds[o] == news[n]) for o, n in pairs}
    flip = len(left) > len(right)
    rows, cols = (right, left) if flip else (left, right)
    take = assign([[fit.get((c, r) if flip else (r, c), 0.0) for c in cols] for r in rows])
    chosen = [((cols[j], r) if flip else (r, cols[j])) for r, j in zip(rows, take)]
    return sorted(x for x in chosen if x in fit)


CHANGES = "feed_id string, file_no int, change_kind string, field_name string, old_name string"


def file_changes(was: dict[str, int], now: dict[str, int], sketches: dict[tuple[str, str], tuple]) -> list[tuple[str, str, str]]:
    """(change_kind, field_name, old_name) of one file against the one before, from the types of their fields and the sketches by (side, field)."""
    gone, new = {f: m for f, m in was.items() if f not in now}, {f: m for f, m in now.items() if f not in was}
    by_sketch: dict[tuple, list[str]] = {}
    for f in gone:
        if ("was", f) in sketches:
            by_sketch.setdefault(sketches["was", f], []).append(f)
    pairs = {(o, f) for f in new for o in by_sketch.get(sketches.get(("is", f)), ())}
    renamed = match(gone, new, pairs) if pairs else []
    out = [("renamed", n, o) for o, n in renamed]
    both = [(f, was[f], m) for f, m in now.items() if f in was] + [(n, gone[o], new[n]) for o, n in renamed]
    out += [("retyped", f, "") for f, a, b in both if a and b and a != b]
    out += [("removed", f, "") for f in gone if f not in {o for o, _ in renamed}]
    return out + [("added", f, "") for f in new if f not in {n for _, n in renamed}]


def changes(values: DataFrame) -> DataFrame:
    """Changes of each file against the next lower one: feed_id, file_no, change_kind, field_name, old_name.

    values: the result of values_of. Fields Name and Text are left out. Nulls equal
    missing values when renames are sought; an object without Name takes part in
    presence and types only; a repeated row counts once, and differing copies of an
    object count with each of their types and values. An empty input gives no rows.
    """
    sums = cut(values.mapInArrow(_profiled, STATS).groupBy("feed_id", "file_no", "other", "field", "side").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")))
    order = Window.partitionBy("feed_id").orderBy("file_no")
    files = sums.where("side = '' and field = ''").select("feed_id", "file_no").withColumn("prev_no", F.lag("file_no").over(order)).withColumn("next_no", F.lead("file_no").over(order))
    fields = sums.where(~F.col("field").isin("", KEY, BODY)).join(files, ["feed_id", "file_no"]).where("side = '' or other = prev_no")
    part = F.struct("side", "field", "mask", "n", "x", "y")
    own = fields.where("prev_no is not null").select("feed_id", "file_no", part.alias("s"))
    # A file's fields once more as what stood before its successor; a file without fields still ends those before it.
    past = fields.where("side = '' and next_no is not null").select("feed_id", F.col("next_no").alias("file_no"), F.struct(F.lit("past").alias("side"), "field", "mask", "n", "x", "y").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for feed, no, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                was = {p["field"]: p["mask"] for p in parts if p["side"] == "past"}
                now = {p["field"]: p["mask"] for p in parts if p["side"] == ""}
                sketches = {(p["side"], p["field"]): (p["n"], p["x"], p["y"]) for p in parts if p["side"] in ("was", "is")}
                out += [(feed, no, *c) for c in file_changes(was, now, sketches)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["feed_id", "file_no", "change_kind", "field_name", "old_name"])

    return own.unionByName(past).groupBy("feed_id", "file_no").agg(F.collect_list("s").alias("parts")).mapInArrow(run, CHANGES)


def spells_of(moves: list[tuple[int, str, str, str]]) -> list[tuple[str, int, int, str]]:
    """(field, since, until, column): from which file until before which a name stands for a column of another name.

    moves: (file_no, change_kind, field_name, old_name) of one feed. A line of
    names is called by the name it began with. A name that begins anew while the
    line it began once lives on under another name gets a column of its own,
    called by the name and the file: ``name@file``.
    """
    now: dict[str, tuple[str, int]] = {}
    out = []
    first, last = -(2**31), 2**31 - 1
    by_file: dict[int, list[tuple[str, str, str]]] = {}
    for no, kind, field, old in moves:
        by_file.setdefault(no, []).append((kind, field, old))

    def end(name: str, no: int) -> str:
        column, since = now.pop(name, (name, first))
        if column != name:
            out.append((name, since, no, column))
        return column

    for no in sorted(by_file):
        own = by_file[no]
        for kind, field, _ in own:
            if kind == "removed":
                end(field, no)
        for field, column in [(field, end(old, no)) for kind, field, old in own if kind == "renamed"]:
            if column != field:
                now[field] = (column, no)
        for kind, field, _ in sorted(own):
            if kind == "added":
                taken, column = {c for c, _ in now.values()}, field
                while column in taken:
                    column = f"{field}@{no}" if column == field else column + "@"
                if column != field:
                    now[field] = (column, no)
    return out + [(name, since, last, column) for name, (column, since) in now.items()]


def _lineage(group: pd.DataFrame) -> pd.DataFrame:
    out = spells_of(list(zip(group["file_no"].tolist(), group["change_kind"], group["field_name"], group["old_name"])))
    return pd.DataFrame({"feed_id": [group["feed_id"].iloc[0]] * len(out), "field": [x[0] for x in out], "since": [x[1] for x in out], "until": [x[2] for x in out], "col": [x[3] for x in out]})


def unified(values: DataFrame, report: DataFrame) -> DataFrame:
    """One consistent table of all objects: the well-known fields in fixed columns, all fields in a map by the name their line of names began with.

    values: the result of rows_of or values_of; report: the result of changes. One row for each feed, file
    and object name; objects without Name are left out, as nothing tells them apart.
    Null fields are left out of the map; where copies of an object differ, the
    greatest text of a field stands.
    """
    report = cut(report)
    # Changes are few beside objects: the history of a feed's names is read in one piece, its objects are not.
    moves = report.where("change_kind <> 'retyped'").join(report.where("change_kind = 'renamed'").select("feed_id").distinct(), "feed_id", "left_semi")
    spells = moves.groupBy("feed_id").applyInPandas(_lineage, "feed_id string, field string, since int, until int, col string")
    files = values.select("feed_id", "file_no").distinct()
    f, s = files.alias("f"), spells.alias("s")
    on = (F.col("f.feed_id") == F.col("s.feed_id")) & (F.col("f.file_no") >= F.col("s.since")) & (F.col("f.file_no") < F.col("s.until"))
    names = cut(f.join(s, on).groupBy("f.feed_id", "f.file_no").agg(F.map_from_entries(F.collect_list(F.struct("s.field", "s.col"))).alias("names")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            called = [dict(m) if m else {} for m in batch.column(4).to_pylist()]
            out = []
            for (feed, no, name, payload), names_ in zip(zip(*(batch.column(i).to_pylist() for i in range(4))), called):
                try:
                    obj = read_json(payload)
                except ValueError:
                    continue
                if isinstance(obj, dict):
                    own: dict[str, str] = {}
                    for k, v in sorted(obj.items()):
                        if k != KEY and v is not None:
                            column = names_.get(k, k)
                            while column in own:  # a field that happens to be called as a column of another line
                                column += "@"
                            own[column] = json_text(v)
                    out.append((feed, no, name, sorted(own.items())))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], names=["feed_id", "file_no", "name", "fields"])

    named = values.where("name is not null").join(names, ["feed_id", "file_no"], "left").mapInArrow(run, "feed_id string, file_no int, name string, fields map<string,string>")
    one = named.groupBy("feed_id", "file_no", "name").agg(F.collect_set(F.map_entries("fields")).alias("c"))
    merged = F.expr("map_from_entries(transform(array_distinct(transform(flatten(c), e -> e.key)), k -> struct(k as key, array_max(transform(filter(flatten(c), e -> e.key = k), e -> e.value)) as value)))")
    wide = one.select("feed_id", "file_no", "name", F.when(F.size("c") == 1, F.map_from_entries(F.col("c")[0])).otherwise(merged).alias("fields"))
    pick = lambda f: F.col("fields")[f]
    return wide.select("feed_id", "file_no", "name", pick("Text").alias("text"), pick("TextColor").alias("text_color"), pick("TextFill.Color").alias("fill_color"), F.expr("try_cast(fields['HtmlTags'] as boolean)").alias("html_tags"), pick("TextRenderType").alias("render_type"), "fields")


def long(table: DataFrame) -> DataFrame:
    """The unified table with one row for each object and field that has a value: feed_id, file_no, name, field, value."""
    return table.select("feed_id", "file_no", "name", F.explode("fields").alias("field", "value"))


def found(exports: DataFrame) -> DataFrame:
    """The report of changes over all exports."""
    return changes(values_of(exports)).distinct()
