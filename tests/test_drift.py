import json

from hypothesis import given
from hypothesis import strategies as st

from folium.operators import drift as L


def frame(spark, rows):
    return spark.createDataFrame([(f, n, json.dumps(o) if o is not None else None, "x") for f, n, o in rows], "feed_id string, file_no int, payload string, kind string")


def test_changes(spark):
    a = [{"Name": "1", "Text": "t", "TextColor": "Red", "Angle": 90, "Gone": 1, "Both": 1}, {"Name": "2", "TextColor": None, "Angle": 0, "Both": 2}]
    b = [{"Name": "1", "FillColor": "Red", "Angle": "90", "New": {"x": 1}, "Both": 1}, {"Name": "2", "Angle": "0", "Both": 2}, {"Name": "3", "FillColor": "Blue"}]
    rows = [("F", 2, o) for o in a] + [("F", 5, o) for o in b] + [("F", 5, b[0])] + [("G", 1, a[0]), ("H", 3, None)]
    got = {tuple(r) for r in L.found(frame(spark, rows)).collect()}
    assert got == {("F", 5, "renamed", "FillColor", "TextColor"), ("F", 5, "retyped", "Angle", ""), ("F", 5, "removed", "Gone", ""), ("F", 5, "added", "New", "")}


def test_rename_with_new_type_and_ties(spark):
    a = {"Name": "1", "LineHeight": 8.5, "WordWrap": "x", "Padding": "x"}
    b = {"Name": "1", "Line_Height": "8.5", "Word_Wrap": "x", "Padding2": "x"}
    got = {tuple(r)[2:] for r in L.found(frame(spark, [("F", 1, a), ("F", 2, b)])).collect()}
    assert got == {("renamed", "Line_Height", "LineHeight"), ("retyped", "Line_Height", ""), ("renamed", "Word_Wrap", "WordWrap"), ("renamed", "Padding2", "Padding")}


def test_unified_and_empty(spark):
    rows = [("F", 1, {"Name": "1", "TextColor": "Red", "HtmlTags": True}), ("F", 2, {"Name": "1", "Col": "Red", "HtmlTags": "true"}), ("F", 3, {"Name": "1", "C3": "Red"})]
    v = L.cut(L.values_of(frame(spark, rows)))
    got = {r.file_no: (r.text_color, r.html_tags) for r in L.unified(v, L.changes(v)).collect()}
    assert got == {1: ("Red", True), 2: ("Red", True), 3: ("Red", None)}
    assert L.found(frame(spark, [])).count() == 0


def test_a_name_that_begins_anew(spark):
    # A becomes B, then a new A comes beside it, later B goes and A lives on.
    objs = [{"A": 1}, {"B": 1}, {"B": 1, "A": 2}, {"B": 1, "C": 2}, {"C": 2, "A": 3}, {"C": 2, "A": 3, "B": 5}]
    v = frame(spark, [("F", k, {"Name": "1", **o}) for k, o in enumerate(objs)])
    rows = L.unified(L.rows_of(v), L.changes(L.values_of(v))).collect()
    got = {r.file_no: r.fields for r in rows}
    assert got == {0: {"A": "1"}, 1: {"A": "1"}, 2: {"A": "1", "A@2": "2"}, 3: {"A": "1", "A@2": "2"}, 4: {"A@2": "2", "A": "3"}, 5: {"A@2": "2", "A": "3", "B": "5"}}
    assert L.spells_of([(1, "renamed", "B", "A"), (2, "added", "A", ""), (3, "removed", "B", "")]) == [("B", 1, 3, "A"), ("A", 2, 2**31 - 1, "A@2")]


def test_differing_copies_keep_their_types(spark):
    rows = [("F", 1, {"Name": "1", "A": 1}), ("F", 1, {"Name": "1", "A": "s"}), ("F", 2, {"Name": "1", "A": "s"}), ("F", 2, {"A": "no name"}), ("F", 2, {"A": None}), ("F", 3, {"Name": "1", "A": 1}), ("F", 3, {"Name": "1", "A": "s", "New": [{"x": None}]})]
    v = frame(spark, rows)
    assert {tuple(r) for r in L.found(v).collect()} == {("F", 2, "retyped", "A", ""), ("F", 3, "retyped", "A", ""), ("F", 3, "added", "New", "")}
    got = {r.file_no: r.fields for r in L.unified(L.rows_of(v), L.changes(L.values_of(v))).collect()}
    assert got == {1: {"A": "s"}, 2: {"A": "s"}, 3: {"A": "s", "New": '[{"x":null}]'}}


def test_same_as_brute_force(spark):
    import random

    rng = random.Random(4)
    pool, feeds = ["f1", "f2", "f3", "f4", "f5"], {}
    for feed in "PQR":
        fields = {f: [rng.choice([None, 1, "x", True]) for _ in range(3)] for f in pool[:3]}
        for no in range(0, 24, 3):
            for f in list(fields):
                if rng.random() < 0.3:
                    free = [x for x in pool if x not in fields]
                    v = fields.pop(f)
                    if rng.random() < 0.6 and free:
                        fields[rng.choice(free)] = v
            if rng.random() < 0.5 and len(fields) < 4:
                fields[rng.choice([x for x in pool if x not in fields])] = [rng.choice(["new", 7, None]) for _ in range(3)]
            feeds[feed, no] = [{"Name": str(k), "Text": rng.random(), **{f: v[k] for f, v in fields.items() if v[k] is not None or rng.random() < 0.5}} for k in range(3) if k < 2 or rng.random() < 0.5]
    rows = [(f, no, o) for (f, no), objs in feeds.items() for o in objs]
    got = {tuple(r) for r in L.found(frame(spark, rows + rows[::4])).collect()}
    last = {}
    for (feed, no), objs in sorted(feeds.items()):
        now, was = {o["Name"]: o for o in objs}, last.get(feed)
        last[feed] = now
        if was is None:
            continue
        have = lambda side: {f for o in side.values() for f in o} - {"Name", "Text"}
        kinds = lambda side, f: {type(o[f]) for o in side.values() if o.get(f) is not None}
        said = {(k, f, o) for a, n, k, f, o in got if (a, n) == (feed, no)}
        gone, new, shared = have(was) - have(now), have(now) - have(was), now.keys() & was.keys()
        fits = {(o, n) for o in gone for n in new if all(str(was[k].get(o)) == str(now[k].get(n)) for k in shared) and any(was[k].get(o) is not None for k in shared)}
        renamed = {(o, n) for k, n, o in said if k == "renamed"}
        assert renamed <= fits and len({o for o, _ in renamed}) == len({n for _, n in renamed}) == len(renamed)
        assert all(o in {x for x, _ in renamed} or n in {y for _, y in renamed} for o, n in fits)  # none is left over
        want = {("removed", f, "") for f in gone - {o for o, _ in renamed}} | {("added", f, "") for f in new - {n for _, n in renamed}}
        want |= {("retyped", n, "") for o, n in [(f, f) for f in have(was) & have(now)] + sorted(renamed) if kinds(was, o) and kinds(now, n) and kinds(was, o) != kinds(now, n)}
        assert said - {("renamed", n, o) for o, n in renamed} == want


@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.integers(0, 20), min_size=n + 1, max_size=n + 1), min_size=n, max_size=n)))
def test_assign(weights):
    import itertools

    take = L.assign([[float(x) for x in r] for r in weights])
    best = max(sum(weights[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(weights[0])), len(weights)))
    assert len(set(take)) == len(take) and sum(weights[i][j] for i, j in enumerate(take)) == best
