import base64

import numpy as np
import pytest

from folium.llm import packing as L


@pytest.fixture(scope="module")
def ranks(tmp_path_factory):
    """A vocabulary of single bytes: a text has as many tokens as bytes."""
    path = tmp_path_factory.mktemp("v") / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    return str(path)


def test_every_text_has_a_place(spark, ranks):
    docs = [(k, t, 1) for k, t in enumerate([None, "", "a" * 5, "b" * 20, "c" * 47, "d" * 6, "e" * 6, "ж" * 4])]
    df = spark.createDataFrame(docs + docs[:4], "doc_id int, text string, capacity int")
    targets = spark.createDataFrame([(1, 20, "x"), (2, 100, "y"), (3, None, "z"), (4, 0, "z")], "target_id int, capacity int, text string")
    rows = L.pack(df, targets, ranks).collect()
    assert {(r.target_id, r.doc_id) for r in rows} == {(t, d) for t in (1, 2) for d in range(8)}
    for t, cap in ((1, 20), (2, 100)):
        own = [r for r in rows if r.target_id == t]
        for d, text, _ in docs:
            assert sum(r.tokens for r in own if r.doc_id == d) == len((text or "").encode())
            if len((text or "").encode()) <= cap:
                assert sum(r.doc_id == d for r in own) == 1
        used = {}
        for r in own:
            if r.container:
                used[r.container] = used.get(r.container, 0) + r.tokens
        assert max(used.values()) <= cap
        assert all(r.container is None for r in own if r.doc_id < 2)
    assert L.pack(df, targets.limit(0), ranks).count() == 0 and L.pack(df.limit(0), targets, ranks).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_constraints_and_fill(rule):
    sizes = np.random.default_rng(1).integers(1, 100, 800)
    into = L.best_fit(sizes, 100, 5, 4000.0, rule=rule)
    for k in set(into):
        own = sizes[into == k]
        assert own.sum() <= 100 and len(own) <= 5 and ((own.astype(float) ** 2).sum() <= 4000.0 or len(own) == 1)
    free = L.best_fit(sizes, 100, 50, 1e4, rule=rule)
    assert sizes.sum() / (100 * len(set(free))) > 0.97
    assert len(L.best_fit(np.array([], int), 10, 5, 100.0)) == 0


def test_all_three_limits_bind_in_pack(spark, ranks):
    """With the defaults and a capacity of 384: four pieces, 384 tokens, an attention cost of 0.9 * 384 squared."""
    texts = ["a" * 364] * 5 + ["b" * 20] * 5 + ["c" * 9] * 40 + ["d" * 384] * 2 + ["e" * 250] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = L.pack(df, spark.createDataFrame([(1, 384)], "target_id int, capacity int"), ranks).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.container, []).append(r.tokens)
    limit = 0.9 * 384**2
    assert all(sum(x) <= 384 and len(x) <= 4 and (sum(y * y for y in x) <= limit or len(x) == 1) for x in bins.values())
    assert any(len(x) == 4 and sum(x) < 384 - 9 for x in bins.values())  # another would fit but for its number
    assert all(20 not in x for x in bins.values() if 364 in x)  # would fit but for the attention cost
    assert sum(x == [384] for x in bins.values()) == 2
