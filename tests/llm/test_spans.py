import random

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from folium.llm import spans as L


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id int, text string, n_chars string")


def brute(docs, n=300):
    owners, out = {}, {}
    for k, t in enumerate(docs):
        for i in range(len(t or "") - n + 1):
            owners.setdefault(t[i : i + n], set()).add(k)
    for k, t in enumerate(docs):
        at = [i for i in range(len(t or "") - n + 1) if len(owners[t[i : i + n]]) > 1]
        spans = []
        for i in at:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        out |= {k: [tuple(s) for s in spans]} if spans else {}
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("абвгдежabc 🙂ß") for _ in range(rng.randrange(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))[: n * 4]
    docs = [some(rng.randrange(5, 400)) for _ in range(24)]
    for k in range(0, 20, 2):  # spans about as long as the least length
        src, n = docs[k] + some(200), rng.choice([299, 300, 301, 333, 380, 520])
        at = rng.randrange(0, max(1, len(src) - n))
        docs += [some(40) + src[at : at + n] + some(30)]
        docs[k] = src
    return docs + [docs[3], docs[3], "_" * 700, "-" * 10 + "_" * 400, None, "", "x" * 299, "x" * 299, docs[0] + docs[0]]


def test_same_as_brute_force(spark):
    for seed in (1, 2):
        docs = texts(seed)
        got = {}
        for r in L.shared_spans(frame(spark, docs)).collect():
            got.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
        assert {k: sorted(v) for k, v in got.items()} == brute(docs)


def test_hot_passages_are_spread(spark, monkeypatch):
    """One passage in a tenth of all texts, one text in a tenth, and digests counted as hot from the fourth on."""
    monkeypatch.setattr(L, "HOT", 3)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("абвгдежзик") for _ in range(rng.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, whole = some(90), some(80)
    docs = [some(30) + passage[: rng.randrange(310, 480)] + some(30) if k % 10 == 0 else whole if k % 10 == 1 else some(60) for k in range(120)]
    docs += [some(20) + passage[100:430], docs[2] + some(9), docs[0] + docs[3]]
    got = {}
    for r in L.shared_spans(frame(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    assert {k: sorted(v) for k, v in got.items()} == brute(docs)


def test_repetition_and_empty(spark):
    own = "abc " * 200
    assert L.shared_spans(frame(spark, [own])).count() == 0 and L.shared_spans(frame(spark, [])).count() == 0
    share = L.shared_share(frame(spark, [own, own, "z" * 400])).collect()
    assert {(r.doc_id, r.shared_chars, r.share) for r in share} == {(0, 800, 1.0), (1, 800, 1.0)}


def test_gear_and_digests():
    codes = L.codes_of("ab🙂c" * 40)
    g = [int(x) & 0xFFFFFFFF for x in L._Table.of(codes, 1)]
    h = 0
    for i, x in enumerate(L.gear(codes)):
        h = (2 * h + g[i]) & 0xFFFFFFFF
        assert int(x) == h
    d = L.Digests(codes, 0)
    a = d(np.array([0, 4, 1]), np.array([9, 13, 10]))
    assert a[0] == a[1] != a[2]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_shuffle_files_are_deleted_for_sure(spark, monkeypatch, adaptive):
    """Once a step is written its shuffle files are gone, though its plan is still referred to."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    steps, checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, eager=True: (steps.append(df), checkpoint(df, eager))[1])
    sc, docs = spark.sparkContext._jsc.sc(), texts(3)
    try:
        first = sc.newShuffleId()
        spans = L.shared_spans(frame(spark, docs))
        left = [k for k in range(first, sc.newShuffleId()) if sc.env().mapOutputTracker().containsShuffle(k)]
        assert len(steps) == 3 and len(left) <= 2, left  # the sum over digests and a look for rows, a row a task; each step would leave one
        assert {r.doc_id for r in spans.collect()} == set(brute(docs))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
