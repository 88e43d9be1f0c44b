"""Problem 8: long exact spans shared between records.

Texts are cut at content-defined boundaries: the minima of a gear rolling hash in
a sliding window. A variable chunk runs from a boundary over as many further
boundaries as fit, so that every span of ``min_chars`` characters holds at least
one whole chunk that is cut alike wherever the span stands. Chunks are matched by
digest; only around chunks whose digest two different texts have, all windows of
``min_chars`` characters are compared by a 96-bit digest, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.runtime import cut_clear, dropped, stored

GEAR_BITS = 32
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BATCH_CHARS = 2_000_000
#: A digest that occurs so often is spread over several tasks, and over how many where its count isn't at hand.
HOT, SPREAD = 100_000, 32


def _mix(codes: np.ndarray, salt: int) -> np.ndarray:
    """A gear value for every code point, computed instead of tabulated."""
    x = codes.astype(np.uint64) + np.uint64(salt)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class _Table:
    """Gear values of the basic plane, looked up; others are computed."""

    made: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, codes: np.ndarray, salt: int) -> np.ndarray:
        if salt not in cls.made:
            cls.made[salt] = _mix(np.arange(65536, dtype=np.uint32), salt)
        low = cls.made[salt][np.minimum(codes, 65535)]
        far = codes > 65535
        if far.any():
            low[far] = _mix(codes[far], salt)
        return low


def gear(codes: np.ndarray) -> np.ndarray:
    """The gear hash h[i] = 2 h[i-1] + g(c[i]) in 32 bits, by doubling the covered length."""
    h = (_Table.of(codes, 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    step = 1
    while step < GEAR_BITS:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return h


def boundaries(codes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least gear hash of each window."""
    n = len(codes)
    if n < window:
        return np.empty(0, np.int64)
    key = (gear(codes).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    span = 1
    while span < window:
        step = min(span, window - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    at = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return np.unique(at)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        inverse = pow(base, -1, 2**64)
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = have = np.cumprod(up), np.cumprod(down)
    return have


class Digests:
    """Digests of any slices of one code point array."""

    def __init__(self, codes: np.ndarray, which: int):
        up, self.down = _powers(BASES[which], len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_Table.of(codes, 2 + which) * up[: len(codes)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        d = (self.sums[end] - self.sums[start]) * self.down[start]
        d ^= d >> np.uint64(31)
        d *= np.uint64(0x9FB21C651E98DF25)
        return (d ^ (d >> np.uint64(28))).view(np.int64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def reach(min_chars: int, window: int) -> int:
    """How far a chunk may run beyond its first boundary and still lie in any span that holds that boundary first."""
    r = min_chars - GEAR_BITS - 2 * window + 2
    if r < 1:
        raise ValueError("min_chars is too short for this window")
    return r


def chunks(codes: np.ndarray, first: np.ndarray, last: np.ndarray, min_chars: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks [start, end) of a row of texts laid end to end; first and last bound the text of each code point's owner by text number."""
    cuts = boundaries(codes, window)
    if not len(cuts):
        return cuts, cuts, cuts
    ends = cuts[np.searchsorted(cuts, cuts + reach(min_chars, window), "right") - 1] + 1
    starts = cuts - (GEAR_BITS - 1)
    owner = np.searchsorted(first, cuts, "right") - 1
    fits = (starts >= first[owner]) & (ends <= last[owner])
    return owner[fits], starts[fits], ends[fits]


def _lots(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most BATCH_CHARS characters or one row."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > BATCH_CHARS:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(text)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [codes_of(t) for t in texts]
    last = np.cumsum([len(p) for p in parts])
    return np.concatenate(parts), last - [len(p) for p in parts], last


def shared_spans(docs: DataFrame, min_chars: int = 300, window: int = 64) -> DataFrame:
    """Maximal spans of each document made of windows of ``min_chars`` code points that also stand in another document.

    docs: doc_id, text. Output: doc_id, span_start, span_end (code points, end
    exclusive), n_chars of the document. Every span is at least ``min_chars``
    long; overlapping or touching shared windows make one span. Documents with
    exactly the same text share it whole. Null and shorter texts give no rows;
    repeated rows of one doc_id count once; repetition inside one document alone
    doesn't count; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lot in _lots(batches, 1):
            codes, first, last = _laid(lot)
            owner, start, end = chunks(codes, first, last, min_chars, window)
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(lot))))).astype(np.int32))
            digests = pa.ListArray.from_arrays(at, pa.array(Digests(codes, 0)(start, end)))
            starts = pa.ListArray.from_arrays(at, pa.array((start - first[owner]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], digests, starts], names=["doc_id", "th", "th2", "n_chars", "digests", "starts"])

    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("th2"), F.length("text").alias("n_chars"))
    # The one reading of all texts; what follows reads digests.
    read, path = stored(hashed.mapInArrow(cutting, "doc_id bigint, th bigint, th2 bigint, n_chars int, digests array<bigint>, starts array<int>"))
    # Equal texts (by 128 bits): one class for each; only its least doc_id goes on.
    members = cut_clear(read.select("doc_id", "th", "th2", "n_chars").distinct())
    classes = members.groupBy("th", "th2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"))

    def ranging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A shared span's first chunk begins less than a window after it, and its last sure chunk so late that the
        # next might be cut otherwise near the span's end: the span's windows start in the range below.
        for batch in batches:
            zones = []
            for at in batch.column(1).to_pylist():
                a = np.sort(np.array(at, np.int64))
                zones.append([{"a": int(run[0]) - window + 1, "z": int(run[-1]) + 1} for run in np.split(a, np.flatnonzero(np.diff(a) > window) + 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(zones, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))), batch.column(2)], names=["th", "zones", "hot"])

    pieces = read.select("th", F.explode(F.arrays_zip("digests", "starts")).alias("p")).select("th", F.col("p.digests").alias("digest"), F.col("p.starts").alias("a"))
    both = cut_clear(pieces.groupBy("digest").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("digest", "n"))
    # Digests above a share of all chunks are at most 100,000 by that share, so their list may go to every task.
    often = max(HOT, both.agg(F.sum("n")).first()[0] // 100_000 if not both.isEmpty() else 0)
    parts = F.ceil(F.col("n") / often).cast("int")
    hot = both.where(F.col("n") > often).select("digest", parts.alias("parts"))
    if hot.isEmpty():
        spread = pieces.join(both.select("digest", (F.col("n") > HOT).alias("hot")), "digest")
    else:
        salted = pieces.join(F.broadcast(hot), "digest", "left").withColumn("part", F.coalesce(F.pmod("th", "parts").cast("int"), F.lit(0)))
        spread = salted.join(both.select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), (F.col("n") > HOT).alias("hot")), ["digest", "part"])
    near = spread.groupBy("th").agg(F.collect_set("a").alias("at"), F.max("hot").alias("hot"))
    zones = cut_clear(near.mapInArrow(ranging, "th bigint, zones array<struct<a: int, z: int>>, hot boolean"))
    dropped(docs.sparkSession, path)
    reps = classes.join(zones, "th").select("rep", "zones", "hot")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lot in _lots(batches, 1):
            codes, first, last = _laid(lot)
            starts, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, zones in enumerate(batch.column(3).to_pylist()):
                for z in zones:
                    a, b = max(z["a"], 0), min(z["z"], int(last[k] - first[k]) - min_chars)
                    if b >= a:
                        starts.append(np.arange(first[k] + a, first[k] + b + 1))
                        owner.append(np.full(b - a + 1, k))
            s, o = np.concatenate(starts), np.concatenate(owner)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hot = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            part = np.where(hot, ids.astype(np.uint64) * np.uint64(BASES[0]) >> np.uint64(32), 0) % SPREAD + hot
            yield pa.RecordBatch.from_arrays([pa.array(Digests(codes, 0)(s, s + min_chars)), pa.array(Digests(codes, 1)(s, s + min_chars).astype(np.int32)), pa.array(ids[o]), pa.array((s - first[o]).astype(np.int32)), pa.array(part[o].astype(np.int32))], names=["d0", "d1", "doc_id", "a", "part"])

    spots = texts.join(reps, texts["doc_id"] == reps["rep"]).select("doc_id", "text", "rep", "zones", "hot").mapInArrow(windows, "d0 bigint, d1 int, doc_id bigint, a int, part int")
    same = Window.partitionBy("d0", "d1")

    def shared(rows: DataFrame) -> DataFrame:
        return rows.withColumn("lo", F.min("doc_id").over(same)).withColumn("hi", F.max("doc_id").over(same)).where("lo <> hi")

    # A window that occurs often holds a chunk that does: the windows of texts with such chunks (part 1 and more) go
    # among the others once for each digest, with two documents as evidence, and what turns out shared goes back to all.
    if zones.where("hot").isEmpty():
        starts = shared(spots.select("d0", "d1", "doc_id", "a")).select("doc_id", "a")
    else:
        often_seen = spots.where("part > 0")
        evidence = often_seen.groupBy("d0", "d1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).select("d0", "d1", F.explode(F.array("lo", "hi")).alias("doc_id"), F.lit(-1).alias("a"))
        judged = cut_clear(shared(spots.where("part = 0").select("d0", "d1", "doc_id", "a").unionByName(evidence)).select("d0", "d1", "doc_id", "a"))
        back = judged.where("a < 0").select("d0", "d1").distinct().select("d0", "d1", F.explode(F.sequence(F.lit(1), F.lit(SPREAD))).alias("part"))
        starts = judged.where("a >= 0").select("doc_id", "a").unionByName(often_seen.join(back, ["d0", "d1", "part"]).select("doc_id", "a"))

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.sort(np.array(at, np.int64))
                split = np.flatnonzero(np.diff(a) > min_chars) + 1
                for run in np.split(a, split):
                    out.append((doc_id, int(run[0]), int(run[-1]) + min_chars))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "span_start", "span_end"])

    spans = starts.groupBy("doc_id").agg(F.collect_set("a").alias("at")).mapInArrow(merging, "doc_id bigint, span_start int, span_end int")
    whole = classes.where("rep <> other").select("th", "th2")
    copies = members.join(whole, ["th", "th2"]).select("doc_id", F.lit(0).alias("span_start"), F.col("n_chars").alias("span_end"), "n_chars")
    parts = members.join(whole, ["th", "th2"], "left_anti").join(spans, "doc_id").select("doc_id", "span_start", "span_end", "n_chars")
    return copies.unionByName(parts)


def shared_share(docs: DataFrame, min_chars: int = 300) -> DataFrame:
    """For each document with a shared span: how many of its characters stand elsewhere too, and which part of it that is."""
    return shared_spans(docs, min_chars).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).cast("bigint").alias("shared_chars"), F.max(F.col("n_chars")).cast("bigint").alias("n_chars")).withColumn("share", F.col("shared_chars") / F.col("n_chars"))
