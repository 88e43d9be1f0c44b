"""Problem 6: filling fixed-capacity containers, by vector best-fit.

Every item is a vector (tokens, one document, attention cost = tokens squared) and
so is what a container has left. An item goes to the open container that satisfies
every constraint and leaves the least weighted residual norm (or has the greatest
weighted dot product); large items come first. Items are packed in blocks of
bounded size, so the work is spread whatever the keys.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.runtime import collect_bounded, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the word pattern that belongs to byte-level vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WEIGHTS = (1.0, 0.05, 0.2)
_COUNTERS: dict = {}


class Counter(dict):
    """Tokens of a text; counts of its words are kept, the vocabulary never crosses a word."""

    def __init__(self, path: str, pattern: str = PATTERN, room: int = 400_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words, self.room = regex.compile(pattern), room

    def __missing__(self, word: str) -> int:
        if len(self) > self.room:
            self.clear()
        self[word] = n = len(self.coder.encode_ordinary(word))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.words.findall(text)))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, tokens of every document; null and empty texts have 0 tokens. tokenizer: a rank file that all executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, pattern) not in _COUNTERS:
            _COUNTERS[tokenizer, pattern] = Counter(tokenizer, pattern)
        count = _COUNTERS[tokenizer, pattern].count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int32())], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, tokens int")


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_attention: float, weights: tuple = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The container number of each size; sizes are at most capacity. Ties go to the container opened first; an item that alone costs more than the attention limit has a container to itself."""
    order = np.argsort(-sizes, kind="stable")
    into = np.empty(len(sizes), np.int64)
    limits = np.array([capacity, max_docs, max_attention], float)
    w = np.array(weights, float)[:, None]
    least = sizes.min() if len(sizes) else 0
    left = np.zeros((3, max(16, len(sizes))))  # what open containers have left, as a share of the limits
    number = np.zeros(left.shape[1], np.int64)
    n = made = 0
    for i in order:
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2]) / limits
        after = left[:, :n] - need[:, None]
        fits = (after >= -1e-12).all(axis=0)
        k = -1
        if fits.any():
            score = (w * after * after).sum(axis=0) if rule == "norm" else -(w * left[:, :n] * need[:, None]).sum(axis=0)
            k = int(np.argmin(np.where(fits, score, np.inf)))
        if k < 0:
            k, made = n, made + 1
            left[:, k], number[k] = 1.0 - need, made - 1
            n += 1
        else:
            left[:, k] = after[:, k]
        into[i] = number[k]
        if left[0, k] * capacity < least - 1e-9 or left[1, k] * max_docs < 1 - 1e-9 or left[2, k] * max_attention < float(least) ** 2 - 1e-9:  # nothing fits any more
            n -= 1
            if k != n:  # keeps the order of opening
                left[:, k:n] = left[:, k + 1 : n + 1].copy()
                number[k:n] = number[k + 1 : n + 1].copy()
    return into


def pack(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_docs: int = 8192, max_docs_share: int = 96, attention: float = 0.9, rule: str = "norm", max_targets: int = 1000) -> DataFrame:
    """The container of every text for every target.

    docs: doc_id (unique; repeated rows count once), text; targets: target_id,
    capacity. Output: target_id, capacity, doc_id, piece_no (from 1), tokens,
    container (text "block-number", null for texts without tokens). Only a text
    longer than the capacity is split: into full pieces and a rest. A container
    holds at most capacity / ``max_docs_share`` pieces (4 at least) and, unless one
    piece alone costs more, an attention cost of ``attention`` * capacity squared;
    with the defaults all three limits bind. Targets with a null or
    non-positive capacity are left out. Blocks of about ``block_docs`` documents
    are drawn by hash of doc_id, so none is hot whatever the keys.
    """
    wanted = collect_bounded(targets.select(F.col("target_id").cast("int"), F.col("capacity").cast("int")).where("target_id is not null and capacity > 0").distinct(), max_targets, "the targets")
    sized = cut(token_counts(docs, tokenizer).groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    blocks = max(1, -(-sized.count() // block_docs))
    shape = "target_id int, capacity int, doc_id bigint, piece_no int, tokens int, container string"
    if not wanted:
        return docs.sparkSession.createDataFrame([], shape)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(c).alias("capacity")) for t, c in wanted]))
    items = sized.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), each.alias("t")).select("t.target_id", "t.capacity", "block", "doc_id", "tokens")
    placed = items.where("tokens > 0")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        capacity, block = int(group["capacity"].iloc[0]), int(group["block"].iloc[0])
        group = group.sort_values("doc_id")
        tokens = group["tokens"].to_numpy()
        pieces = -(-tokens // capacity)
        at = np.repeat(np.arange(len(group)), pieces)
        no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, tokens[at] - no * capacity)
        into = best_fit(size, capacity, max(4, capacity // max_docs_share), attention * float(capacity) ** 2, WEIGHTS, rule)
        return pd.DataFrame({"target_id": group["target_id"].to_numpy()[at], "capacity": capacity, "doc_id": group["doc_id"].to_numpy()[at], "piece_no": no + 1, "tokens": size, "container": [f"{block}-{k}" for k in into]})

    packed = placed.groupBy("target_id", "capacity", "block").applyInPandas(run, shape)
    empty = items.where("tokens = 0").select("target_id", "capacity", "doc_id", F.lit(1).alias("piece_no"), "tokens", F.lit(None).cast("string").alias("container"))
    return packed.unionByName(empty)


def fill(packed: DataFrame) -> DataFrame:
    """How well the containers of each target are filled."""
    bins = packed.where("container is not null").groupBy("target_id", "capacity", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    out = bins.groupBy("target_id", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.max("pieces").alias("most_pieces"))
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
