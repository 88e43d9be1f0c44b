"""Problem 7: evaluation texts inside a training corpus.

One Aho-Corasick automaton holds word blocks of the normalised test items. Any
run of ``min_words`` item words contains a whole aligned block of half that
length, so the automaton misses nothing; around each hit the words are compared
exactly and offsets are mapped back to the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.runtime import collect_bounded

WORD = regex.compile(r"[\p{L}\p{N}]+")  # as in the SQL: marks and joiners are no words
SCHEMA = "doc_id bigint, item_id bigint, item_word int, n_words int, char_start int, char_end int"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_word", pa.int32()), ("n_words", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_BUILT: dict = {}


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case; a word is cut out before it is lowered."""
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words, self.block = min_words, max(1, (min_words + 1) // 2)
        self.words = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < min_words:
                continue
            self.words[item_id] = words
            for k in range(0, len(words) - self.block + 1, self.block):
                places.setdefault(f" {' '.join(words[k : k + self.block])} ", []).append((item_id, k))
        self.automaton = ahocorasick.Automaton()
        for key, where in places.items():
            self.automaton.add_word(key, (len(key), where))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """Maximal common runs: (item_id, first item word, words, char start, char end)."""
        if self.empty:
            return []
        plain = f" {' '.join(WORD.findall(text)).lower()} "
        hits = list(self.automaton.iter(plain))
        if not hits:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        found = set()
        for end, (length, where) in hits:
            at = plain.count(" ", 0, end + 1 - length + 1) - 1
            for item_id, k in where:
                own = self.words[item_id]
                i, j = at, k
                while i and j and words[i - 1] == own[j - 1]:
                    i, j = i - 1, j - 1
                e, f = at + self.block, k + self.block
                while e < len(words) and f < len(own) and words[e] == own[f]:
                    e, f = e + 1, f + 1
                if e - i >= self.min_words:
                    found.add((item_id, j, e - i, spans[i][0], spans[e - 1][1]))
        return sorted(found)


def find_passages(docs: DataFrame, items: DataFrame, min_words: int = 13, max_items: int = 200_000, block_chars: int = 4_000_000, max_chars: int = 200_000_000) -> DataFrame:
    """Every maximal run of at least ``min_words`` item words in a document.

    docs: doc_id, text; items: item_id, item_text. Output: one row per document,
    item and maximal run with the item word it begins at, its words and its place
    in the original text in code points.

    Null or empty texts and items give no rows; items shorter than ``min_words``
    words cannot be found; repeated rows are reported once; other columns are
    ignored. The items (a stated test set, at most ``max_items`` of ``max_chars``
    characters in all, else an error) go to the workers in blocks of ``block_chars``
    characters, one automaton and one scan per block; a worker holds all of them.
    """
    spark = docs.sparkSession
    rows = sorted({(r[0], r[1]) for r in collect_bounded(items.select(F.col("item_id").cast("bigint"), "item_text").dropna(), max_items, "the test items")})
    if sum(len(text) for _, text in rows) > max_chars:
        raise ValueError(f"the test items have more than {max_chars} characters; raise the limit knowingly")
    blocks: list[list] = [[]]
    size = 0
    for row in rows:
        if size + len(row[1]) > block_chars and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += len(row[1])
    shared = spark.sparkContext.broadcast(blocks)
    made = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (made, min_words)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = [Scanner(b, min_words) for b in shared.value]
        scanners = _BUILT[key]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for scanner in scanners:
                    out += [(doc_id, *hit) for hit in scanner.scan(text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    return texts.mapInArrow(run, SCHEMA).distinct()


def leaked(docs: DataFrame, items: DataFrame, min_words: int = 13) -> DataFrame:
    """Distinct (doc_id, item_id) of find_passages."""
    return find_passages(docs, items, min_words).select("doc_id", "item_id").distinct()
