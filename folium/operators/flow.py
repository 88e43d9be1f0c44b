"""Text in flow: blocks, Markdown lines, wrapping, measuring, pages. A character is half an em wide unless a font table says otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EM = 0.5
LINE = 1.18  # height of a line in sizes
BREAKS = re.compile(r"[^ \t\-–—/]*[ \t\-–—/]|[^ \t\-–—/]+")


def plain_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain text parted by blank lines: doc_id, block (from 0), text, align; long ones are justified. Null and empty texts give none."""
    parts = F.filter(F.transform(F.split("text", r"\r?\n[ \t]*\r?\n"), lambda x: F.regexp_replace(x, r"^[\r\n\t ]+|[\r\n\t ]+$", "")), lambda x: x != "")
    return docs.where("text <> ''").select("doc_id", F.posexplode(parts).alias("block", "text")).withColumn("align", F.when(F.length("text") > 200, "Justify").otherwise("Left"))


def line_classes(docs: DataFrame) -> DataFrame:
    """What each line of a Markdown text is: blank, heading, rule, table (its head), list, quote or text."""
    rows = docs.where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "t"))
    n = F.coalesce(F.lead("t").over(Window.partitionBy("doc_id").orderBy("line")), F.lit(""))
    t = F.col("t")
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    kind = (
        F.when(t.rlike(r"^\s*$"), "blank").when(t.rlike(r"^#{1,6}\s+.*$"), "heading").when(bare(t).rlike(r"^(?:-{3,}|\*{3,}|_{3,})$"), "rule")
        .when(t.contains("|") & bare(n).rlike(r"^\|?:*-[:|-]*$") & n.contains("|"), "table").when(t.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").when(t.rlike(r"^\s*>"), "quote").otherwise("text")
    )
    return rows.withColumn("kind", kind)


def wrap(text: str, size: float, width: float, em: float = EM) -> list[str]:
    """Greedy lines: a line ends after a blank, tab, hyphen, dash or slash; a word longer than a line is cut; trailing blanks go."""
    room = max(1, int(width / (em * size)))
    out = []
    for row in re.split(r"\r\n|\r|\n", text or ""):
        line = ""
        for word in BREAKS.findall(row):
            while line and len((line + word).rstrip()) > room or not line and len(word.rstrip()) > room:
                if line:
                    out.append(line.rstrip())
                    line = ""
                else:
                    out.append(word[:room])
                    word = word[room:]
            line += word
        out.append(line.rstrip())
    return out


def wrapped(blocks: DataFrame, size: float, width: float) -> DataFrame:
    """The lines of each block: doc_id, block, line (from 0), text."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wrap(t, size, width))

    return blocks.select("doc_id", "block", F.posexplode(split("text")).alias("line", "text"))


def measured(blocks: DataFrame, size: float, width: float) -> DataFrame:
    """doc_id, block, n_lines, height of each block."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(wrap(t, size, width))).astype("int32")

    return blocks.withColumn("n_lines", count("text")).select("doc_id", "block", "n_lines", (F.col("n_lines") * size * LINE).alias("height"))


def _pages(rows: list[tuple], room: float) -> Iterator[tuple]:
    """Places of one document's (doc_id, block, n_lines, height) in order."""
    page, y = 1, 0.0
    for doc_id, block, n, height in rows:
        step, line = height / max(n, 1), 0
        if y and y + height > room and height <= room:
            page, y = page + 1, 0.0
        while line < n:  # a block taller than what is left flows on by lines
            fit = min(n - line, max(int((room - y + 1e-9) / step), 0))
            if not fit and y:
                page, y = page + 1, 0.0
                continue
            fit = fit or 1
            yield doc_id, block, page, line, line + fit, y
            y += fit * step
            line += fit


def paginated(sized: DataFrame, room: float) -> DataFrame:
    """Where each block (or part of it) stands: page, lines [first, end), top. Documents are read one after another from sorted partitions."""
    shape = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("page", pa.int32()), ("first_line", pa.int32()), ("end_line", pa.int32()), ("top", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
        out: list[tuple] = []
        for _, own in groupby(every, key=lambda r: r[0]):
            out += _pages(own, room)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 6, shape)], schema=shape)

    rows = sized.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("block").cast("int").alias("block"), "n_lines", F.col("height").cast("double").alias("height"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "block").mapInArrow(run, "doc_id bigint, block int, page int, first_line int, end_line int, top double")
